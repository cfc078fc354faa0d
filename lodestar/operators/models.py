"""The candidate filter: a global classifier, one for each connective, the most frequent class, and their soft vote.

Two classifiers keep their training rows, which annotation bounds: k nearest neighbours and a kernel machine. Beyond their stated sizes they raise an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodestar.operators import metrics
from lodestar.operators.filtering import CUTOFF, conflicts, rebalance, regularisation, soft_vote
from lodestar.operators.patterns import SENT
from lodestar.plans.staging import cut

KEY = [*SENT, "cand_id"]
#: Width of hashed feature vectors.
WIDTH = 1 << 12


def labels(candidates: DataFrame, gold: DataFrame | None = None, diff: bool = False) -> DataFrame:
    """column label. By default whether a gold instance is linked; with ``diff`` only the first candidate of each gold connective, others of it are negatives."""
    if not diff:
        return candidates.withColumn("label", F.col("gold_inst_id").isNotNull())
    n = gold.groupBy(*SENT, F.array_sort("connective").alias("connective")).agg(F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy(*SENT, "connective").orderBy("cand_id"))
    return candidates.withColumn("_k", nth).join(n, [*SENT, "connective"], "left").withColumn("label", F.coalesce(F.col("_k") <= F.col("_n"), F.lit(False))).select(*candidates.columns, "label")


def vectors(features: DataFrame, width: int = WIDTH) -> DataFrame:
    """(KEY, x): hashed feature vectors as arrays of (slot, value) pairs, made from the long rows by one aggregation."""
    slot = F.pmod(F.xxhash64("feature", "value"), F.lit(width)).cast("int")
    one = features.select(*KEY, slot.alias("slot"), F.coalesce("number", F.lit(1.0)).alias("n")).groupBy(*KEY, "slot").agg(F.sum("n").alias("n"))
    return one.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("slot", "n"))).alias("x"))


def dense(x: str | Column, width: int = WIDTH) -> Column:
    """A dense vector column, for pyspark.ml."""
    m = F.map_from_entries(x)
    return array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(m[i], F.lit(0.0))))


#: Most cells (rows times slots in use) a model that keeps its rows may have, and most rows of a kernel matrix.
CELLS, KERNEL_ROWS = 1 << 27, 1 << 13


class KeptRows:
    """k nearest neighbours (``knn``), or a support vector machine with a Gaussian kernel (``kernel``), over the slots in use."""

    def __init__(self, kind: str, rows: Sequence[tuple], k: int = 5, c: float = 1.0):
        self.kind, self.k = kind, k
        slots = sorted({int(e["slot"]) for x, _ in rows for e in x})
        if len(rows) * len(slots) > CELLS or (kind == "kernel" and len(rows) > KERNEL_ROWS):
            raise ValueError(f"{kind} keeps all its training rows; {len(rows)} with {len(slots)} slots are too many")
        self.at = {s: j for j, s in enumerate(slots)}
        self.x, extra = self._dense([x for x, _ in rows])
        self.y = np.array([bool(y) for _, y in rows])
        self.gamma = 1.0 / max(len(slots), 1)
        self.alpha = self._dual(c) if kind == "kernel" else None

    def _dense(self, xs: Sequence) -> tuple[np.ndarray, np.ndarray]:
        """Rows over the slots in use, and the squared length of what lies in other slots."""
        m, extra = np.zeros((len(xs), len(self.at)), np.float32), np.zeros(len(xs))
        for i, x in enumerate(xs):
            for e in x:
                j = self.at.get(int(e["slot"]))
                if j is None:
                    extra[i] += float(e["n"]) ** 2
                else:
                    m[i, j] = e["n"]
        return m, extra

    def _squares(self, m: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.maximum((m**2).sum(1)[:, None] + extra[:, None] + (self.x**2).sum(1)[None] - 2 * m @ self.x.T, 0.0)

    def _dual(self, c: float, rounds: int = 100, least: float = 1e-4) -> np.ndarray:
        """Dual coordinate ascent; a constant added to the kernel stands for the intercept."""
        s = np.where(self.y, 1.0, -1.0)
        kernel = np.exp(-self.gamma * self._squares(self.x, np.zeros(len(s)))) + 1.0
        a, f = np.zeros(len(s)), np.zeros(len(s))
        for _ in range(rounds):
            moved = 0.0
            for i in range(len(s)):
                new = min(max(a[i] + (1 - s[i] * f[i]) / kernel[i, i], 0.0), c)
                if new != a[i]:
                    f += (new - a[i]) * s[i] * kernel[i]
                    moved, a[i] = max(moved, abs(new - a[i])), new
            if moved < least:
                break
        return a * s

    def probabilities(self, xs: Sequence, block: int = 256) -> np.ndarray:
        out = np.zeros(len(xs))
        for b in range(0, len(xs), block):
            d = self._squares(*self._dense(xs[b : b + block]))
            if self.kind == "knn":
                out[b : b + block] = self.y[np.argsort(d, axis=1, kind="stable")[:, : self.k]].mean(1)
            else:
                out[b : b + block] = 1 / (1 + np.exp(-(np.exp(-self.gamma * d) + 1.0) @ self.alpha))
        return out

    def column(self, x: str) -> Column:
        @F.arrow_udf(T.DoubleType())
        def run(x: pa.Array) -> pa.Array:
            return pa.array(self.probabilities(x.to_pylist()), pa.float64())

        return run(x)


def classifier(kind: str, n: int, seed: int = 0):
    """An estimator by name; ``knn`` and ``kernel`` are KeptRows."""
    common = {"featuresCol": "v", "labelCol": "y"}
    return {
        "logistic": lambda: LogisticRegression(**common, weightCol="w", regParam=regularisation(n), elasticNetParam=1.0, tol=1e-5),
        "tree": lambda: DecisionTreeClassifier(**common, seed=seed),
        "forest": lambda: RandomForestClassifier(**common, seed=seed),
        "svm": lambda: LinearSVC(**common, weightCol="w"),
        "bayes": lambda: NaiveBayes(**common),
    }[kind]()


def fit_global(rows: DataFrame, kind: str = "logistic", width: int = WIDTH, k_best: int = 0, ratio: float = 1.0) -> PipelineModel | KeptRows | None:
    """a model of (x, label) rows; null if only one class is there. Classes are weighted, or repeated for others than logistic."""
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # two rows
    if len(n) < 2:
        return None
    total = sum(n.values())
    if kind != "logistic":
        rows = rebalance(rows, "label", ratio)
    if kind in ("knn", "kernel"):
        return KeptRows(kind, rows.select("x", "label").orderBy("x", "label").collect())  # a model, of bounded size
    rows = rows.select(dense("x", width).alias("v"), F.col("label").cast("double").alias("y"), F.when(F.col("label"), total / (2 * n[True])).otherwise(total / (2 * n[False])).alias("w"))
    steps: list = [classifier(kind, total)]
    if k_best:
        select = UnivariateFeatureSelector(featuresCol="v", labelCol="y", outputCol="best").setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(k_best)
        steps = [select, steps[0].setFeaturesCol("best")]
    return Pipeline(stages=steps).fit(rows)


def score_global(rows: DataFrame, model: PipelineModel | KeptRows | None, width: int = WIDTH) -> DataFrame:
    """Column global_score of (x) rows."""
    if model is None:
        return rows.withColumn("global_score", F.lit(None).cast("double"))
    if isinstance(model, KeptRows):
        return rows.withColumn("global_score", model.column("x"))
    scored = model.transform(rows.withColumn("v", dense("x", width)))
    p = vector_to_array("probability")[1] if "probability" in scored.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return scored.select(*rows.columns, p.alias("global_score"))


def _logistic(x: np.ndarray, y: np.ndarray, c: float, steps: int = 300) -> np.ndarray:
    """L1 logistic regression with balanced classes by proximal gradient; the last weight is the intercept."""
    w = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    x = np.hstack([x, np.ones((len(x), 1))])
    size = 4.0 / max(float((w[:, None] * x**2).sum(0).sum()), 1e-9)
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - size * (x.T @ (w * (p - y)))
        b[:-1] = np.sign(b[:-1]) * np.maximum(np.abs(b[:-1]) - size / c, 0)
    return b


def fit_connectives(rows: DataFrame, key: str = "connective_lemmas") -> DataFrame:
    """Per connective its slots' weights, the share of positives and the number of classes, from (key, x, label) rows.

    A group is the labelled candidates of one connective, which annotation bounds; groups of one class get no weights.
    """

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        y = t["label"].to_numpy(bool)
        slots: dict[int, int] = {}
        for x in t["x"]:
            for e in x:
                slots.setdefault(int(e["slot"]), len(slots))
        weights: list = []
        if y.any() and not y.all():
            m = np.zeros((len(t), len(slots)))
            for i, x in enumerate(t["x"]):
                for e in x:
                    m[i, slots[int(e["slot"])]] = e["n"]
            b = _logistic(m, y, (len(t) / 5) ** 0.5)
            weights = [(-1, float(b[-1])), *[(s, float(b[j])) for s, j in slots.items() if b[j]]]
        return pd.DataFrame({key: [t[key].iloc[0]], "prior": [float(y.mean())], "classes": [1 + int(y.any() and not y.all())], "weights": [weights]})

    return rows.groupBy(key).applyInPandas(fit, f"{key} string, prior double, classes int, weights array<struct<slot:int,w:double>>")


NAMES = ("global", "mostfreq", "perconn")


def training_share(rows: DataFrame, share: float = 0.5, key: str = "connective_lemmas") -> DataFrame:
    """the first share of each connective's rows, rounded up, in the order of their keys; the others are left for the votes' weights."""
    w = Window.partitionBy(key)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*KEY))).withColumn("_n", F.count("*").over(w))
    return r.filter(F.col("_k") <= F.ceil(F.col("_n") * share)).drop("_k", "_n")


def vote_weights(scored: DataFrame, label: str = "label", key: str = "connective_lemmas", slope: float | None = None) -> DataFrame:
    """per connective the weight of each classifier, its mean probability of the right answer, with sum 1; with ``slope`` a logistic function around 1/2 sharpens them.

    A classifier that never scores a connective has weight 0 there.
    """

    def right(n: str) -> Column:
        p = F.when(F.col(label), F.col(f"{n}_score")).otherwise(1 - F.col(f"{n}_score"))
        return p if slope is None else 1 / (1 + F.exp(-slope * (p - 0.5)))

    r = scored.groupBy(key).agg(*[F.coalesce(F.avg(right(n)), F.lit(0.0)).alias(n) for n in NAMES])
    total = F.nullif(sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0])), F.lit(0.0))
    return r.select(key, *[F.coalesce(F.col(n) / total, F.lit(1.0 / len(NAMES))).alias(f"{n}_weight") for n in NAMES])


def saved_scores(scored: DataFrame, label: str = "label") -> DataFrame:
    """(label, classifier, score) of every candidate, the vote among the classifiers; scores that aren't there are left out."""
    each = F.array(*[F.struct(F.lit(n).alias("classifier"), F.col(c).alias("score")) for n, c in (("weighted", "score"), *((n, f"{n}_score") for n in NAMES))])
    return scored.select(*KEY, label, F.inline(each)).filter("score is not null and not isnan(score)")


def score_bins(saved: DataFrame, label: str = "label", bins: int = 20) -> DataFrame:
    """How many candidates of each label a classifier scores within each bin of [0, 1]."""
    return saved.groupBy("classifier", label, F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def tree_trials(train: DataFrame, test: DataFrame, rounds: int = 15, percent: float = 1.0, ratio: float = 2.0, width: int = WIDTH) -> DataFrame:
    """accuracy counts and shares averaged over decision trees of different seeds on rebalanced (x, label) rows, after an F-test that keeps the best percent of slots."""
    ready = lambda r: r.select(dense("x", width).alias("v"), F.col("label").cast("double").alias("y"))
    select = UnivariateFeatureSelector(featuresCol="v", labelCol="y", outputCol="best", selectionMode="percentile").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(percent / 100)
    known = cut(ready(rebalance(train, "label", ratio)))
    chosen = select.fit(known)
    known, new = cut(chosen.transform(known)), cut(chosen.transform(ready(test)))
    counts = None
    for seed in range(rounds):
        got = DecisionTreeClassifier(featuresCol="best", labelCol="y", seed=seed).fit(known).transform(new)
        one = metrics.classification(got, F.col("y") == 1, F.col("prediction") == 1)
        counts = one if counts is None else counts.unionByName(one)
    return metrics.macro(counts)


def matrix_map(rows: DataFrame, row: Column, slots: int = 64, width: int = WIDTH) -> DataFrame:
    """the feature matrix as a coarse map, the mean value per bin of rows and bin of slots; zeros are counted through the number of rows."""
    r = rows.select(row.alias("row_bin"), "x")
    n = r.groupBy("row_bin").agg(F.count("*").alias("_n"))
    per = -(-width // slots)
    cells = r.select("row_bin", F.inline("x")).groupBy("row_bin", F.floor(F.col("slot") / per).cast("int").alias("slot_bin")).agg(F.sum("n").alias("s"))
    return cells.join(n, "row_bin").select("row_bin", "slot_bin", (F.col("s") / (F.col("_n") * per)).alias("mean"))


def score(rows: DataFrame, model: PipelineModel | KeptRows | None, per: DataFrame, key: str = "connective_lemmas", classifiers: Sequence[str] = NAMES, weights: Mapping[str, float] | DataFrame | None = None, global_for_all_same: bool = True) -> DataFrame:
    """global_score, mostfreq_score, perconn_score and score of (key, x) rows.

    An unknown connective gets the global score, or 0 if there is none. Of a connective with one class the most frequent one counts, and
    the global one only if ``global_for_all_same``. weights: by classifier, or the table of ``vote_weights``; a connective that isn't in it has equal ones.
    """
    r = score_global(rows, model if "global" in classifiers else None).join(per, key, "left")
    w = F.map_from_entries("weights")
    dot = F.aggregate("x", F.coalesce(w[F.lit(-1)], F.lit(0.0)), lambda s, e: s + F.coalesce(w[e["slot"]], F.lit(0.0)) * e["n"])
    perconn = F.when(F.size("weights") > 0, 1 / (1 + F.exp(-dot))) if "perconn" in classifiers else F.lit(None).cast("double")
    most = F.round(F.col("prior")) if "mostfreq" in classifiers else F.lit(None).cast("double")
    r = r.withColumn("mostfreq_score", most).withColumn("perconn_score", perconn)
    own_global = F.when((F.col("classes") == 2) | F.lit(global_for_all_same) | F.col("prior").isNull(), F.col("global_score"))
    fitted = isinstance(weights, DataFrame)
    if fitted:
        r = r.join(weights, key, "left")
    by = [F.coalesce(F.col(f"{n}_weight"), F.lit(1.0)) if fitted else (weights or {}).get(n, 1.0) for n in NAMES]
    vote = soft_vote([own_global, "mostfreq_score", "perconn_score"], by)
    r = r.withColumn("score", F.coalesce(F.when(F.col("prior").isNull(), F.coalesce("global_score", F.lit(0.0))), vote, F.lit(0.0)))
    return r.drop("weights", "prior", "classes", *[f"{n}_weight" for n in NAMES])


def decide(scored: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """candidates above the cutoff, without those in conflict that rest on a Steiner pattern."""
    return conflicts(scored.filter(F.col("score") > cutoff), SENT, "connective", "has_steiner")


def feature_weights(model: PipelineModel, features: DataFrame, width: int = WIDTH) -> DataFrame:
    """(feature, value, weight), by size, without zeros; values that share a slot share its weight."""
    coefficients = model.stages[-1].coefficients.toArray().tolist()
    spark = features.sparkSession
    w = spark.createDataFrame([(i, c) for i, c in enumerate(coefficients) if c], "slot int, weight double")
    names = features.select("feature", "value", F.pmod(F.xxhash64("feature", "value"), F.lit(width)).cast("int").alias("slot")).distinct()
    return names.join(w, "slot").select("feature", "value", "weight").orderBy(F.desc(F.abs("weight")), "feature", "value")


__all__ = ["decide", "feature_weights", "fit_connectives", "fit_global", "labels", "matrix_map", "saved_scores", "score", "score_bins", "training_share", "tree_trials", "vectors", "vote_weights"]
