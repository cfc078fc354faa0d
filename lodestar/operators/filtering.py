"""Candidate filtering: labels, priors, votes, decisions, conflicts, and the greedy choice of larger connectives."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

CUTOFF = 0.45


def prior(rows: DataFrame, key: str, label: str) -> DataFrame:
    """share of positives per key, and how many rows it rests on."""
    return rows.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("prior"), F.count("*").alias("n"))


def prior_filter(rows: DataFrame, priors: DataFrame, key: str, cutoff: float = CUTOFF, complete: Column | None = None) -> DataFrame:
    """rows whose key's share is above the cutoff; an unseen key, or a row that isn't complete, has 0."""
    score = F.coalesce(F.col("prior"), F.lit(0.0))
    if complete is not None:
        score = F.when(complete, score).otherwise(0.0)
    return rows.join(priors.select(key, "prior"), key, "left").withColumn("score", score).filter(F.col("score") > cutoff).drop("prior")


def soft_vote(scores: Sequence[str | Column], weights: Sequence[float | Column] | None = None) -> Column:
    """weighted mean of the scores that are there; null if none is."""
    cols = [F.col(s) if isinstance(s, str) else s for s in scores]
    cols = [F.when(~F.isnan(c), c) for c in cols]
    w = [F.when(c.isNotNull(), x if isinstance(x, Column) else F.lit(float(x))).otherwise(0.0) for c, x in zip(cols, weights or [1.0] * len(cols), strict=True)]
    total = sum(w[1:], w[0])
    return sum((F.coalesce(c, F.lit(0.0)) * x for c, x in zip(cols[1:], w[1:], strict=True)), F.coalesce(cols[0], F.lit(0.0)) * w[0]) / F.nullif(total, F.lit(0.0))


def majority(rows: DataFrame, key: Sequence[str], label: Column) -> DataFrame:
    """Positives and negatives per key, and whether positives are strictly more."""
    n = rows.groupBy(*key).agg(F.count_if(label).alias("pos"), F.count_if(~label).alias("neg"))
    return n.withColumn("predicted", F.col("pos") > F.col("neg"))


def conflicts(candidates: DataFrame, sentence: Sequence[str], tokens: str, has_steiner: str) -> DataFrame:
    """candidates without those that share a token with another one and have a pattern with a Steiner node."""
    own = candidates.columns
    used = candidates.repartition(*sentence).select(*sentence, "cand_id", F.struct(*own).alias("_row"), F.explode_outer(F.array_distinct(tokens)).alias("_t"))
    # the sentences' partitions serve the count by token and the way back to candidates: one shuffle in all
    n = F.count("_t").over(Window.partitionBy(*sentence, "_t"))
    back = used.withColumn("_n", n).groupBy(*sentence, "cand_id").agg(F.first("_row").alias("_row"), F.max("_n").alias("_n"))
    return back.filter((F.col("_n") <= 1) | ~F.coalesce(F.col(f"_row.{has_steiner}"), F.lit(False))).select("_row.*")


def _greedy(spans: list, order: list) -> list[bool]:
    claimed: set = set()
    keep = [False] * len(spans)
    for i in sorted(range(len(spans)), key=lambda i: (-len(spans[i]), order[i])):
        own = set(spans[i])
        if not own & claimed:
            keep[i] = True
            claimed |= own
    return keep


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _choose(spans: pa.Array, order: pa.Array) -> pa.Array:
    return pa.array([None if s is None else _greedy([x or [] for x in s], o) for s, o in zip(spans.to_pylist(), order.to_pylist(), strict=True)], pa.list_(pa.bool_()))


def keep_larger(candidates: DataFrame, sentence: Sequence[str], tokens: str, order: str) -> DataFrame:
    """in each sentence larger connectives first, ties by ``order``; one that reuses a claimed token is dropped.

    The rule is sequential (a dropped one claims nothing), so a sentence's candidates come together in a row, which is small: what a
    sentence's tokens allow. Python sees their tokens and order alone, many sentences at a time; sentences with one candidate stay in the JVM.
    """
    rows = candidates.groupBy(*sentence).agg(F.collect_list(F.struct(*candidates.columns)).alias("_rows"))
    several = lambda c: F.when(F.size("_rows") > 1, F.col(f"_rows.{c}"))
    kept = rows.withColumn("_keep", _choose(several(tokens), several(order)))
    pairs = F.filter(F.arrays_zip(F.col("_rows").alias("r"), F.col("_keep").alias("k")), lambda z: z["k"])
    return kept.select(F.inline(F.when(F.col("_keep").isNull(), F.col("_rows")).otherwise(F.transform(pairs, lambda z: z["r"]))))


def chi_square(table: DataFrame, item: str, label: Column, *, docs: str = "doc_id") -> DataFrame:
    """chi-square of each binary item against a binary label; one row per item, from counts alone.

    table: (docs, item, label) rows, each pair of document and item once or more.
    """
    once = table.select(docs, item, label.alias("_l")).distinct()
    n = once.groupBy(item).agg(F.count_if("_l").alias("a"), F.count_if(~F.col("_l")).alias("b"))
    whole = once.select(docs, "_l").distinct().agg(F.count_if("_l").alias("pos"), F.count_if(~F.col("_l")).alias("neg"))
    a, b, p, q = (F.col(c).cast("double") for c in ("a", "b", "pos", "neg"))
    c, d = p - a, q - b
    chi = (p + q) * F.pow(a * d - b * c, F.lit(2)) / F.nullif((a + b) * (c + d) * p * q, F.lit(0.0))
    return n.crossJoin(whole).select(item, "a", "b", F.coalesce(chi, F.lit(0.0)).alias("chi2"))  # whole is one row


def top(rows: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """the k best rows, ties by the given columns."""
    return rows.orderBy(F.desc(score), *ties).limit(k)


def rebalance(rows: DataFrame, label: str, ratio: float = 1.0) -> DataFrame:
    """repeat rows of the rarer class until the classes' ratio is ``ratio``: each as often as that takes whole, and by its hash a share of them once more; the same in every run."""
    n = rows.agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    need = F.when(F.col(label), F.col("q") / (F.lit(ratio) * F.col("p"))).otherwise(F.col("p") / (F.lit(ratio) * F.col("q")))
    need = F.greatest(F.coalesce(need, F.lit(1.0)), F.lit(1.0))
    plain = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]
    once_more = F.pmod(F.xxhash64(*plain), F.lit(1 << 20)) < (need - F.floor(need)) * (1 << 20)
    times = (F.floor(need) + once_more.cast("int")).cast("int")
    return rows.crossJoin(n).withColumn("_k", F.explode(F.sequence(F.lit(1), times))).drop("_k", "p", "q")  # n is one row


def regularisation(n: int, per: float = 5.0) -> float:
    """F16: C = sqrt(n / 5), as the strength pyspark.ml expects: 1 / (C n)."""
    return 1.0 / ((n / per) ** 0.5 * n) if n else 0.0


def folds(key: str | Column, k: int = 20) -> Column:
    """Fold of a row by its key, the same in every run and engine: eight hexadecimal digits of its MD5, modulo k. A null key is in fold 0."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % k, F.lit(0)).cast("int")


def ranked(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
