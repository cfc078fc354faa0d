"""The pipelines: what they learn from annotated sentences, and how they find relations in others.

Each is a pair of functions: ``fit(sentences, instances) -> model`` and ``predict(model, sentences) -> instances`` with columns
(doc_id, sent_id, inst_id, connective, cause, effect). ``PIPELINES`` maps names to constructors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.operators import baseline, features, filtering, graphs, labeller, metrics, models, patterns, surface
from lodestar.operators.patterns import SENT
from lodestar.plans.staging import cut

OUT = (*SENT, "inst_id", "connective", "cause", "effect")


def connective_lemmas(c: DataFrame, sentences: DataFrame) -> DataFrame:
    """Column connective_lemmas."""
    lemma = lambda i: F.get(F.filter("tokens", lambda t: t["idx"] == i), F.lit(0))["lemma"]
    return c.join(sentences.select(*SENT, "tokens"), list(SENT)).withColumn("connective_lemmas", F.array_join(F.transform("connective", lemma), " ")).drop("tokens")


@dataclass
class Options:
    """Settings with their defaults."""

    max_steiners: int = patterns.MAX_STEINERS
    include_tags: bool = True
    cutoff: float = filtering.CUTOFF
    parse_radius: int = baseline.RADIUS
    classifier: str = "logistic"
    classifiers: tuple[str, ...] = ("global", "mostfreq", "perconn")
    feature_names: tuple[str, ...] = features.DEFAULT
    feature_select_k: int = 0
    rebalance_ratio: float = 1.0
    diff_correctness: bool | None = None
    global_for_all_same: bool = True
    filter_overlapping: bool = True
    pattern_type: str = "dependency"
    auto_weight: bool = False
    tuning_share: float = 0.5
    weight_slope: float | None = None
    extra: dict = field(default_factory=dict)


class Stage:
    def fit(self, sentences: DataFrame, gold: DataFrame) -> None:
        """Learn from sentences and their instances."""


class TreeStage(Stage):
    """Candidates by tree patterns over activated sentences or over phrase-structure trees, arguments grown to spans."""

    def __init__(self, o: Options):
        self.o, self.patterns, self.active, self.phrases = o, None, (None, None), o.pattern_type == "constituency"

    def activated(self, sentences):
        """Rewritten sentences, kept while the same ones are worked on."""
        if self.active[0] is not sentences:
            self.active = sentences, cut(patterns.phrase_trees(sentences) if self.phrases else patterns.activated(sentences))
        return self.active[1]

    def fit(self, sentences, gold):
        own = patterns.on_phrases(gold, sentences) if self.phrases else gold
        learned = patterns.induce(own, self.activated(sentences), self.o.max_steiners, self.phrases)
        self.patterns = sentences.sparkSession.createDataFrame(learned.collect(), learned.schema)  # a model: one row per learned pattern

    def candidates(self, sentences, gold=None):
        found = patterns.match(self.activated(sentences), self.patterns)
        c = patterns.candidates(patterns.on_words(found, sentences) if self.phrases else found, gold)
        return graphs.expand_spans(c, sentences).drop("moved")


class SurfaceStage(Stage):
    """Candidates by surface patterns, arguments by the labeller."""

    def __init__(self, o: Options):
        self.o, self.learned, self.weights = o, [], {}

    def fit(self, sentences, gold):
        self.learned = [tuple(r) for r in surface.learn(gold, sentences, self.o.include_tags).orderBy("pattern").collect()]  # a model: one row per learned pattern
        found = surface.search(sentences, self.learned, gold, self.o.include_tags)
        self.weights = labeller.fit(found, gold, sentences)

    def candidates(self, sentences, gold=None):
        c = surface.search(sentences, self.learned, gold, self.o.include_tags)
        return labeller.label(c, sentences, self.weights)


class VoteFilter(Stage):
    """The soft vote over candidates."""

    def __init__(self, o: Options, diff: bool):
        self.o, self.diff = o, o.diff_correctness if o.diff_correctness is not None else diff

    def rows(self, c, sentences):
        f = features.extract(c, sentences, self.o.feature_names)
        return connective_lemmas(c, sentences).join(models.vectors(f), models.KEY)

    def fit(self, candidates, sentences, gold):
        r = cut(models.labels(self.rows(candidates, sentences), gold, self.diff))
        self.model = models.fit_global(r.select("x", "label"), self.o.classifier, k_best=self.o.feature_select_k, ratio=self.o.rebalance_ratio)
        known = models.training_share(r, self.o.tuning_share) if self.o.auto_weight else r
        self.per = cut(models.fit_connectives(known.select("connective_lemmas", "x", "label")))
        self.weights = cut(models.vote_weights(self.scores(r), slope=self.o.weight_slope)) if self.o.auto_weight else None

    def scores(self, rows, weights=None):
        return models.score(rows, self.model, self.per, classifiers=self.o.classifiers, weights=weights, global_for_all_same=self.o.global_for_all_same)

    def keep(self, candidates, sentences):
        return models.decide(cut(self.scores(cut(self.rows(candidates, sentences)), self.weights)), self.o.cutoff)


class PriorFilter(Stage):
    """The share of true uses of each connective; an unseen connective scores 0."""

    def __init__(self, o: Options, diff: bool = False):
        self.o = o

    def fit(self, candidates, sentences, gold):
        self.priors = cut(filtering.prior(connective_lemmas(models.labels(candidates), sentences), "connective_lemmas", "label"))

    def keep(self, candidates, sentences):
        whole = (F.size("cause") > 0) & (F.size("effect") > 0)
        return filtering.prior_filter(connective_lemmas(candidates, sentences), self.priors, "connective_lemmas", self.o.cutoff, whole)


class BaselineStage(Stage):
    """Instances of the parse-path baseline."""

    def __init__(self, o: Options):
        self.o = o

    def fit(self, sentences, gold):
        self.lexicon = [tuple(r[0]) for r in baseline.lexicon(gold, sentences).collect()]  # a model: one row per connective type
        h = graphs.heads(gold.filter("size(cause) > 0 and size(effect) > 0").select(*OUT), sentences, ["cause", "effect"])
        self.counts = cut(baseline.train(baseline.pairs(sentences, self.lexicon, self.o.parse_radius), h))

    def predict(self, sentences):
        found = baseline.predict(baseline.pairs(sentences, self.lexicon, self.o.parse_radius), self.counts)
        grown = baseline.expand(found, sentences)
        return grown.select(*SENT, F.concat(F.lit("b"), F.array_join("connective", "-"), F.lit("|"), F.array_join("cause", "-"), F.lit("|"), F.array_join("effect", "-")).alias("inst_id"), "connective", "cause", "effect")


class FilteredPipeline:
    """Candidates, a filter, and the choice of larger connectives; the baseline's instances may be added before the last step."""

    def __init__(self, o: Options, stage: type, keep: type, with_baseline: bool = False):
        self.o, self.stage, self.filter = o, stage(o), keep(o, stage is not TreeStage)
        self.baseline = BaselineStage(o) if with_baseline else None

    def fit(self, sentences: DataFrame, gold: DataFrame) -> FilteredPipeline:
        gold = gold.filter("kind = 'causal'") if "kind" in gold.columns else gold
        self.stage.fit(sentences, gold)
        self.filter.fit(cut(self.stage.candidates(sentences, gold)), sentences, gold)
        if self.baseline:
            self.baseline.fit(sentences, gold)
        return self

    def candidates(self, sentences: DataFrame) -> DataFrame:
        return self.stage.candidates(sentences)

    def predict(self, sentences: DataFrame) -> DataFrame:
        out = self.filter.keep(cut(self.stage.candidates(sentences)), sentences).select(*SENT, F.col("cand_id").alias("inst_id"), "connective", "cause", "effect")
        if self.baseline:
            h = lambda df: graphs.heads(df, sentences, ["cause", "effect"])
            out = baseline.combine(h(cut(out)), h(cut(self.baseline.predict(sentences)))).select(*OUT)
        return filtering.keep_larger(out, SENT, "connective", "inst_id") if self.o.filter_overlapping else out


class BaselinePipeline:
    def __init__(self, o: Options):
        self.stage = BaselineStage(o)

    def fit(self, sentences: DataFrame, gold: DataFrame) -> BaselinePipeline:
        self.stage.fit(sentences, gold.filter("kind = 'causal'") if "kind" in gold.columns else gold)
        return self

    def predict(self, sentences: DataFrame) -> DataFrame:
        return self.stage.predict(sentences)


PIPELINES: dict[str, Callable] = {
    "tregex": lambda o: FilteredPipeline(o, TreeStage, VoteFilter),
    "regex": lambda o: FilteredPipeline(o, SurfaceStage, VoteFilter),
    "baseline": BaselinePipeline,
    "tregex+baseline": lambda o: FilteredPipeline(o, TreeStage, VoteFilter, True),
    "regex+baseline": lambda o: FilteredPipeline(o, SurfaceStage, VoteFilter, True),
    "tregex_mostfreq": lambda o: FilteredPipeline(o, TreeStage, PriorFilter),
    "regex_mostfreq": lambda o: FilteredPipeline(o, SurfaceStage, PriorFilter),
}


def evaluate(gold: DataFrame, predicted: DataFrame, partial: bool = False) -> DataFrame:
    """Counts, shares and overlap of connectives, causes and effects, strict or partial; one row per measured thing."""
    m = metrics.match_connectives(gold.select(*OUT), predicted.select(*OUT), partial=partial)
    shares = lambda df, what, tp, fp, fn, j: df.select(F.lit(what).alias("what"), F.col(tp).alias("tp"), F.col(fp).alias("fp"), F.col(fn).alias("fn"), *metrics.prf(*[F.col(x).cast("double") for x in (tp, fp, fn)]), j.alias("jaccard"))
    c, e = metrics.argument_counts(m, "cause"), metrics.argument_counts(m, "effect")
    return shares(c, "connective", "c_tp", "c_fp", "c_fn", F.lit(None).cast("double")).unionByName(shares(c, "cause", "tp", "fp", "fn", F.col("jaccard"))).unionByName(shares(e, "effect", "tp", "fp", "fn", F.col("jaccard")))


def cross_validate(sentences: DataFrame, gold: DataFrame, make: Callable[[], object], k: int = 20, fold: Column | None = None) -> DataFrame:
    """Metrics averaged over folds of sentences, with deviations of the shares."""
    own = fold if fold is not None else filtering.folds(F.concat_ws("/", *SENT), k)
    s, g = sentences.withColumn("_f", own), gold.filter("kind = 'causal'").drop("kind").withColumn("_f", own)
    rows = None
    for i in range(k):
        pick = lambda df, same: df.filter((F.col("_f") == i) if same else (F.col("_f") != i)).drop("_f")  # noqa: B023, E731
        model = make().fit(pick(s, False), pick(g, False))
        r = evaluate(pick(g, True), model.predict(pick(s, True))).withColumn("fold", F.lit(i))
        rows = r if rows is None else rows.unionByName(r)
    return rows.groupBy("what").agg(*[F.avg(x).alias(x) for x in ("tp", "fp", "fn", "precision", "recall", "f1", "jaccard")], *[F.stddev_pop(x).alias(f"{x}_std") for x in ("precision", "recall", "f1", "jaccard")])
