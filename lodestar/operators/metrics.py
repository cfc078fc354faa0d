"""Agreement and accuracy: counts, precision, recall, F1, confusion, kappa, overlap of spans, and instance comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; undefined shares are null."""
    p, r = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    f = 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))
    return [p.cast("double").alias("precision"), r.cast("double").alias("recall"), f.cast("double").alias("f1")]


def classification(rows: DataFrame, gold: Column, predicted: Column, *keys: str) -> DataFrame:
    """Tp, fp, fn and the shares from two boolean columns, per key."""
    n = rows.groupBy(*keys).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"))
    return n.select(*keys, "tp", "fp", "fn", *prf(F.col("tp").cast("double"), F.col("fp").cast("double"), F.col("fn").cast("double")))


def micro(counts: DataFrame) -> DataFrame:
    """Sums of tp, fp, fn and the shares of the sums."""
    s = counts.agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return s.select("tp", "fp", "fn", *prf(*[F.col(k).cast("double") for k in ("tp", "fp", "fn")]))


def macro(counts: DataFrame) -> DataFrame:
    """Averages of the shares over rows (folds); undefined ones are skipped. Deviations are of the population."""
    shares = counts.select("tp", "fp", "fn", *prf(*[F.col(k).cast("double") for k in ("tp", "fp", "fn")]))
    return shares.agg(*[F.avg(k).alias(k) for k in ("tp", "fp", "fn", "precision", "recall", "f1")], *[F.stddev_pop(k).alias(f"{k}_std") for k in ("precision", "recall", "f1")])


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of a score weighted by matches; rows without a score don't count."""
    w = F.when(value.isNotNull() & ~F.isnan(value), weight)
    return F.sum(F.when(w > 0, value) * w) / F.nullif(F.sum(w), F.lit(0))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts of (gold, predicted), rows with a missing side left out."""
    return rows.filter(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def kappa(matrix: DataFrame) -> DataFrame:
    """N, accuracy and Cohen's kappa of a confusion table."""
    sides = matrix.select(F.col("gold").alias("v"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")).unionByName(matrix.select(F.col("predicted").alias("v"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))
    chance = sides.groupBy("v").agg(F.sum("g").alias("g"), F.sum("p").alias("p")).agg(F.sum(F.col("g").cast("double") * F.col("p")).alias("chance"))
    agreed = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).cast("double").alias("same"))
    e, a = F.col("chance") / (F.col("n").cast("double") * F.col("n")), F.col("same") / F.col("n")
    return agreed.crossJoin(chance).select("n", a.alias("accuracy"), F.when(e < 1, (a - e) / (1 - e)).alias("kappa"))  # one row each


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Overlap of two index arrays; two empty or missing ones agree."""
    x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.array()) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def same_span(a: str | Column, b: str | Column) -> Column:
    """Equal fragments in any order; null if either is missing."""
    return F.array_sort(a) == F.array_sort(b)


def partial_span(a: str | Column, b: str | Column, least: float = 0.5) -> Column:
    """Shared fragments are more than ``least`` of the larger side."""
    return F.size(F.array_intersect(a, b)) > least * F.greatest(F.size(a), F.size(b))


def pairs_of(rows: DataFrame, name: str) -> DataFrame:
    """All unordered pairs of distinct values of a small dimension (annotators), a < b."""
    d = rows.select(name).distinct()
    return d.select(F.col(name).alias("a")).join(d.select(F.col(name).alias("b")), F.col("a") < F.col("b"))


# --- instances (doc_id, sent_id, inst_id, connective, cause, effect, type, degree) of two annotators

SENTENCE = ("doc_id", "sent_id")


def _ordered(side: DataFrame, first: str, second: str) -> DataFrame:
    """Instances with the key and ordinal they are matched by: equal connectives in the order of their arguments' starts."""
    start = lambda c: F.coalesce(F.element_at(F.array_sort(c), 1), F.lit(0))
    conn = F.array_sort("connective")
    w = Window.partitionBy(*SENTENCE, conn).orderBy(start(first), start(second), "inst_id")
    return side.withColumn("connective", conn).withColumn("nth", F.row_number().over(w))


def match_connectives(gold: DataFrame, predicted: DataFrame, first: str = "cause", second: str = "effect", partial: bool = False, least: float = 0.5) -> DataFrame:
    """Full outer match of instances as structs ``gold`` and ``predicted`` per sentence.

    Exact matches first: the n-th of equal connectives with the n-th. With ``partial``, leftovers are then aligned in order: each
    gold one takes the first free predicted one behind the last taken whose overlap is large enough.
    """
    own = [c for c in gold.columns if c not in SENTENCE]
    g = _ordered(gold, first, second).select(*SENTENCE, "connective", "nth", F.struct(*own).alias("gold"))
    p = _ordered(predicted, first, second).select(*SENTENCE, "connective", "nth", F.struct(*own).alias("predicted"))
    exact = g.join(p, [*SENTENCE, "connective", "nth"], "full").select(*SENTENCE, "gold", "predicted")
    if not partial:
        return exact
    done = exact.filter("gold is not null and predicted is not null")
    rest = exact.filter("gold is null or predicted is null").groupBy(*SENTENCE).agg(F.collect_list("gold").alias("gs"), F.collect_list("predicted").alias("ps"))
    by = lambda s: F.struct(F.array_min(s["connective"]).alias("a"), s.alias("s"))
    sort = lambda c: F.transform(F.array_sort(F.transform(c, by)), lambda x: x["s"])
    rest = rest.select(*SENTENCE, sort("gs").alias("gs"), sort("ps").alias("ps"))

    def align(acc, g):  # acc: (next free predicted, pairs)
        k = F.aggregate(
            F.sequence(F.lit(1), F.size("ps")), F.lit(0),
            lambda best, i: F.when(best > 0, best).when((i > acc["at"]) & partial_span(g["connective"], F.element_at("ps", i)["connective"], least), i).otherwise(best),
        )
        k = F.when(F.size("ps") == 0, 0).otherwise(k)
        return F.struct(F.when(k > 0, k).otherwise(acc["at"]).alias("at"), F.array_append(acc["ks"], k).alias("ks"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ks"))
    rest = rest.withColumn("ks", F.aggregate("gs", start, align, lambda x: x["ks"]))
    taken = rest.select(*SENTENCE, "ps", F.explode(F.arrays_zip("gs", "ks")).alias("z")).select(*SENTENCE, F.col("z.gs").alias("gold"), F.when(F.col("z.ks") > 0, F.element_at("ps", F.greatest(F.col("z.ks"), F.lit(1)))).alias("predicted"))
    free = rest.select(*SENTENCE, F.explode(F.filter("ps", lambda p, i: ~F.array_contains("ks", i + 1))).alias("predicted"))
    empty = gold.sparkSession.createDataFrame([], exact.schema)
    return done.unionByName(taken).unionByName(empty.unionByName(free, allowMissingColumns=True))


def span_result(gold: Column, predicted: Column) -> Column:
    """TP, FP, FN or Mismatch of an argument of a matched pair; null if both sides are empty."""
    g, p = F.coalesce(F.size(gold), F.lit(0)) > 0, F.coalesce(F.size(predicted), F.lit(0)) > 0
    return F.when(g & p, F.when(same_span(gold, predicted), "TP").otherwise("Mismatch")).when(g, "FN").when(p, "FP")


def argument_counts(matches: DataFrame, argument: str, *keys: str, agrees: Column | None = None) -> DataFrame:
    """Connective and argument counts and the mean overlap, per key.

    fp and fn of an argument include those of the connectives, and a mismatch counts as both. agrees replaces span equality.
    """
    both = F.col("gold").isNotNull() & F.col("predicted").isNotNull()
    r = span_result(F.col(f"gold.{argument}"), F.col(f"predicted.{argument}"))
    if agrees is not None:
        r = F.when((r == "Mismatch") & agrees, "TP").otherwise(r)
    rows = matches.select(*keys, both.alias("both"), F.col("gold").isNotNull().alias("g"), F.when(both, r).alias("r"), F.when(both, jaccard(f"gold.{argument}", f"predicted.{argument}")).alias("j"))
    n = rows.groupBy(*keys).agg(
        F.count_if("both").alias("c_tp"), F.count_if(~F.col("g")).alias("c_fp"), F.count_if(F.col("g") & ~F.col("both")).alias("c_fn"),
        F.count_if(F.col("r") == "TP").alias("tp"), F.count_if(F.col("r").isin("FP", "Mismatch")).alias("x_fp"), F.count_if(F.col("r").isin("FN", "Mismatch")).alias("x_fn"), F.avg("j").alias("jaccard"),
    )
    return n.select(*keys, "c_tp", "c_fp", "c_fn", "tp", (F.col("c_fp") + F.col("x_fp")).alias("fp"), (F.col("c_fn") + F.col("x_fn")).alias("fn"), "jaccard")


def with_both_arguments(gold: DataFrame) -> DataFrame:
    """Gold instances that have both arguments."""
    return gold.filter((F.size("cause") > 0) & (F.size("effect") > 0))


def by_ids(rows: DataFrame, ids: Sequence[str], given: bool) -> DataFrame:
    """Instances whose id is among the given ones, or is not."""
    hit = F.col("inst_id").isin(list(ids)) if ids else F.lit(False)
    return rows.filter(hit if given else ~hit)


def without_connectives(counts: DataFrame) -> DataFrame:
    """Connective counts of a subset by ids mean nothing, as the other side's ids are others: they are null."""
    return counts.withColumns({c: F.lit(None).cast("long") for c in ("c_tp", "c_fp", "c_fn")})


def latex_row(values: Sequence[str | Column], digits: int = 3) -> Column:
    """Numbers as a row of a LaTeX table."""
    return F.concat(F.array_join(F.array(*[F.format_string(f"%.{digits}f", F.round(v, digits)) for v in values]), " & "), F.lit(r" \\"))
