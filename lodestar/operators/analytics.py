"""Corpus analytics: counts, lengths, entropies, saturation, cross-tabs. Every operator takes and returns DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def count_where(rows: DataFrame, criterion: Column) -> DataFrame:
    """How many rows meet a criterion, as ``n``."""
    return rows.agg(F.count_if(criterion).alias("n"))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, as ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def remap(column: str | Column, mapping: Mapping[str, str], prefix: str = "") -> Column:
    """Rename some values. A value with the prefix loses it and is not renamed otherwise."""
    c = F.col(column) if isinstance(column, str) else column
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    renamed = F.coalesce(F.create_map(*flat)[c], c) if flat else c
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(renamed) if prefix else renamed


def type_sets(rows: DataFrame, span: Sequence[str], type_column: str, exclude: Sequence[str] = ()) -> DataFrame:
    """How many spans have each set of types (sorted, joined by +)."""
    kept = rows.filter(~F.col(type_column).isin(list(exclude))) if exclude else rows
    sets = kept.groupBy(*span).agg(F.array_join(F.sort_array(F.collect_set(type_column)), "+").alias("types"))
    return sets.groupBy("types").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, length: str | Column, last: int) -> DataFrame:
    """Rows by length from 1, everything from ``last`` in the last bin."""
    c = F.col(length) if isinstance(length, str) else length
    return rows.select(F.least(c, F.lit(last)).cast("long").alias("bin")).filter("bin >= 1").groupBy("bin").agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, n: str = "n", *keys: str) -> DataFrame:
    """Shannon entropy in bits of a table of counts, per key.

    ``log2(total) - sum(n log2 n) / total`` needs one aggregation and no join back of totals.
    """
    c = F.col(n).cast("double")
    return counts.filter(F.col(n) > 0).groupBy(*keys).agg((F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)).alias("entropy"))


def binary_entropy(true: Column, possible: Column) -> Column:
    """C11: entropy of the share true / max(true, possible); 0 at the ends."""
    p = true / F.greatest(true, possible)
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log2(p) - (1 - p) * F.log2(1 - p))


def cross_tab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all value pairs with row, column and grand totals; a total's key is ``*``."""
    cubed = rows.cube(a, b).agg(F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"), F.count("*").alias("n"))
    return cubed.select(F.when(F.col("_ga") == 1, "*").otherwise(F.col(a).cast("string")).alias(a), F.when(F.col("_gb") == 1, "*").otherwise(F.col(b).cast("string")).alias(b), "n")


def saturation(first_seen: DataFrame, increments: DataFrame, step: str = "step") -> DataFrame:
    """Distinct items seen up to each increment. first_seen: one row per item with its step; increments: all steps.

    Only counts per step meet in one place, so the running sum is over as many rows as there are increments.
    """
    new = first_seen.groupBy(step).agg(F.count("*").alias("new"))
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return increments.join(new, step, "left").select(step, F.sum(F.coalesce("new", F.lit(0))).over(w).cast("long").alias("seen"))


def fit_log_square(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of ``a ln(x)**2 + b ln(x) + c`` over rows with x > 0, from one aggregation (normal equations, Cramer's rule)."""
    l, v = F.log(F.col(x).cast("double")), F.col(y).cast("double")
    s = points.filter(F.col(x) > 0).agg(*[F.sum(F.pow(l, F.lit(k))).alias(f"s{k}") for k in range(5)], *[F.sum(v * F.pow(l, F.lit(k))).alias(f"t{k}") for k in range(3)])
    c = F.col

    def det(m):
        (a, b, d), (e, f, g), (h, i, j) = m
        return a * (f * j - g * i) - b * (e * j - g * h) + d * (e * i - f * h)

    base = [[c("s4"), c("s3"), c("s2")], [c("s3"), c("s2"), c("s1")], [c("s2"), c("s1"), c("s0")]]
    right = [c("t2"), c("t1"), c("t0")]
    solved = [det([[right[r] if k == col else base[r][k] for k in range(3)] for r in range(3)]) / det(base) for col in range(3)]
    return s.select(solved[0].alias("a"), solved[1].alias("b"), solved[2].alias("c"))


def diversity(rows: DataFrame, key: str, path: str, length: str) -> DataFrame:
    """Per key the entropy of its paths and the population deviation of their lengths."""
    paths = entropy(rows.groupBy(key, path).agg(F.count("*").alias("n")), "n", key)
    return rows.groupBy(key).agg(F.stddev_pop(length).alias("length_std")).join(paths, key)


def per_connective(rows: DataFrame, connective: str, pattern: str) -> DataFrame:
    """C14: distinct patterns and instances per connective."""
    once = rows.groupBy(connective, pattern).agg(F.count("*").alias("k"))
    return once.groupBy(connective).agg(F.count("*").alias("patterns"), F.sum("k").alias("instances"))


def precision_by(rows: DataFrame, key: str, correct: str) -> DataFrame:
    """Share of correct rows per key, best first."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("precision")).orderBy(F.desc("precision"), F.desc("n"), key)


def double_heads(edges: DataFrame, ignored: Sequence[str] = ("ref",)) -> DataFrame:
    """Tokens with more than one parent, ``ref`` edges apart, and at least one child."""
    sent = ["doc_id", "sent_id"]
    many = edges.filter(~F.col("label").isin(list(ignored))).groupBy(*sent, "dep").agg(F.count_distinct("head").alias("parents")).filter("parents > 1")
    heads = edges.select(*sent, F.col("head").alias("dep")).distinct()
    return many.join(heads, [*sent, "dep"], "left_semi")


def runs(rows: DataFrame, index: str, *keys: str, block: int = 1 << 20) -> DataFrame:
    """(keys, first, last, n) of the runs of consecutive distinct integers per key, in two steps so that a key may hold any number of rows.

    Runs are found within blocks of indices; only those that touch a block's border, at most two a block, meet again under their key.
    """
    at = F.col(index).cast("long")

    def islands(df: DataFrame, first: str, last: str, n: str, *by: str) -> DataFrame:
        """Joins rows whose first is the last of the one before plus 1."""
        w = Window.partitionBy(*by).orderBy(first)
        new = F.coalesce(F.col(first) != F.lag(last).over(w) + 1, F.lit(True)).cast("long")
        g = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
        return g.groupBy(*by, "_run").agg(F.min(first).alias("first"), F.max(last).alias("last"), F.sum(n).alias("n")).drop("_run")

    one = rows.select(*keys, (at - F.pmod(at, F.lit(block))).alias("_block"), at.alias("_first"), at.alias("_last"), F.lit(1).cast("long").alias("_n"))
    local = islands(one, "_first", "_last", "_n", *keys, "_block").drop("_block")
    border = (F.pmod("first", F.lit(block)) == 0) | (F.pmod("last", F.lit(block)) == block - 1)
    met = islands(local.filter(border), "first", "last", "n", *keys)
    return local.filter(~border).unionByName(met)
