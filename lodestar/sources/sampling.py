"""Choosing documents: samples up to a budget, without those already chosen; taxonomies without prefixes; news fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.plans.staging import cut


def within_budget(rows: DataFrame, size: str, budget: int, order: Sequence[str | Column], *strata: str, chosen: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Rows in order while the budget isn't spent, so the last may overshoot; per stratum, without keys that are chosen already.

    Order by ``xxhash64(key)`` for a sample that looks random and is the same in every run. A stratum may hold any number of rows: they are
    dealt by range, partial sums per range tell where each begins, and running sums are taken within ranges that begin within the budget.
    Rows are held in a checkpoint meanwhile: choose on (key, size) and join texts afterwards.
    """
    r = rows.join(chosen.select(key), key, "left_anti") if chosen is not None else rows
    own = [F.col(c) for c in rows.columns]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(r.repartitionByRange(n, *strata, *order).select(*own, F.spark_partition_id().alias("_range")))
    sums = dealt.groupBy(*strata, "_range").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.struct(*strata, "_range").alias("_key"), before.alias("_start")).filter(F.col("_start") < budget)
    within = dealt.join(starts, F.struct(*strata, "_range").eqNullSafe(F.col("_key")))
    w = Window.partitionBy(*strata, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return within.withColumn("_before", F.col("_start") + F.coalesce(F.sum(size).over(w), F.lit(0))).filter(F.col("_before") < budget).select(*own)


def without_prefixes(paths: DataFrame, path: str, group: Column) -> DataFrame:
    """Distinct paths that are no prefix of another one of their group. In byte order a prefix stands right before a path it begins."""
    w = Window.partitionBy(group).orderBy(F.encode(path, "UTF-8"))
    p = paths.select(path).distinct().withColumn("_next", F.lead(path).over(w))
    return p.filter(~F.coalesce(F.col("_next").startswith(F.col(path)), F.lit(False))).select(path)


def extract_fields(docs: DataFrame, xml: str, fields: dict[str, str], required: Sequence[str] = (), rejecting: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """XPath fields of well-formed XML, and the rejected documents counted by reason.

    fields: name to path; required ones must have exactly one value; rejecting: reason to a condition over the fields.
    """
    got = docs.select("doc_id", *[F.xpath(xml, F.lit(p)).alias(n) for n, p in fields.items()])
    reason = F.lit(None).cast("string")
    for n in reversed(required):
        reason = F.when(F.size(n) != 1, f"{n}: not one value").otherwise(reason)
    for n, c in (rejecting or {}).items():
        reason = F.when(c, n).otherwise(reason)
    got = got.withColumn("reason", reason)
    return got.filter("reason is null").drop("reason"), got.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
