"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on vertex keys, written to the shared folder; the number of rounds grows with the
logarithm of the longest path. Nothing is collected but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestar.llm.common import dealt_anew, stage


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(dealt_anew(least, "u"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(dealt_anew(least, "u"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of (a, b) rows but the least of each component, which names it. Loops and repeated edges are fine."""
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("v"), F.col("v").alias("component"))
        seen, now = mark, stage(_star(now), "edges")
