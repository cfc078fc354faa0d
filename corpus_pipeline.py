"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontamination, nearduplicates, packing, pii, quality
from lodestar.llm.common import stage, table

STAGES = [
    ("quality rules", quality.keep),
    ("near-duplicates", nearduplicates.one_of_each),
    ("decontamination", decontamination.clean),
    ("personal data", pii.scrub),
    ("packing", packing.pieces),
]

#: Tokens, links and line counts are not expressed in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
