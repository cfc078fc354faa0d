"""Connective counts over a stream of documents, the one analytic that is useful while texts arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.operators.tokens import CONNECTIVES, tokens


def document_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(text, arrived) of the files that appear in a folder, each a document."""
    lines = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.col("value").alias("text"), F.current_timestamp().alias("arrived"))


def connective_counts(docs: DataFrame, window: str = "10 minutes", late: str = "1 hour", words: Sequence[str] = CONNECTIVES) -> DataFrame:
    """Counts by word in tumbling windows of ``arrived``; rows later than the watermark are dropped and state is bounded by it."""
    t = tokens(docs, "arrived").filter(F.col("word").isin(list(words))).withWatermark("arrived", late)
    return t.groupBy(F.window("arrived", window).alias("window"), "word").agg(F.count("*").alias("n"))
