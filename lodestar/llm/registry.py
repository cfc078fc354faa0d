"""The queries of this subpackage, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

MODULES = ("quality", "pii", "packing", "langid", "licenses", "substrings", "suffixes", "nearduplicates", "decontamination", "urlfilter")


def _merged(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"lodestar.llm.{m}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("queries") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _merged("oracle_sql") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
