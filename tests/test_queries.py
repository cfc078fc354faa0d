"""Queries over the driver's tables: each against its SQL in DuckDB, where the tables are present."""

import glob
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__
from lodestar.operators import filtering, tokens
from lodestar.plans import catalog, engine_queries

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, TABLES).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_keep_larger_equals_the_greedy_rule(spark):
    got = {(r.doc_id, r.cand_id) for r in catalog.QUERIES["f_keep_larger"](spark, TABLES).collect()}
    by = {}
    for r in tokens.tokens(spark.read.parquet(f"{TABLES}/documents.parquet"), "doc_id").filter("word in ('as', 'by', 'for', 'from', 'in', 'of', 'that', 'to', 'when', 'with')").collect():
        span = (0, 1) if r.word in ("of", "in") else (-1, 0, 1) if r.word in ("to", "for") else (0, 1, 2, 3)
        by.setdefault(r.doc_id, []).append((r.pos, {r.pos + x for x in span}))
    want = set()
    for d, c in by.items():
        claimed = set()
        for p, t in sorted(c, key=lambda x: (-len(x[1]), x[0])):
            if not t & claimed:
                claimed |= t
                want.add((d, p))
    assert got == want


def test_saturation_fit(spark):
    points = catalog.QUERIES["c_saturation"](spark, TABLES).toPandas()
    x, y = np.log(points["step"] + 1.0), points["seen"].astype(float)
    want = np.polyfit(x, y, 2)
    got = catalog.QUERIES["c_saturation_fit"](spark, TABLES).first()
    assert np.allclose([got.a, got.b, got.c], want, rtol=1e-6)


def test_folds_are_stable(spark):
    a = [r[0] for r in spark.range(100).select(filtering.folds("id", 5)).collect()]
    assert a == [r[0] for r in spark.range(100).select(filtering.folds("id", 5)).collect()] and set(a) == set(range(5))


@pytest.mark.parametrize("name", ["e_heads", "e_expanded_spans", "e_baseline_lexicon", "e_baseline_combined", "e_features", "e_lemma_skipgrams", "e_relations", "e_printed", "e_incoming_labels", "e_argument_lemmas", "e_surface_patterns", "e_tree_patterns", "e_standoff_lines"])
def test_sentences_are_neither_stored_nor_joined(spark, name):
    plan = catalog.QUERIES[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and not re.search(r"Join .*\n(.*\n)*.*MapInArrow", plan)  # no checkpoint, and no join above a parse


def _beside_generated(node):
    """Columns that are copied for each row that an array is taken apart into."""
    own = [{x.name() for x in (c.apply(i) for c in [node.requiredChildOutput()] for i in range(c.size()))}] if node.nodeName() == "Generate" else []
    return own + [x for i in range(node.children().size()) for x in _beside_generated(node.children().apply(i))]


@pytest.mark.parametrize("name", ["e_argument_lemmas", "e_baseline_combined", "e_baseline_lexicon", "e_relations", "e_printed"])
def test_candidates_leave_their_sentence_behind(spark, monkeypatch, name):
    monkeypatch.setattr(engine_queries, "staged", lambda df: df)
    found = _beside_generated(catalog.QUERIES[name](spark, TABLES)._jdf.queryExecution().sparkPlan())
    assert found and not {"tokens", "edges", "depths", "texts"} & set.union(*found)  # else a sentence is copied for each of its candidates


def test_relations_are_marked_once(spark):
    plan = catalog.QUERIES["e_printed"](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "upper" in line for line in plan.splitlines())  # nor to see whether a sentence has rows


def test_pairs_leave_other_sentences_out_of_python(spark):
    plan = catalog.QUERIES["e_baseline_pairs"](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" in plan
