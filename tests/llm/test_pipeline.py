"""The pipeline's stages on a small table, against what each must do, and run() as their chain."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from lodestar.llm import nearduplicates, pii
from test_operators import ITEMS, ROWS, SCHEMA, by_id


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS[3:5], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, folder)
        assert got.dtypes == docs.dtypes, name
        got.write.parquet(f"{folder}/{len(out)}.parquet")
        docs = spark.read.parquet(f"{folder}/{len(out)}.parquet")
        out[name] = docs.collect()
    good, single, clean, scrubbed = (out[n] for n in names[:-1])
    assert all(len((r.text or "").split()) >= 20 or r.doc_id for r in good) and len(good) < len(ROWS)
    near = nearduplicates.near_duplicates(spark.read.parquet(f"{folder}/0.parquet"), nearduplicates.STAGE_THRESHOLD, nearduplicates.STAGE_MATCHES)
    comp = {r.id: r.component_id for r in near.collect()}
    assert len(single) == len(set(comp.values()))
    assert 0 < len(clean) < len(single) and {r.doc_id for r in clean} <= {r.doc_id for r in single}
    assert [r.text for r in sorted(scrubbed, key=str)] == [pii.redact(r.text) for r in sorted(clean, key=str)] or {r.text for r in scrubbed} == {pii.redact(r.text) for r in clean}
    assert all(r.n_chars == len(r.text) for r in scrubbed)


def test_run_packs_what_is_left(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/3.parquet").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs}
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
