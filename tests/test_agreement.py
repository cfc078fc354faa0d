"""Reading annotations, and agreement of two annotators on four sentences."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestar.operators import metrics
from lodestar.sources import parses, standoff

FIXTURES = Path(__file__).parent / "fixtures"


def load(spark, name):
    folder = f"file://{FIXTURES / name}"
    t = standoff.tables(standoff.annotation_lines(spark, folder))
    s = parses.read_sentences(spark, folder)
    i = standoff.instances(t, s)
    return t, s, i.withColumn("doc_id", F.lit("agree")).cache()


@pytest.fixture(scope="module")
def gold(spark):
    return load(spark, "gold")


@pytest.fixture(scope="module")
def modified(spark):
    return load(spark, "modified")


def swapped(df):
    return df.withColumnRenamed("cause", "x").withColumnRenamed("effect", "cause").withColumnRenamed("x", "effect")


def measure(a, b, causal=True):
    a, b = (x.filter("kind = 'causal'").drop("kind") for x in (a, b))
    m = metrics.match_connectives(a, b).cache()
    c, e = (metrics.argument_counts(m, k).first() for k in ("cause", "effect"))
    return (c.c_tp, c.c_fp, c.c_fn), (c.tp, c.fp, c.fn), (e.tp, e.fp, e.fn), c.jaccard, e.jaccard


def test_sentences(gold):
    s = {r.sent_id: r for r in gold[1].collect()}
    assert len(s) == 4 and [len(s[i].tokens) for i in range(4)] == [18, 16, 28, 7]
    assert s[3].text == "To cause harm is bad." and s[3].tokens[2].lemma == "cause" and len(s[3].nodes) > 10 and not s[0].nodes
    assert sum(len(r.edges) for r in s.values()) == 58


def test_instances(gold):
    t, _, i = gold
    rows = {r.inst_id: r for r in i.filter("kind = 'causal'").collect()}
    assert set(rows) == {f"E{k}" for k in range(1, 8)}
    assert rows["E7"].cause is None and rows["E7"].effect == [3] and rows["E4"].effect == [5, 6, 7, 14, 15] and rows["E4"].causal_type == "Inference"
    assert rows["E1"].degree == "Inhibit" and rows["E5"].degree == "Facilitate"
    clone = i.filter("kind = 'overlapping'").collect()
    assert [(r.inst_id, r.overlap_types, r.attached_inst_id) for r in clone] == [("E5+", ["Hypothetical"], "E5")]
    assert t["warnings"].count() == 0 and [r.ann_id for r in standoff.unused_arguments(t).collect()] == []


def test_same_annotations(gold):
    assert measure(gold[2], gold[2]) == ((7, 0, 0), (6, 0, 0), (7, 0, 0), 1.0, 1.0)
    assert measure(swapped(gold[2]), swapped(gold[2])) == ((7, 0, 0), (7, 0, 0), (6, 0, 0), 1.0, 1.0)


def test_modified_annotations(gold, modified):
    got = measure(gold[2], modified[2])
    assert got[:3] == ((5, 2, 2), (2, 3, 4), (4, 3, 3)) and got[3] == pytest.approx(0.6) and got[4] == pytest.approx(33 / 35)
    got = measure(swapped(gold[2]), swapped(modified[2]))
    assert got[:3] == ((5, 2, 2), (4, 3, 3), (2, 3, 4)) and got[3] == pytest.approx(33 / 35) and got[4] == pytest.approx(0.6)


def test_partial_matching_takes_the_added_fragment(gold, modified):
    a, b = (x.filter("kind = 'causal'").drop("kind") for x in (gold[2], modified[2]))
    m = metrics.match_connectives(a, b, partial=True, least=0.4)
    r = metrics.argument_counts(m, "cause").first()
    assert (r.c_tp, r.c_fp, r.c_fn) == (6, 1, 1)
    r = metrics.argument_counts(metrics.match_connectives(a, b, partial=True, least=0.5), "cause").first()
    assert (r.c_tp, r.c_fp, r.c_fn) == (5, 2, 2)  # exactly half is no match


def test_sums_and_averages(spark):
    one = spark.createDataFrame([(5, 2, 2), (7, 0, 0)], "tp long, fp long, fn long")
    s = metrics.micro(one).first()
    assert (s.tp, s.fp, s.fn) == (12, 2, 2) and s.f1 == pytest.approx(24 / 28)
    m = metrics.macro(one).first()
    assert (m.tp, m.fp, m.fn) == (6, 1, 1) and m.precision == pytest.approx((5 / 7 + 1) / 2)
    j = spark.createDataFrame([(0.3, 5), (0.6, 5), (None, 4), (float("nan"), 2)], "j double, n long").agg(metrics.weighted_mean(F.col("j"), F.col("n")).alias("j")).first()
    assert j.j == pytest.approx(0.45)


def test_agreement_tables(gold, modified):
    a, b = (x.filter("kind = 'causal'").drop("kind") for x in (gold[2], modified[2]))
    m = metrics.match_connectives(a, b).filter("gold is not null and predicted is not null").select(F.col("gold.causal_type").alias("g"), F.col("predicted.causal_type").alias("p"))
    k = metrics.kappa(metrics.confusion(m, "g", "p")).first()
    assert (k.n, k.accuracy, k.kappa) == (5, 1.0, 1.0)


def test_reader_warnings(spark):
    lines = ["T1\tArgument 0 3\tabc", "T2\tArgument 0 x\tabc", "T3\tArgument 0 3", "E1\tConsequence:T9 Cause:T1", "E2\tStrange:T1 Cause:T1", "E3\tConsequence:T1", "A1\tDegree E7 Facilitate", "A2\tDegree E1 Odd", "A3\tTemporal E1", "#1\tNote T1\tx", "X1\tfoo", "A4\tCreation-termination E1", "T5\tNote 1 2;3 4\tb d"]
    t = standoff.tables(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc_id string, line_no int, line string"))
    got = sorted((r.line_no, r.reason) for r in t["warnings"].collect())
    assert got == [(1, "malformed span"), (2, "malformed span"), (3, "undefined id"), (4, "unknown event type"), (5, "malformed event"), (6, "undefined id"), (7, "invalid attribute"), (10, "unknown line")]
    assert [len(r.frags) for r in t["spans"].orderBy("ann_id").collect()] == [1, 2] and t["attributes"].count() == 3


def test_writing_and_reading_again(spark, gold):
    t, s, _ = gold
    i = standoff.instances(t, s)
    texts = parses.files(spark, f"file://{FIXTURES / 'gold'}", "*.txt").withColumnRenamed("content", "text")
    lines = standoff.standoff_lines(i.filter("kind = 'causal'"), s, texts).cache()
    again = standoff.instances(standoff.tables(lines), s)
    key = lambda df: sorted((r.sent_id, r.connective, r.cause, r.effect, r.causal_type, r.degree or "") for r in df.filter("kind = 'causal'").collect())
    norm = lambda rows: sorted(((a, tuple(b), tuple(c or ()), tuple(d or ()), e, f) for a, b, c, d, e, f in rows))
    assert norm([(r.sent_id, r.connective, r.cause, r.effect, r.causal_type, r.degree or "") for r in again.collect()]) == norm([(r.sent_id, r.connective, r.cause, r.effect, r.causal_type, r.degree or "") for r in i.filter("kind = 'causal'").collect()])
    shared = [r.line for r in lines.collect() if "\ta careful board" in r.line and "not only" not in r.line and "useful" not in r.line]
    assert len(shared) == 1


def test_bisected_tokens_and_failed_parses(spark):
    d = spark.createDataFrame([("d", "Smokestacks harm birds. Odd one here.", "Smokestacks harm birds .\n\nsmokestack/NNS harm/VBP bird/NNS ./.\n\nnsubj(harm-2, Smokestacks-1)\nroot(ROOT-0, harm-2)\n\nOdd one here .\n\n(())\n\n")], "doc_id string, text string, parse string")
    s = parses.parse_texts(d)
    rows = {r.sent_id: r for r in s.collect()}
    assert len(rows) == 2 and not rows[1].edges and rows[1].tokens[1].text == "Odd"
    spans = spark.createDataFrame([("d", "T1", [(5, 13)]), ("d", "T2", [(12, 13)]), ("d", "T3", [(24, 27)]), ("d", "T4", [(11, 12)])], "doc_id string, ann_id string, frags array<struct<start:int,end:int>>")
    got = {r.ann_id: (r.sent_id, r.tokens) for r in standoff.locate(spans, s).collect()}
    assert got == {"T1": (0, [1, 2]), "T2": (0, [2]), "T3": (1, [1]), "T4": (0, [1])}


def test_trimming_rebases_offsets(gold):
    r = {x.sent_id: x for x in standoff.trimmed(gold[1], 2, 3).collect()}
    assert set(r) == {0, 1} and r[0].start == 0 and r[0].tokens[1].start == 0 and r[1].text == "To cause harm is bad."
