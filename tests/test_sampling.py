from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources import sampling


def test_budget_may_overshoot_and_skips_chosen(spark):
    d = spark.createDataFrame([(i, 10) for i in range(6)], "doc_id long, n long")
    assert sorted(r.doc_id for r in sampling.within_budget(d, "n", 25, ["doc_id"]).collect()) == [0, 1, 2]
    assert sorted(r.doc_id for r in sampling.within_budget(d, "n", 25, ["doc_id"], chosen=d.filter("doc_id < 2")).collect()) == [2, 3, 4]


def test_budget_over_ranges_equals_the_running_sum(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "b", (i * 37) % 501, i % 11 if i % 13 else None) for i in range(500)]
    d = spark.createDataFrame(rows, "s string, doc_id long, n long")
    for budget in (0, 40, 700, 10**6):
        want = set()
        for key in {r[0] for r in rows}:
            spent = 0
            for _, i, n in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1]):
                if spent < budget:
                    want.add(i)
                spent += n or 0
        got = [r.doc_id for r in sampling.within_budget(d, "n", budget, [F.desc("doc_id")], "s").collect()]
        assert len(got) == len(want) and set(got) == want


def test_prefixes(spark):
    d = spark.createDataFrame([("a/b",), ("a/b/c",), ("a/bc",), ("b",), ("b",)], "p string")
    assert {r.p for r in sampling.without_prefixes(d, "p", F.substring("p", 1, 1)).collect()} == {"a/b/c", "a/bc", "b"}


def test_xml_fields_and_reasons(spark):
    d = spark.createDataFrame([(1, "<n><t>x</t><k>World</k></n>"), (2, "<n><k>World</k></n>"), (3, "<n><t>x</t><k>Sports</k></n>")], "doc_id long, x string")
    got, why = sampling.extract_fields(d, "x", {"t": "/n/t/text()", "k": "/n/k/text()"}, ["t"], {"section": F.array_contains("k", "Sports")})
    assert [r.doc_id for r in got.collect()] == [1] and {r.reason: r.n for r in why.collect()} == {"t: not one value": 1, "section": 1}


def test_quotes_and_cleanup(spark):
    one = lambda t, *c: spark.createDataFrame([(t,)], "t string").select(*c).first()[0]
    assert one('"Hi" he said ("so"), "no",\n"yes"', text.rewrite("t", text.QUOTE_RULES)) == "``Hi'' he said (``so''), ``no'',\n``yes''"
    report = "Well \\12\\ so.....then . . . ok\nQ.12. What? A.3. That\nI was--\nTHE HOUSE, OF\nMr. Smith:\nthe end.The Next One\n   A P P E N D I X\nrest"
    want = "Well   so then ...  ok\n. What?   That\nI was--.\n\nTHE HOUSE, OF.\nMr. Smith.\nthe end.\n\nThe Next One.\n"
    assert one(report, text.rewrite(text.before_appendix("t"), text.CLEANUP_RULES)) == want
    assert one("x", text.shift_by_quotes(F.lit('a"b"c'), F.lit(4))) == 6
