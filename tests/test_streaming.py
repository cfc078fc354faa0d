from lodestar.streaming import connectives


def test_counts_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("To be with you.\nFrom here to there.")
    s = connectives.connective_counts(connectives.document_stream(spark, f"file://{tmp_path}/in"))
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.word: r.n for r in spark.table("counts").groupBy("word").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"to": 2, "with": 1, "from": 1}
