from siftwell.operators import feedback
from siftwell.operators.scoring import assess
from siftwell.streaming import jobs


def test_scored_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([(1, "hello"), (2, "BUY CHEAP MEDS NOW CLICK HERE"), (3, None)], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = jobs.scored_stream(stream).select("id", "spam", "slop", "reasons").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = assess(spark.read.parquet(str(tmp_path / "in"))).select("id", "spam", "slop", "reasons")
    assert sorted(map(tuple, spark.table("scored").collect()), key=lambda r: r[0]) == sorted(map(tuple, batch.collect()), key=lambda r: r[0])


def test_vote_log(spark, tmp_path):
    rows = [(k, t, "same text", "spam") for k, t in enumerate("abc")]
    spark.createDataFrame(rows, "seq long, tenant string, text string, verdict string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, tenant string, text string, verdict string").parquet(str(tmp_path / "in"))
    q = jobs.vote_log(stream, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert "text" not in log.columns and feedback.network_scores(log).first().score == 1.0
