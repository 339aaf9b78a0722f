from pyspark.sql import functions as F

from orrery.streaming.channels import Channel, bucketed, coalesced, signal


def test_channel_reaches_the_handler(spark, tmp_path):
    channel = Channel(spark, "news", str(tmp_path / "c"), "id long, what string")
    channel.notify(spark.createDataFrame([(1, "a"), (2, "b")], "id long, what string"))
    got, failed = [], []

    def handler(df):
        if not failed:
            failed.append(True)
            raise RuntimeError("once")
        got.extend(sorted(tuple(r) for r in df.collect()))

    signal(channel.listen(), handler, str(tmp_path / "k"), wait=0).awaitTermination()
    assert got == [(1, "a"), (2, "b")]
    signal(channel.listen(), handler, str(tmp_path / "k"), wait=0).awaitTermination()
    assert len(got) == 2


def test_event_time_counts(spark, tmp_path):
    rows = [(k, f"2026-01-01T00:0{k}:00") for k in range(6)]
    spark.createDataFrame(rows, "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "e"))
    q = bucketed(stream, "ts", "2 minutes", "1 minute").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("SELECT n FROM counts ORDER BY start").collect()] == [2, 2, 2]


def test_coalesced(spark):
    assert coalesced(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), "a").count() == 1
