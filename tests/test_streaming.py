from millrace.operators import metrics
from millrace.streaming.leases import lease_stream
from millrace.streaming.spikes import spike_stream

SAMPLE = "run_id string, seq long, step long, loss double, shard_id string"


def drain(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def test_spike_stream_is_the_batch(spark, tmp_path):
    rows = [("r", k, k, 1.0 if k % 7 else 10.0, "s") for k in range(1, 40)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows[:20], SAMPLE).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(rows[20:], SAMPLE).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SAMPLE).parquet(path)
    got = {(r.seq, r.page) for r in drain(spark, spike_stream(stream, 5, 0.5), "spikes")}
    batch = spark.createDataFrame(rows, SAMPLE)
    assert got == {(r.seq, r.page) for r in metrics.pages(metrics.spikes(batch, 5, 0.5)).collect()}


def test_lease_stream_fences(spark, tmp_path):
    rows = [("t", 1, "enqueued", "", 0), ("t", 2, "claimed", "a", 0), ("t", 3, "completed", "b", 1), ("t", 4, "expired", "", 0), ("t", 5, "claimed", "b", 0), ("t", 6, "heartbeat", "a", 1), ("t", 7, "completed", "b", 2)]
    path = str(tmp_path / "in")
    schema = "task_id string, seq long, kind string, worker string, attempt long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    got = sorted((r.seq, r.state, r.accepted) for r in drain(spark, lease_stream(spark.readStream.schema(schema).parquet(path)), "leases"))
    assert got == [(1, "waiting", True), (2, "leased", True), (3, "leased", False), (4, "waiting", True), (5, "leased", True), (6, "leased", False), (7, "completed", True)]
