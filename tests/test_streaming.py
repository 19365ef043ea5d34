"""The streaming extension gives the batch result over a bounded stream."""

from pyspark.sql import functions as F

from trackwise.streaming.islands import windowed_metrics

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    out = windowed_metrics(stream, "ts", ["event_type"], "value", "1 day", late="0 seconds")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.win_start, r.event_type): r.n for r in spark.sql("select * from windows").collect()}
    want = {(r.win_start, r.event_type): r.n for r in windowed_metrics(batch, "ts", ["event_type"], "value", "1 day").collect()}
    assert got == want
