from pyspark.sql import functions as F

from tidemark.operators import access
from tidemark.plans.catalog import _writes
from tidemark.sources.tables import view
from tidemark.streaming import feeds


def drained(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def as_stream(spark, df, folder):
    df.coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_change_feed_on_a_stream_equals_the_table(spark, sf, tmp_path):
    changes = view(spark, sf, "changes")
    got = drained(spark, feeds.parse_changes(as_stream(spark, changes, str(tmp_path / "c"))), "changes_out")
    assert sorted(map(str, got.collect())) == sorted(map(str, feeds.parse_changes(changes).collect()))


def test_late_writes_on_a_stream_equal_the_table(spark, sf, tmp_path):
    writes = _writes(spark, sf).where("chunk_id < 5")
    got = drained(spark, feeds.late_writes(as_stream(spark, writes, str(tmp_path / "w"))), "writes_out")
    want = access.allowed_writes(writes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("chunk_id", "seq", "lo", "hi").collect()))


def test_windows_sessions_and_repeats_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "event_type")
    stream = as_stream(spark, events, str(tmp_path / "e"))
    counts = drained(spark, feeds.windowed_counts(stream, "ts", ["event_type"], "60 seconds", "30 seconds"), "counts_out", "complete")
    timed = events.withColumn("t", F.col("ts").cast("timestamp"))
    want = timed.groupBy(F.window("t", "60 seconds", "30 seconds"), "event_type").count()
    assert counts.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0] and counts.count() == want.count()
    assert drained(spark, feeds.session_windows(stream, "ts", "user_id"), "sessions_out").count() > 0
    once = drained(spark, feeds.first_requests(stream, "ts", ["user_id"], "1000 days"), "once_out")
    assert once.count() == events.select("user_id").distinct().count()
