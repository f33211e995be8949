"""Streams replayed in several micro-batches against their batch forms."""

import time

import pytest
from pyspark.sql import functions as F

from halyard.operators import batch as B
from halyard.queries import odometer
from halyard.streaming import sinks, stateful


def replay(spark, df, folder, parts, order, build, mode="append", name="out"):
    """Writes df as ordered files, a micro-batch each, and returns what the stream gave."""
    rows = df.orderBy(*order).toPandas()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("parts", [1, 3])
def test_delta_trigger(spark, tmp_path, parts):
    df = odometer(spark, "/root/testdata/sf0.001").filter("user_id < 8")
    got = replay(spark, df, tmp_path, parts, ["ts", "event_id"], lambda s: stateful.delta_trigger_stream(s, "user_id", "path", ["ts", "event_id"]), name=f"delta{parts}")
    want = B.delta_trigger(df, "user_id", "path", ["ts", "event_id"]).select("user_id", "n", "firing")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count()


def test_count_trigger(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    got = replay(spark, df, tmp_path, 3, ["ts", "event_id"], lambda s: stateful.count_trigger_stream(s.withWatermark("ts", "2 days"), "event_type", "ts", "1 day"), name="counts")
    want = B.count_trigger(df, "event_type", "ts", ["ts", "event_id"], "1 day").select("event_type", F.col("window_start").cast("timestamp"), "total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_processing_time_counts(spark, tmp_path):
    spark.range(12).select(F.lit("w").alias("word")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.count_trigger_stream(spark.readStream.schema("word string").parquet(str(tmp_path / "in")), "word", None, "1 hour")
    # Processing-time timers keep asking for another batch, so the query never is idle and is stopped.
    q = stream.writeStream.format("memory").queryName("pcounts").option("checkpointLocation", str(tmp_path / "chk")).trigger(processingTime="1 second").start()
    until = time.time() + 40
    while spark.table("pcounts").count() < 2 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert sorted(r["total"] for r in spark.table("pcounts").collect()) == [5, 10]


def test_top2_changes(spark, tmp_path):
    df = spark.createDataFrame([(k, "a", v) for k, v in enumerate((5, 3, 5, 9))], "k int, key string, v int")
    got = replay(spark, df, tmp_path, 4, ["k"], lambda s: stateful.top2_changes(s, "key", "v"), name="tops")
    state = {}
    for r in got.collect():
        if r["op"] == "-":
            assert state.pop(r["rank"]) == r["value"]
        else:
            state[r["rank"]] = r["value"]
    assert state == {1: 9.0, 2: 5.0}


def test_keep_last_and_late_rows(spark, tmp_path):
    df = spark.createDataFrame([(k, "a", f"2024-01-01 00:{m:02d}:00") for k, m in enumerate((0, 30, 1, 59))], "k int, key string, at string").withColumn("ts", F.to_timestamp("at"))
    got = replay(spark, df.select("k", "key", "ts"), tmp_path, 4, ["k"], lambda s: stateful.keep_last_stream(s, "key", ["ts"]), "update", "lasts")
    assert got.orderBy(F.desc("ts")).first()["k"] == 3
    (tmp_path / "w").mkdir()
    ok = replay(spark, df.select("k", "key", "ts"), tmp_path / "w", 4, ["k"], lambda s: stateful.per_window(s, "ts", "5 minutes", ["key"]), "append", "oks")
    assert {r["result"] for r in ok.collect()} == {"ok"}
    assert 1 <= ok.count() <= 3


def test_partition_commit(spark, tmp_path):
    sink = sinks.PartitionCommit(str(tmp_path), partition="dt", delay_s=3600)
    rows = lambda *ts: spark.createDataFrame([(t, t[:10]) for t in ts], "t string, dt string").select(F.to_timestamp("t").alias("ts"), "dt")
    at = lambda hour: 1704067200 + 3600 * hour
    sink(rows("2024-01-01 10:00:00", "2024-01-02 00:30:00"), 0, at(24.5))
    assert not (tmp_path / "dt=2024-01-01/_SUCCESS").exists()
    sink(rows("2024-01-02 01:00:00"), 1, at(25))
    assert (tmp_path / "dt=2024-01-01/_SUCCESS").exists() and not (tmp_path / "dt=2024-01-02/_SUCCESS").exists()
    sink(rows("2024-01-02 01:00:00").filter("false"), 2, None)
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_retries_and_fan_out(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")

    sinks.retrying(flaky, 3, 0)
    assert len(calls) == 3
    with pytest.raises(ZeroDivisionError):
        sinks.retrying(lambda: 1 / 0, 1, 0)
    seen = []
    sinks.fan_out([lambda b, i: seen.append(b.count()), lambda b, i: seen.append(i)])(spark.range(4), 7)
    assert seen == [4, 7]

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 6:
                raise RuntimeError

    sinks.supervised(Query, 10, 0)
    assert len(calls) == 6


def test_map_state(spark, tmp_path):
    from halyard.streaming.mapstate import use_map_state, value_counts_stream

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_map_state(spark)
    try:
        df = spark.createDataFrame([(k, "ab"[k % 2], str(k % 5) if k % 7 else None) for k in range(60)], "k int, key string, v string")
        got = replay(spark, df, tmp_path, 3, ["k"], lambda s: value_counts_stream(s, "key", "v"), "update", "value_counts")
        last = got.groupBy("key", "v").agg(F.max("n").alias("n"))
        want = df.filter("v is not null").groupBy("key", "v").agg(F.count("*").alias("n"))
        assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
        assert got.count() > last.count()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
