"""Sinks that fail at any point and are started again: each row is there once."""

import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from halyard.script.runner import Runner
from halyard.streaming import exactly_once as X
from halyard.streaming import sinks


@pytest.fixture
def ledger(spark, tmp_path):
    return X.Ledger(spark, str(tmp_path / "ledger"))


def batch(spark, n, first=0):
    return spark.range(first, first + n).select("id", F.concat(F.lit("d "), F.col("id") % 3).alias("dt")).repartition(2)


def test_files_once(spark, ledger, tmp_path):
    path = str(tmp_path / "out")
    sink = X.OnceFiles(path, ledger, partition=["dt"])
    for _ in range(3):  # replayed
        assert sink(batch(spark, 9), 0) == ["dt=d 0", "dt=d 1", "dt=d 2"]
    sink(batch(spark, 3, 9), 1)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(12))
    empty = X.OnceFiles(str(tmp_path / "none"), ledger)
    assert empty(batch(spark, 0), 0) == []


@pytest.mark.parametrize("after", [0, 1, 2])
def test_files_fail_between_moves(spark, ledger, tmp_path, monkeypatch, after):
    """A try that has moved some of its files is finished by the next, though that one's rows come in other files."""
    path, moved = str(tmp_path / "out"), []
    sink = X.OnceFiles(path, ledger, partition=["dt"])
    move = sink._moved

    def broken(source, target):
        if len(moved) == after:
            raise OSError("gone")
        moved.append(target)
        move(source, target)

    monkeypatch.setattr(sink, "_moved", broken)
    with pytest.raises(OSError):
        sink(batch(spark, 9), 4)
    again = X.OnceFiles(path, X.Ledger(spark, ledger.folder), partition=["dt"])
    again(batch(spark, 9).repartition(5), 4)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(9))


def test_files_fail_while_writing(spark, ledger, tmp_path):
    path = str(tmp_path / "out")
    sink = X.OnceFiles(path, ledger)
    bad = batch(spark, 9).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="no"):
        sink(bad, 0)
    sink(batch(spark, 9).withColumn("x", F.lit(1)), 0)
    assert spark.read.parquet(path).count() == 9


def test_ledger_keeps_the_last(spark, tmp_path):
    ledger = X.Ledger(spark, str(tmp_path / "l"), keep=2)
    for k in range(5):
        ledger.planned("s/1", k, {"moves": []})
        ledger.finish("s/1", k)
    assert [k for k in range(5) if ledger.done("s/1", k)] == [3, 4] and ledger.plan("s/1", 4) == {"moves": []}
    assert not ledger.done("s_1", 4)


@pytest.fixture
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    spark.range(0).select(F.lit("x").alias("a")).write.mode("append").jdbc(url, "warm_up")
    return url


def test_database_once(spark, database, monkeypatch):
    rows = lambda: sorted(r["id"] for r in spark.read.jdbc(database, "given").collect())
    sink = X.OnceJdbc(database, "given", "q")
    sink(batch(spark, 5), 0)
    sink(batch(spark, 5), 0)
    assert rows() == list(range(5))
    run = sink._run

    def broken(connection, *statements):
        if any("INSERT" in s for s in statements):
            run(connection, statements[0])  # the rows are in, their entry isn't
            raise OSError("gone")
        run(connection, *statements)

    monkeypatch.setattr(sink, "_run", broken)
    with pytest.raises(OSError):
        sink(batch(spark, 5, 5), 1)
    assert rows() == list(range(5))
    X.OnceJdbc(database, "given", "q")(batch(spark, 5, 5), 1)
    X.OnceJdbc(database, "given", "other query")(batch(spark, 1, 99), 1)
    assert rows() == [*range(10), 99]


def test_stream_with_two_sinks(spark, database, tmp_path):
    """Files, then a database; the query dies between them in each micro-batch, and after the second in one."""
    for k in range(3):
        batch(spark, 10, 10 * k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ledger, tries = X.Ledger(spark, str(tmp_path / "ledger")), Counter()
    files, table = X.OnceFiles(str(tmp_path / "out"), ledger, partition=["dt"]), X.OnceJdbc(database, "given", "q")

    def dies(at):
        def step(df, batch_id):
            tries[at, batch_id] += 1
            if tries[at, batch_id] == 1 and (at == "between" or batch_id == 1):
                raise OSError(at)

        return step

    each = sinks.fan_out([files, dies("between"), table, dies("after")])
    stream = spark.readStream.schema("id long, dt string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sinks.supervised(lambda: stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start(), 10, 0)
    assert tries["between", 1] == 3
    for got in (spark.read.parquet(str(tmp_path / "out")), spark.read.jdbc(database, "given")):
        assert sorted(r["id"] for r in got.collect()) == list(range(30))


def test_statement_set_once(spark, tmp_path, monkeypatch):
    """A script's statement set over a stream: a committing table, a plain stored one and a print; it fails in the last and is started again."""
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).select("id", (F.timestamp_seconds(1704067200 + 3600 * F.col("id"))).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = f"o{uuid.uuid4().hex}"
    failed = []

    def sink(self, table):
        def write(df, batch_id):
            if batch_id not in failed:
                failed.append(batch_id)
                raise OSError("down")
            df.collect()

        return write

    monkeypatch.setattr(Runner, "_sink", sink)
    r = Runner(spark, {"t": name, "in": str(tmp_path / "in")}, True, str(tmp_path / "chk"), warehouse=str(tmp_path / "w"))
    r.run("""CREATE TABLE ${t}_src (id BIGINT, ts TIMESTAMP, WATERMARK FOR ts AS ts - INTERVAL '5' SECOND) WITH ('connector'='filesystem', 'path'='${in}', 'format'='parquet');
CREATE TABLE ${t}_p (x INT) WITH ('connector'='print');
SET table.sql-dialect=hive;
CREATE TABLE ${t}_a (id BIGINT) PARTITIONED BY (dt STRING) STORED AS parquet TBLPROPERTIES ('sink.partition-commit.trigger'='partition-time');
CREATE TABLE ${t}_b (id INT, w STRING) PARTITIONED BY (h STRING) STORED AS orc;
BEGIN STATEMENT SET;
INSERT INTO ${t}_a SELECT id, DATE_FORMAT(ts, 'yyyy-MM-dd') FROM ${t}_src;
INSERT INTO ${t}_b SELECT id, concat('w', id), concat('h ', id % 2) FROM ${t}_src;
INSERT INTO ${t}_p SELECT id FROM ${t}_src;
END;""")
    r.wait(5, 0)
    assert failed
    assert sorted(x["id"] for x in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "w" / f"{name}_a")).collect()) == list(range(20))
    assert sorted((x["id"], x["w"], x["h"]) for x in spark.table(f"{name}_b").collect()) == sorted((k, f"w{k}", f"h {k % 2}") for k in range(20))
