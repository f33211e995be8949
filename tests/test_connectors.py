"""Sources and sinks that need another side: a socket, a database (the Derby that Spark brings), text files."""

import socket
import threading
import time
import uuid

import pytest

from halyard.functions import expressions as X
from halyard.script.ddl import parse_create
from halyard.script.runner import Runner
from halyard.sources.connectors import parse_json, read_table, text_lines
from pyspark.sql import functions as F


@pytest.fixture
def database(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    spark.range(0).select(F.lit("x").alias("a")).write.mode("append").jdbc(url, "warm_up")
    return url


def test_database_sink_and_source(spark, database):
    r = Runner(spark)
    r.run(f"""CREATE TABLE sink_t (id BIGINT, word STRING) WITH ('connector'='clickhouse', 'url'='{database}', 'table-name'='words', 'sink.batch-size'='3', 'sink.flush-interval'='30000', 'sink.max-retries'='3', 'use-local'='true');
INSERT INTO sink_t SELECT id, concat('w', id) FROM range(10);
INSERT INTO sink_t (word, id) SELECT 'more', 99;
CREATE TABLE back (id BIGINT, word STRING) WITH ('connector'='jdbc', 'url'='{database}', 'table-name'='words');
CREATE TABLE parts (id BIGINT, word STRING) WITH ('connector'='jdbc', 'url'='{database}', 'table-name'='words', 'scan.partition.column'='"id"', 'scan.partition.lower-bound'='0', 'scan.partition.upper-bound'='100', 'scan.partition.num'='4');
""")
    want = sorted([*((k, f"w{k}") for k in range(10)), (99, "more")])
    assert sorted(map(tuple, spark.table("back").collect())) == want
    assert sorted(map(tuple, spark.table("parts").collect())) == want
    assert spark.table("parts").rdd.getNumPartitions() == 4


def test_stream_into_a_database(spark, database, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "w": "x"}\n{"id": 2, "w": "y"}\n')
    r = Runner(spark, streaming=True, checkpoints=str(tmp_path / "chk"))
    r.run(f"""CREATE TABLE js (id BIGINT, w STRING) WITH ('connector'='filesystem', 'path'='{tmp_path}/in', 'format'='json');
CREATE TABLE sink_one (id BIGINT, w STRING) WITH ('connector'='clickhouse', 'url'='{database}', 'table-name'='ones');
CREATE TABLE sink_two (w STRING) WITH ('connector'='clickhouse', 'url'='{database}', 'table-name'='twos');
CREATE TABLE shown (w STRING) WITH ('connector'='print');
BEGIN STATEMENT SET;
INSERT INTO sink_one SELECT id, w FROM js;
INSERT INTO sink_two SELECT concat(w, '!') FROM js WHERE id > 1;
INSERT INTO shown SELECT w FROM js;
END;
""")
    r.wait(0)
    assert len(r.queries) == 1
    assert sorted(map(tuple, spark.read.jdbc(database, "ones").collect())) == [(1, "x"), (2, "y")]
    assert [x[0] for x in spark.read.jdbc(database, "twos").collect()] == ["y!"]


def test_socket_source(spark, tmp_path):
    """Words by spaces from a socket, counted as they come."""
    server = socket.create_server(("127.0.0.1", 0))
    stop = threading.Event()

    def serve():
        peer, _ = server.accept()
        with peer:
            peer.sendall(b"a b  c \na b\n")
            stop.wait(60)

    threading.Thread(target=serve, daemon=True).start()
    table = parse_create(f"CREATE TABLE lines (value STRING) WITH ('connector'='socket', 'hostname'='127.0.0.1', 'port'='{server.getsockname()[1]}')")
    words = read_table(spark, table, True).select(F.explode(X.words_by_space(F.col("value"))).alias("word")).groupBy("word").count()
    q = words.writeStream.format("memory").queryName("socket_words").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    until = time.time() + 60
    while spark.table("socket_words").count() < 4 and time.time() < until:
        time.sleep(0.3)
    q.stop()
    stop.set()
    server.close()
    assert {r["word"]: r["count"] for r in spark.table("socket_words").collect()} == {"a": 2, "b": 2, "": 1, "c": 1}


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hi, there! hi\n")
    count = lambda df: {r["w"]: r["count"] for r in df.select(F.explode(X.word_tokens(F.col("value"))).alias("w")).groupBy("w").count().collect()}
    assert count(text_lines(spark, str(tmp_path / "in"))) == {"hi": 2, "there": 1}
    q = text_lines(spark, str(tmp_path / "in"), True).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert count(spark.table("texts")) == {"hi": 2, "there": 1}


def test_strict_and_lenient_json(spark):
    table = parse_create("CREATE TABLE t (id INT, m MAP<STRING, STRING>) WITH ('connector'='kafka')")
    raw = spark.createDataFrame([('{"id": 1, "m": {"k": "v"}}',), ("junk",), ('{"id": "x"}',)], "value string")
    got = parse_json(raw, table, True).collect()
    assert [(r["id"], r["m"]) for r in got] == [(1, {"k": "v"}), (None, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        parse_json(raw, table, False).collect()


def run_lines(spark, stream, tmp_path, name, group=None):
    from halyard.sources.lines import keep_place

    q = stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    if group:
        keep_place(q, str(tmp_path / "in"), group)
    return sorted(r[0] for r in spark.read.schema(stream.schema).parquet(str(tmp_path / f"{name}-out")).collect())


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_lines_of_growing_files(spark, tmp_path, chunk):
    """Ranges of any size; an unfinished line waits; each query goes on from its checkpoint, a group from its last query's place."""
    from halyard.sources.lines import lines_stream

    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.json").write_bytes("one\ntwo é\r\n\nfo".encode())
    (folder / "sub" / "b.json").write_bytes(b"x" * 30 + b"\n")
    (folder / "_hidden").write_bytes(b"no\n")
    (folder / "empty").write_bytes(b"")
    of = lambda mode, group=None: lines_stream(spark, str(folder), mode, group, chunk)
    first = ["", "one", "two é", "x" * 30]
    assert run_lines(spark, of("earliest-offset"), tmp_path, "early") == first
    assert run_lines(spark, of("latest-offset"), tmp_path, "late") == []
    assert run_lines(spark, of("group-offsets", "g"), tmp_path, "g1", "g") == first
    with (folder / "a.json").open("ab") as f:
        f.write(b"ur\nfive\n")
    (folder / "c.json").write_bytes(b"six\n")
    more = ["five", "four", "six"]
    assert run_lines(spark, of("earliest-offset"), tmp_path, "early") == sorted([*first, *more])
    assert run_lines(spark, of("latest-offset"), tmp_path, "late") == more
    assert run_lines(spark, of("group-offsets", "g"), tmp_path, "g2") == more
    assert run_lines(spark, of("group-offsets", "other"), tmp_path, "g3") == sorted([*first, *more])


def test_startup_modes_of_a_script(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("".join(f'{{"id": {k}, "ts": "2024-01-01 00:00:{k:02d}"}}\n' for k in range(10)))
    made = "CREATE TABLE {0} (id BIGINT, ts TIMESTAMP, WATERMARK FOR ts AS ts - INTERVAL '5' SECOND) WITH ('connector'='filesystem', 'path'='{1}', 'format'='json', 'scan.startup.mode'='{2}'{3})"
    for mode, more, want in (("earliest-offset", "", range(10)), ("timestamp", ", 'scan.startup.timestamp-millis'='1704067204000'", range(4, 10)), ("latest-offset", "", [])):
        name = f"m_{mode[:4]}_{uuid.uuid4().hex[:6]}"
        Runner(spark, streaming=True).run(made.format(name, folder, mode, more) + ";")
        assert run_lines(spark, spark.table(name).select("id"), tmp_path, name) == list(want)
