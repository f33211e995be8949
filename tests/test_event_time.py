"""Stream joins, ordered folds, lateness and changelogs against plain readings; what state they keep."""

import json
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators import batch as B
from halyard.script.runner import Runner
from halyard.streaming.changelog import SortedMultiset, changelog_aggregates
from halyard.streaming.joins import interval_join_stream
from halyard.streaming.lateness import firings, late_rows, windows_with_lateness
from halyard.streaming.ordered import in_order, over_stream, rate_limited_stream, state_in_rocksdb, temporal_join_stream
from halyard.streaming.overs import Over, over_rows

BASE = 1704067200


def cuts_of(spark, folder, cuts, schema):
    """A stream of rows (the last field: seconds), a file and micro-batch for each cut."""
    for k, rows in enumerate(cuts):
        df = spark.createDataFrame(rows, schema + ", s double").withColumn("ts", F.timestamp_micros((BASE * 10**6 + F.col("s") * 10**6).cast("long"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ran(spark, out, folder, name, mode="append"):
    with state_in_rocksdb(spark):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / "chk")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), q


def seconds_of(ts):
    return ts.timestamp() - BASE if ts is not None else None


def test_interval_join_lets_state_go(spark, tmp_path):
    pick = random.Random(1)
    cuts = lambda: [[(pick.choice("ab"), 100 * k + n, 3600.0 * k + pick.randrange(3600)) for n in range(40)] for k in range(8)]
    one, two = cuts(), cuts()
    late = lambda s: s.withWatermark("ts", "30 minutes")
    a, b = cuts_of(spark, tmp_path / "a", one, "key string, id long"), cuts_of(spark, tmp_path / "b", two, "key string, id long")
    got, q = ran(spark, interval_join_stream(late(a), late(b), "key", "ts", "10 minutes", "5 minutes").select("id", "right_id"), tmp_path, "near")
    pairs = [(i, j) for k, i, s in sum(one, []) for k2, j, t in sum(two, []) if k == k2 and s - 600 <= t <= s + 300]
    assert sorted(map(tuple, got)) == sorted(pairs) and pairs
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held[3:]) < 0.75 * (sum(map(len, one)) + sum(map(len, two)))  # an hour or two of eight, and a left row for each stretch
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress if p["stateOperators"]) > 200


def test_temporal_join(spark, tmp_path):
    """Versions that come late but inside the delay count, equal times go by the version's columns, rows wait for the watermark."""
    left = [[("a", 1, 10.0), ("a", 2, 50.0), ("b", 3, 20.0)], [("a", 4, 45.0), (None, 5, 60.0)], [("a", 6, 500.0), ("b", 7, 500.0)]]
    right = [[("a", 10, 30.0), ("a", 11, 50.0), ("a", 12, 50.0)], [("a", 13, 44.0), ("b", 14, 20.0), (None, 15, 1.0)], [("a", 16, 600.0)]]
    for strict in (False, True):
        late = lambda s: s.withWatermark("ts", "60 seconds")
        where = tmp_path / str(strict)
        a, b = cuts_of(spark, where / "a", left, "key string, id long"), cuts_of(spark, where / "b", right, "key string, id long")
        got, _ = ran(spark, temporal_join_stream(late(a), late(b), "key", "ts", ["id"], ["id"], strict), where, f"versions{strict}")
        want = {1: None, 2: 13 if strict else 12, 3: None if strict else 14, 4: 13, 5: 15}
        assert {r["id"]: r["right_id"] for r in got} == want  # rows at 500 wait: the watermark is 440
        assert {seconds_of(r["ts"]) for r in got} == {10.0, 20.0, 45.0, 50.0, 60.0}


def test_versions_share_groups(spark, tmp_path):
    """200 keys in 4 groups of state: each left row gets its own key's version."""
    late = lambda s: s.withWatermark("ts", "60 seconds")
    a = cuts_of(spark, tmp_path / "a", [[(k, k, 10.0) for k in range(200)], [(0, 999, 900.0)]], "key long, id long")
    b = cuts_of(spark, tmp_path / "b", [[(k, 1000 + k, 5.0) for k in range(200)], [(0, 1999, 900.0)]], "key long, id long")
    got, q = ran(spark, temporal_join_stream(late(a), late(b), "key", "ts", ["id"], ["id"], groups=4), tmp_path, "shared_versions")
    assert sorted((r["key"], r["id"], r["right_id"]) for r in got) == [(k, k, 1000 + k) for k in range(200)]
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) < 100


def test_over_and_folds(spark, tmp_path):
    cuts = [[("a", 1, 5.0, 10.0), ("a", 2, None, 30.0)], [("a", 3, 1.0, 20.0), ("a", 4, 8.0, 30.0), ("b", 5, 2.0, 31.0)], [("a", 6, 0.0, -500.0), ("a", 7, 4.0, 900.0)], [("b", 8, 0.0, 2000.0)]]
    s = cuts_of(spark, tmp_path / "in", cuts, "key string, id long, v double")
    got, _ = ran(spark, over_stream(s.withWatermark("ts", "60 seconds"), ["key"], "ts", ["id"], "v", 1), tmp_path, "overs")
    rows = {r["id"]: (r["nth"], r["running_sum"], r["near_avg"]) for r in got}
    assert rows == {1: (1, 5.0, 5.0), 3: (2, 6.0, 3.0), 2: (3, 6.0, 1.0), 4: (4, 14.0, 8.0), 5: (1, 2.0, 2.0), 7: (5, 18.0, 6.0)}  # 6 came behind the watermark
    s = cuts_of(spark, tmp_path / "in2", cuts, "key string, id long, v double")
    (tmp_path / "two").mkdir()
    got, _ = ran(spark, in_order(s.withWatermark("ts", "60 seconds"), ["key"], "ts", ["id"], lambda state, row: ((state or 0) + 1, (state,) if (state or 0) % 2 else None), "odd long"), tmp_path / "two", "odds")
    assert sorted((r["key"], r["odd"]) for r in got) == [("a", 1), ("a", 3)]


def test_keys_share_groups(spark, tmp_path):
    """State is called by group: 400 keys in 4 groups, of which each keeps its own rows and its type; nulls and both zeros are keys."""
    numbers = [None, 0.0, *map(float, range(1, 399))]
    cuts = [[(-0.0 if v == 0 else v, k, 10.0) for k, v in enumerate(numbers)], [(v, 1000 + k, 5.0) for k, v in enumerate(numbers)], [(7.0, 5000, 900.0)]]
    s = cuts_of(spark, tmp_path / "in", cuts, "key double, id long").withWatermark("ts", "60 seconds")
    out = in_order(s, ["key"], "ts", ["id"], lambda state, row: ((state or 0) + 1, ((state or 0) + 1, json.loads(row["_body"])["id"])), "nth long, id long", groups=4)
    got, q = ran(spark, out, tmp_path, "shared")
    assert out.schema["key"].dataType == T.DoubleType()
    assert sorted((r["id"], r["nth"], r["key"]) for r in got if r["key"] is not None) == sorted((1000 * (n == 1) + k, 3 - n - 1, v) for k, v in enumerate(numbers) if v is not None for n in (0, 1))
    assert sorted((r["id"], r["nth"]) for r in got if r["key"] is None) == [(0, 2), (1000, 1)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(held) < 100


def test_rate_limit(spark, tmp_path):
    pick = random.Random(3)
    rows = [(pick.choice("ab"), k, pick.randrange(4000) / 10) for k in range(300)]
    s = cuts_of(spark, tmp_path / "in", [[r for r in rows if r[2] < 250 and r[1] % 2], [r for r in rows if not (r[2] < 250 and r[1] % 2)], [("c", 999, 9999.0)]], "key string, id long")
    got, _ = ran(spark, rate_limited_stream(s.withWatermark("ts", "300 seconds"), ["key"], "ts", ["id"], "10 seconds", 3).select("key", "id"), tmp_path, "limited")
    df = spark.createDataFrame(rows, "key string, id long, s double").withColumn("ts", F.timestamp_micros((BASE * 10**6 + F.col("s") * 10**6).cast("long")))
    want = B.rate_limited(df, ["key"], "ts", ["ts", "id"], "10 seconds", 3).select("key", "id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) < 300


def test_lateness(spark, tmp_path):
    """Windows of 100 s, no delay, 200 s of lateness."""
    cuts = [
        [("a", 1, 1.0, 10.0), ("a", 2, 2.0, 90.0), ("a", 3, 4.0, 150.0)],  # watermark 150
        [("a", 4, 8.0, 20.0), ("a", 5, 16.0, 15.0), ("a", 6, None, 160.0), ("b", 7, 1.0, 30.0)],  # two late for [0, 100), the second's window starts late
        [("a", 8, 1.0, 420.0)],
        [("a", 9, 1.0, 50.0), ("a", 10, 1.0, 210.0), ("b", 11, 1.0, 40.0)],  # watermark 420: 50 is too late, 210 (ends at 300) isn't
    ]
    s = cuts_of(spark, tmp_path / "in", cuts, "key string, id long, v double")
    out = windows_with_lateness(s.withWatermark("ts", "0 seconds"), ["key"], "ts", ["id"], "v", "100 seconds", "200 seconds")
    got, q = ran(spark, out, tmp_path, "lates")
    fired = [(r["key"], seconds_of(r["window_start"]), r["n"], r["total"], r["firing"]) for r in got if r["late_row"] is None]
    assert sorted(fired) == [("a", 0.0, 2, 3.0, 1), ("a", 0.0, 3, 19.0, 2), ("a", 0.0, 4, 27.0, 3), ("a", 100.0, 2, 4.0, 1), ("a", 200.0, 1, 1.0, 1), ("b", 0.0, 1, 1.0, 1)]
    lost = spark.createDataFrame([r for r in got], spark.table("lates").schema)
    assert sorted(r["id"] for r in late_rows(lost, s).collect()) == [9, 11] and firings(lost).count() == 6


@pytest.mark.parametrize("size", [3, 4096])
def test_sorted_multiset(size):
    pick = random.Random(size)
    held, chunks, index = Counter(), {}, []
    for _ in range(200):
        values = [pick.choice((-2.5, 0.0, 1e300, float("inf"), pick.randrange(40) / 4)) for _ in range(pick.randint(1, 12))]
        signs = [pick.choice((1, 1, -1)) for _ in values]
        for v, s in zip(values, signs):
            held[v] += s
        m = SortedMultiset(chunks, index, size)
        m.change(np.array(values), np.array(signs))
        index = m.index
        seen = sorted((v for v, n in held.items() for _ in range(max(0, n))), reverse=True)
        assert (m.rows, m.distinct, m.smallest(), m.largest(2)) == (len(seen), len(set(seen)), seen[-1] if seen else None, seen[:2])
        assert set(chunks) == {n for n, *_ in index} and all(len(v[0]) <= 8 * size for v in chunks.values())


def test_changelog(spark, tmp_path):
    """Also rows taken back before they come, and keys that lose all their rows."""
    cuts = [[("a", "+", 5.0, 0.0), ("a", "+", 5.0, 0.0), ("b", "-", 7.0, 0.0), ("c", "+", 1.0, 0.0), ("a", "+", None, 0.0)], [("a", "-", 5.0, 0.0), ("b", "+", 7.0, 0.0), ("b", "+", 7.0, 0.0), ("c", "-", 1.0, 0.0), ("a", "+", 2.0, 0.0), (None, "+", 3.0, 0.0)]]
    s = cuts_of(spark, tmp_path / "in", cuts, "key string, op string, v double")
    got, _ = ran(spark, changelog_aggregates(s, "key", "v", F.col("op") == "-"), tmp_path, "changes", "update")
    last = {}
    for r in got:
        if r["changes"] >= last.get(r["key"], (0,))[0]:
            last[r["key"]] = tuple(r)[1:]
    assert last == {"a": (4, 2, 2, 2.0, 5.0, 2.0), "b": (3, 1, 1, 7.0, 7.0, None), "c": (2, 0, 0, None, None, None), None: (1, 1, 1, 3.0, 3.0, None)}


def test_over_kinds_equal_windows(spark, tmp_path):
    """All kinds and frames against Spark's own windows in batch; times tie, values are null, NaN or decimal, a key is null."""
    pick = random.Random(5)
    rows = [(pick.choice(["a", "b", None]), k, pick.choice([None, 1, 2, 7]), pick.choice([None, 0.5, 2.25, float("nan")]), pick.choice(["x", "y", None]), pick.choice([None, pick.randrange(9)]), float(pick.randrange(60))) for k in range(240)]
    schema = "key string, id long, n int, v double, w string, o long"
    stream = cuts_of(spark, tmp_path / "in", [[r for r in rows if r[1] % 2], [r for r in rows if not r[1] % 2], [("late", 999, 1, 1.0, "z", 1, 9999.0)]], schema).withColumn("d", F.col("n").cast("decimal(10,2)") / 3)
    df = spark.read.parquet(str(tmp_path / "in")).filter("id < 999").withColumn("d", F.col("n").cast("decimal(10,2)") / 3)
    whole, back, span = {}, {"rows": 2}, {"span": "10 seconds"}
    made = {}
    for frame_name, frame in (("whole", whole), ("sofar", {"rows": -1}), ("back", back), ("span", span)):
        for kind, of in (("count", "w"), ("sum", "n"), ("sum", "d"), ("avg", "n"), ("avg", "d"), ("min", "v"), ("max", "v"), ("max", "w"), ("min", "ts")):
            made[f"{kind}_{of}_{frame_name}"] = Over(kind, F.col(of), **frame)
    for frame_name, frame in (("sofar", {"rows": -1}), ("back", back)):
        made |= {f"first_{frame_name}": Over("first_value", F.col("w"), **frame), f"last_{frame_name}": Over("last_value", F.col("v"), **frame), f"sum_v_{frame_name}": Over("sum", F.when(~F.isnan("v"), F.col("v")), **frame)}
    made |= {k: Over(k) for k in ("row_number", "rank", "dense_rank")} | {"lag_1": Over("lag", F.col("ts")), "lag_3": Over("lag", F.col("d"), offset=3)}

    def batch(order, names):
        w = Window.partitionBy("key").orderBy(*order)
        frames = {"whole": w.rangeBetween(Window.unboundedPreceding, 0), "sofar": w.rowsBetween(Window.unboundedPreceding, 0), "back": w.rowsBetween(-2, 0)}
        out = []
        for name in names:
            v = made[name]
            call = getattr(F, v.kind)(*([] if v.of is None else [v.of, v.offset] if v.kind == "lag" else [v.of]))
            if v.span:
                over = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-10 * 10**6, 0)
            else:
                over = w if v.kind in ("row_number", "rank", "dense_rank", "lag") else frames["whole" if v.rows is None else "sofar" if v.rows < 0 else "back"]
            out.append(call.over(over).alias(name))
        return df.select("id", *out)

    def same(got, want):
        assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
        rows = lambda d: sorted(tuple(map(repr, r)) for r in d.collect())
        assert rows(got) == rows(want)

    marked = stream.withWatermark("ts", "100 seconds")
    for n, order in enumerate((["o", "id"], ["o"], [])):  # the last two leave ties, where only frames of time are defined
        names = [k for k, v in made.items() if (v.span is None or not order) and (n == 0 or (v.rows is None and v.kind not in ("row_number", "lag")))]
        out = over_rows(marked, [F.col("key")], "ts", order, {k: made[k] for k in names}).select("id", *names)
        (tmp_path / f"o{n}").mkdir()
        ran(spark, out, tmp_path / f"o{n}", f"over_kinds_{n}")
        same(spark.table(f"over_kinds_{n}").filter("id < 999"), batch(["ts", *order], names))


def test_over_of_scripts(spark, tmp_path):
    s = cuts_of(spark, tmp_path / "in", [[("a", 1, 1.0, 10.0), ("b", 2, 2.0, 11.0), ("a", 3, 4.0, 5.0)], [("c", 9, 0.0, 999.0)]], "key string, id long, v double")
    s.withWatermark("ts", "60 seconds").createOrReplaceTempView("over_in")
    s.createOrReplaceTempView("over_plain")
    r = Runner(spark, streaming=True, checkpoints=str(tmp_path / "chk"))
    first = r.execute("SELECT t.* FROM (SELECT *, row_number() OVER (PARTITION BY upper(key), CASE WHEN v < 9 THEN 1 ELSE 2 END ORDER BY ts ASC) AS rn FROM over_in) AS t WHERE rn = 1")
    assert first.columns == ["key", "id", "v", "ts", "rn"]
    got, _ = ran(spark, first, tmp_path, "over_first")
    assert sorted((x["key"], x["id"]) for x in got) == [("a", 3), ("b", 2)]
    sums = r.execute("SELECT o.id, round(sum(o.v) OVER (PARTITION BY o.key ORDER BY o.ts), 1) + 1 AS total FROM over_in AS o WHERE o.v > 1 UNION ALL SELECT id, v FROM over_in WHERE id = 9")
    (tmp_path / "sums").mkdir()
    got, _ = ran(spark, sums, tmp_path / "sums", "over_sums")
    assert sorted(map(tuple, got)) == [(2, 3.0), (3, 5.0), (9, 0.0)]
    spark.read.parquet(str(tmp_path / "in")).createOrReplaceTempView("over_table")  # a table keeps Spark's own windows
    got = r.execute("SELECT id, row_number() OVER (PARTITION BY key ORDER BY v DESC) AS rn FROM over_table").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1), (3, 1), (9, 1)]
    for bad in ("sum(v) OVER (PARTITION BY key ORDER BY ts DESC)", "sum(v) OVER (PARTITION BY key ORDER BY id)", "sum(v) OVER (PARTITION BY key)", "ntile(2) OVER (PARTITION BY key ORDER BY ts)", "sum(DISTINCT v) OVER (ORDER BY ts)",
                "sum(v) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "sum(v) OVER (PARTITION BY key ORDER BY ts) + sum(v) OVER (PARTITION BY id ORDER BY ts)"):
        with pytest.raises(ValueError):
            r.execute(f"SELECT {bad} AS x FROM over_in")
    with pytest.raises(ValueError):  # no watermark
        r.execute("SELECT sum(v) OVER (PARTITION BY key ORDER BY ts) AS x FROM over_plain")


def test_insert_of_overs(spark, tmp_path):
    """An insert of a script into a stored table, with a view between."""
    s = cuts_of(spark, tmp_path / "in", [[("a", 1, 1.0, 10.0), ("a", 3, 4.0, 5.0)], [("c", 9, 0.0, 999.0)]], "key string, id long, v double")
    s.withWatermark("ts", "60 seconds").createOrReplaceTempView("over_source")
    spark.sql("DROP TABLE IF EXISTS over_sink")
    r = Runner(spark, streaming=True, checkpoints=str(tmp_path / "chk"), warehouse=str(tmp_path / "wh"))
    r.run("""SET table.sql-dialect=hive;
CREATE TABLE over_sink (id BIGINT, n BIGINT);
SET table.sql-dialect=default;
CREATE VIEW over_between AS SELECT id, count(*) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM over_source;
INSERT INTO over_sink SELECT id, n FROM over_between WHERE n < 9;
""")
    r.wait(0)
    assert sorted(map(tuple, spark.table("over_sink").collect())) == [(1, 2), (3, 1)]
