"""Hand-worked cases of functions and batch operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import expressions as X
from halyard.operators import batch as B
from halyard.operators import patterns
from halyard.plans.inspect import plan_facts


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def travel(spark, *values, key="v"):
    return spark.createDataFrame([(key, k, float(v)) for k, v in enumerate(values)], "vin string, k int, path double")


@pytest.mark.parametrize("values,want", [((0, 300, 537, 1000, 1100), [(3, 1), (2, 2)]), ((0, 536), []), ((5,), [])])
def test_delta_trigger(spark, values, want):
    assert [(r["n"], r["firing"]) for r in B.delta_trigger(travel(spark, *values), "vin", "path", ["k"]).orderBy("firing").collect()] == want


@pytest.mark.parametrize("threshold", [536.0, 3.0, 0.0, -1.0])
def test_firings_one_by_one(threshold):
    rng = np.random.default_rng(int(threshold) + 2)
    for values in (rng.normal(0, 4, 400), np.cumsum(rng.exponential(40, 400)), np.cumsum(rng.normal(1, 5, 400)), np.zeros(5), np.zeros(0)):
        last, want = 0.5, []
        for i, v in enumerate(values.tolist()):
            if v - last > threshold:
                want.append(i)
                last = v
        assert B._firings(values, 0.5, threshold) == want


def test_delta_scan_over_batches(spark):
    """Keys that begin and end anywhere in batches, against rows taken one by one."""
    rng = np.random.default_rng(6)
    rows = [(key, k, float(v)) for key in range(12) for k, v in enumerate(np.cumsum(rng.normal(30, 60, rng.integers(1, 90))))]
    df = spark.createDataFrame(rows, "vin int, k int, path double")
    want, state = [], {}
    for key, _, v in rows:
        last, n, firing = state.get(key, (None, 0, 0))
        n += 1
        if last is None:
            last = v
        elif v - last > 200:
            firing, last = firing + 1, v
            want.append((key, n, firing))
            n = 0
        state[key] = (last, n, firing)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("7", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            assert sorted((r["vin"], r["n"], r["firing"]) for r in B.delta_trigger(df, "vin", "path", ["k"], 200.0).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_running_counts_in_parts(spark):
    df = spark.createDataFrame([("a" if k % 3 else None, k, k // 7 if k > 6 else None) for k in range(50)], "key string, k int, part int")
    plain = B.running_count(df, "key", ["k"])
    parts = B.running_count(df, "key", ["k"], part=F.col("part"))
    assert parts.columns == plain.columns and sorted(map(repr, parts.collect())) == sorted(map(repr, plain.collect()))


def test_interval_join(spark):
    rng = np.random.default_rng(2)
    rows = lambda n: [(int(k), int(rng.integers(0, 3)), int(rng.integers(0, 5000))) for k in range(n)]
    left, right = rows(80), rows(90)
    frame = lambda x: spark.createDataFrame(x, "id int, user int, s int").select("id", "user", F.timestamp_seconds("s").alias("ts"))
    got = {(r["id"], r["right_id"]) for r in B.interval_join(frame(left), frame(right), "user", "ts", "3 minutes", "1 minute").collect()}
    assert got == {(a, b) for a, u, s in left for b, v, t in right if u == v and s - 180 <= t <= s + 60} and got


def test_delta_trigger_empty_and_null(spark):
    df = travel(spark, 1).filter("false").union(spark.createDataFrame([("v", 0, None)], "vin string, k int, path double"))
    assert B.delta_trigger(df, "vin", "path", ["k"]).collect() == []


@pytest.mark.parametrize("n,want", [(7, [5]), (10, [5, 10]), (4, [])])
def test_count_trigger(spark, n, want):
    df = spark.range(n).select(F.lit("w").alias("word"), F.timestamp_micros(F.col("id")).alias("ts"), "id")
    assert sorted(r["total"] for r in B.count_trigger(df, "word", "ts", ["id"]).collect()) == want


def test_tokens(spark):
    assert one(spark, X.word_tokens(F.lit("Hi, there! hi")))[0] == ["hi", "there", "hi"]
    assert one(spark, X.words_by_space(F.lit("a b  c ")))[0] == ["a", "b", "", "c"]


@pytest.mark.parametrize("values,want", [((5, 5, 3), [(5, 1), (5, 2)]), ((4,), [(4, 1)]), ((), [])])
def test_top2(spark, values, want):
    df = spark.createDataFrame([("k", v) for v in values], "key string, v int")
    assert [(r["v"], r["rank"]) for r in B.top_n(df, "key", [F.desc("v")]).orderBy("rank").collect()] == want


def test_retract_sum(spark):
    df = spark.createDataFrame([("k", "+", 5), ("k", "+", 7), ("k", "-", 5), ("e", "+", None)], "key string, op string, v int")
    got = {r["key"]: r["total"] for r in B.retract_sum(df, "key", "v", F.col("op") == "-").collect()}
    assert got == {"k": 7, "e": 0}


def test_factor(spark):
    assert one(spark, X.factor(), X.factor(F.array(F.lit(3))), X.factor(F.array(F.lit(2), F.lit(3))), X.factor(F.array(F.lit(2**31 - 1))))[:] == (2020, 6060, 12120, -2020)


def test_map_and_special(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    assert one(spark, X.map_to_string(m), X.map_to_string(F.lit(None).cast("map<string,string>")))[:] == ("a=1,b=null", "")
    kinds = lambda s: [tuple(r) for r in spark.range(1).select(F.inline(X.special_parts(F.lit(s).cast("string")))).collect()]
    assert kinds("1,2") == [("brake", "1"), ("hard_to", "2")]
    assert len(kinds("1,2,3,4,5")) == 4
    assert kinds(None) == []
    assert kinds("1,,") == [("brake", "1")]


def shifted(lng, lat):
    """The survey grid's image of a point, in plain floating-point numbers."""
    x, y, wave = lng - 105, lat - 35, lambda v, *terms: sum(a * math.sin(v * math.pi / b) for a, b in terms) * 2 / 3
    common = wave(x, (20, 1 / 6), (20, 1 / 2))
    d_lat = -100 + 2 * x + 3 * y + y * y / 5 + x * y / 10 + math.sqrt(abs(x)) / 5 + common + wave(y, (20, 1), (40, 3)) + wave(y, (160, 12), (320, 30))
    d_lng = 300 + x + 2 * y + x * x / 10 + x * y / 10 + math.sqrt(abs(x)) / 10 + common + wave(x, (20, 1), (40, 3)) + wave(x, (150, 12), (300, 30))
    a, e, phi = X.AXIS, X.ECCENTRICITY, math.radians(lat)
    m = 1 - e * math.sin(phi) ** 2
    return lng + math.degrees(d_lng / (a / math.sqrt(m) * math.cos(phi))), lat + math.degrees(d_lat / (a * (1 - e) / m**1.5))


@pytest.mark.parametrize("point", [(104.0665, 30.5723), (121.4737, 31.2304), (87.6168, 43.8256)])
def test_coordinates(spark, point):
    lng, lat = X.wgs84_to_gcj02(*map(F.lit, point))
    grid = shifted(*point)
    assert one(spark, lng, lat)[:] == pytest.approx(grid, abs=1e-9)
    map_ = one(spark, *X.gcj02_to_bd09(lng, lat))
    z, theta = math.hypot(*grid) + 2e-5 * math.sin(grid[1] * X.BD_ANGLE), math.atan2(grid[1], grid[0]) + 3e-6 * math.cos(grid[0] * X.BD_ANGLE)
    assert map_[:] == pytest.approx((z * math.cos(theta) + 0.0065, z * math.sin(theta) + 0.006), abs=1e-9)
    assert one(spark, *X.gcj02_to_wgs84(lng, lat))[:] == pytest.approx(point, abs=2e-5)
    assert one(spark, *X.bd09_to_gcj02(*map(F.lit, map_)))[:] == pytest.approx(grid, abs=2e-5)
    assert one(spark, *X.convert_coordinates("wgs84", "gaode", F.lit(1.0), F.lit(2.0)))[:] == (1.0, 2.0)
    assert one(spark, *X.wgs84_to_gcj02(F.lit(2.35), F.lit(48.85), check_box=False))[:] == pytest.approx(shifted(2.35, 48.85), abs=1e-9)


def test_scalars(spark):
    assert one(spark, F.round(X.to_degrees(F.lit(-48), F.lit(51), F.lit(29.6)), 8))[0] == 48.85822222
    assert [one(spark, X.is_scientific(F.lit(s)))[0] for s in ("5e7", "+2.50E-08", "-6E3", "x1e5", "7.e2", "42")] == [True, True, True, False, False, False]
    assert one(spark, X.bit_set(F.lit(0), 0), X.bit_set(F.lit(1), 5), X.bit_clear(F.lit(33), 0), X.bit_toggle(F.lit(32), 5), X.bit_test(F.lit(0), 5))[:] == (1, 33, 32, 0, False)
    null = F.lit(None).cast("string")
    assert one(spark, X.sentinel(null), X.sentinel(F.lit("7")), X.sentinel(F.lit("")), X.sentinel(F.lit(""), strict_empty=False), X.sentinel(F.lit("x")))[:] == (-99999, 7, -99999, None, None)
    assert one(spark, X.default_day(null), X.default_day(F.lit("")), X.default_day(F.lit("2023-01-02 03:04:05")), X.default_day(F.lit("junk")))[:] == ("9999-99-99", "9999-99-99", "2023-01-02", None)
    assert str(one(spark, X.epoch_ms_to_timestamp(F.lit("1650729600123")))[0]) == "2022-04-23 16:00:00"
    assert one(spark, X.epoch_seconds(F.lit("2022-04-24 00:00:00")), X.fixed_six(F.lit(1.5)), X.json_double(F.lit("{}"), "a"))[:] == (1650729600, "1.500000", 0.0)


def test_flatten_unnest_subscripts(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('date', 'd', 'x', 2) AS s, array(named_struct('no', 7)) AS a UNION ALL SELECT 2, null, array() UNION ALL SELECT 3, null, null")
    assert B.flatten(df, "s", ["id"]).columns == ["id", "date", "x"]
    assert [(r["id"], r["n"]) for r in B.unnest(df.select("id", "a"), "a", ["n"]).collect()] == [(1, 7)]
    m = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    assert one(spark, B.at(m, 1, 2), B.at(m, 2, 2), B.at(m, 5, 1))[:] == (2, None, None)


def test_wide_struct(spark):
    wide = spark.range(3).select(F.struct(*[F.lit(str(k)).alias(f"c{k}") for k in range(778)]).alias("dataList"))
    out = B.flatten(wide, "dataList")
    assert len(out.columns) == 778 and out.count() == 3


def test_asof_ties_and_rate(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("b", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 4, 9)], "k string, t int, id int")
    got = {r["id"]: r["right_id"] for r in B.asof_join(left, right, "k", "t", ["id"]).collect()}
    assert got == {1: 10, 2: None, 3: None}
    assert {r["id"]: r["right_id"] for r in B.asof_join(left, right, "k", "t", ["id"], strict=True).collect()} == {1: 9, 2: None, 3: None}
    events = spark.range(10).select(F.timestamp_micros(F.col("id") * 300_000).alias("ts"), "id")
    assert B.rate_limited(events, [], "ts", ["id"], "1 second", 2).count() == 6


def test_plans(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    facts = plan_facts(events.filter("value > 3").select("user_id"))
    assert "value" in facts.pushed[0] and "props" not in facts.read[0] and facts.exchanges == 0
    assert plan_facts(B.keep_last(events, "user_id", ["ts", "event_id"])).exchanges == 1
    assert plan_facts(B.retract_sum(events, "user_id", "value", F.col("event_type") == "error")).python == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_session_rows(spark, keys):
    """Sessions over the borders of many small partitions, ties, rows without a time, and a hot time, against a plain reading."""
    import random

    pick = random.Random(len(keys))
    rows = [(n, pick.choice(("a", "b", None)), pick.choice((pick.randrange(4000), 777, None))) for n in range(900)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
        out = B.session_rows(df, "ts", "6 seconds", keys)
        got = {r["id"]: (int(r["window_start"].timestamp()), int(r["window_end"].timestamp())) for r in out.collect()}
        assert out.columns == [*df.columns, "window_start", "window_end"]
        assert B.session_rows(df.filter("false"), "ts", "6 seconds", keys).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {}
    groups = {}
    for n, k, s in rows:
        if s is not None:
            groups.setdefault(k if keys else 0, []).append((s, n))
    for some in groups.values():
        some.sort()
        session = []
        for s, n in some:
            if session and s > session[-1][0] + 6:
                want |= {m: (session[0][0], session[-1][0] + 6) for _, m in session}
                session = []
            session.append((s, n))
        want |= {m: (session[0][0], session[-1][0] + 6) for _, m in session}
    assert got == want


def brute_matches(signs, expression, overlapping):
    """By the standard library over the whole key at once; a sign is a letter."""
    import re

    out, at = [], 0
    rx = re.compile(expression)
    while at <= len(signs) and (m := rx.search(signs, at)):
        if m.end() > m.start():
            out.append((m.start(), m.end()))
            at = m.start() + 1 if overlapping else m.end()
        else:
            at = m.end() + 1
    return out


@pytest.mark.parametrize("pattern,expression", [("A B+ C", "ab+c"), ("A+ (B | C)? A", "a+[bc]?a"), ("(A B){2,3}", "(?:ab){2,3}"), ("A B* C | A", "ab*c|a"), ("A+? B", "a+?b"), ("B*", "b*")])
@pytest.mark.parametrize("overlapping", [False, True])
def test_row_patterns(spark, pattern, expression, overlapping):
    """Keys that go on over many small batches, against a search over the whole of each."""
    import random

    pick = random.Random(pattern)
    words = {k: "".join(pick.choices("abcd", [4, 4, 2, 1], k=n)) for k, n in (("x", 400), ("y", 90), (None, 7), ("z", 1))}
    rows = [(k, n, c) for k, w in words.items() for n, c in enumerate(w)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, c string").withColumn("match", F.lit(1))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(setting)
    spark.conf.set(setting, "17")
    try:
        out = patterns.match_rows(df, ["k"], ["n"], pattern, {v: F.col("c") == v.lower() for v in "ABC"}, overlapping).collect()
    finally:
        spark.conf.set(setting, usual)
    got = {}
    for r in out:
        assert r["variable"] == r["c"].upper()
        got.setdefault((r["k"], r["match_no"]), []).append((r["nth"], r["n"]))
    want = {(k, i + 1): [(p + 1, n) for p, n in enumerate(range(a, b))] for k, w in words.items() for i, (a, b) in enumerate(brute_matches(w, expression, overlapping))}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_row_patterns_that_cannot_be_read(spark):
    df = spark.range(3)
    for bad in ("A & B", "X", "A $"):
        with pytest.raises(Exception, match="pattern|condition"):
            patterns.compiled(bad, ["A", "B"])
    assert patterns.match_rows(df.filter("false"), ["id"], ["id"], "A", {"A": F.lit(True)}).collect() == []


def _last_before(left, right, strict):
    """(id, right id) by looking at all pairs."""
    out = set()
    for key, at, i in left:
        met = [(t, r) for k, t, r in right if k is not None and k == key and t is not None and at is not None and (t < at or t == at and not strict)]
        out.add((i, max(met)[1] if met else None))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_asof_by_stretches(spark, strict):
    """A hot key, rows at the borders of stretches, ties, and no key or time, against all pairs."""
    rng = np.random.default_rng(4)

    def side(n):
        keys = rng.choice(["hot", "hot", "a", "b", "only" + str(n), None], n).tolist()
        hours = rng.integers(-60, 60, n).tolist()
        return [(k, None if h % 17 == 0 else h * 3_600_000_000, i) for i, (k, h) in enumerate(zip(keys, hours))]

    left, right = side(300), side(120)
    frame = lambda rows: spark.createDataFrame(rows, "k string, us long, id long").select("k", F.timestamp_micros("us").cast("timestamp_ntz").alias("t"), "id")
    for stretch in (None, "1 hour", "6 hours", "90 days"):
        got = B.asof_join(frame(left), frame(right), "k", "t", ["id"], strict, stretch)
        assert [f"{n}" for n in got.columns] == ["k", "t", "id", "right_id"] and got.count() == len(left)
        assert {(r["id"], r["right_id"]) for r in got.collect()} == _last_before(left, right, strict)
    assert B.asof_join(frame(left), frame([]), "k", "t", ["id"], strict, "1 hour").filter("right_id is not null").count() == 0
    assert B.asof_join(frame([]), frame(right), "k", "t", ["id"], strict, "1 hour").count() == 0


def test_running_over_borders(spark):
    """Keys that span partitions, keys inside one, rows without a key or value, and equal rows, against one pass over sorted rows."""
    rng = np.random.default_rng(8)
    keys = ["hot"] * 900 + rng.choice(["a", "b", "c", None], 300).tolist()
    rows = [(k, int(o), None if o % 7 == 0 else int(v), i) for i, (k, o, v) in enumerate(zip(keys, rng.permutation(1200), rng.integers(-50, 50, 1200)))]
    values = {"nth": ("count", F.lit(1)), "known": ("count", "v"), "total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")}

    def brute(by_key, down):
        state, out = {}, set()
        for k, o, v, i in sorted(rows, key=lambda r: -r[1] if down else r[1]):
            n, seen = state.setdefault(k if by_key else "", [0, []])
            state[k if by_key else ""][0] = n + 1
            if v is not None:
                seen.append(v)
            out.add((i, n + 1, len(seen), sum(seen) if seen else None, min(seen, default=None), max(seen, default=None)))
        return out

    df = spark.createDataFrame(rows, "k string, o int, v long, id int").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for coalesce in ("false", "true"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            for by_key, down in ((True, False), (True, True), (False, False), (False, True)):
                got = B.running(df, ["k"] if by_key else [], [F.col("o").desc() if down else "o"], values)
                assert got.columns == ["k", "o", "v", "id", *values]
                assert {(r["id"], *[r[c] for c in values]) for r in got.collect()} == brute(by_key, down)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        same = B.running(spark.range(2000).select(F.lit("x").alias("k"), F.lit(0).alias("o")), ["k"], ["o"], {"nth": ("count", F.lit(1))})
        assert sorted(r["nth"] for r in same.collect()) == list(range(1, 2001))
        assert B.running(df.limit(0), ["k"], ["o"], values).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_running_has_no_window_over_a_table(spark):
    """Without keys rows' windows lie in partitions; only totals, a row for each, are in one."""
    plan = B.running(spark.range(1000), [], ["id"], {"nth": ("count", F.lit(1))})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_part#" in line for line in windows) == 1
