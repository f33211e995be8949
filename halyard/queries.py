"""The engine's own queries over the driver's tables, and the SQL that they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import expressions as X
from halyard.functions.catalog import catalog_frame
from halyard.functions.registry import register_functions
from halyard.lineage.columns import insert_lineage
from halyard.lineage.tables import table_lineage
from halyard.operators import batch as B
from halyard.operators import patterns
from halyard.script.rewrites import rewrite_query
from halyard.script.runner import Runner
from halyard.session import scratch
from halyard.sources.lines import keep_place, lines_stream
from halyard.streaming import stateful
from halyard.streaming.changelog import changelog_aggregates
from halyard.streaming.exactly_once import Ledger, OnceFiles
from halyard.streaming.joins import interval_join_stream
from halyard.streaming.lateness import windows_with_lateness
from halyard.streaming.ordered import over_stream, rate_limited_stream, state_in_rocksdb, temporal_join_stream
from halyard.streaming.sinks import fan_out, supervised

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT event_id, event_type AS kind, user_id FROM events")
def q_select_project(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), "user_id")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^0-9A-Za-z_]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def q_wordcount(spark, d):
    return table(spark, d, "documents").select(F.explode(X.word_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, ' +$', ''), ' ')) AS word FROM documents) GROUP BY word")
def q_wordcount_space(spark, d):
    return table(spark, d, "documents").select(F.explode(X.words_by_space(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events")
def q_running_wordcount(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return B.running_count(events, "event_type", ["ts", "event_id"], part=F.to_date("ts")).select("event_id", "event_type", "running")


@query("""SELECT event_type, window_start, rn AS total FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 5 = 0""")
def q_count_trigger(spark, d):
    return B.count_trigger(table(spark, d, "events"), "event_type", "ts", ["ts", "event_id"], "1 day", 5)


def odometer(spark, d) -> DataFrame:
    run = F.sum(F.col("value").cast("decimal(18,6)")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("path", run.cast("double")).select("user_id", "ts", "event_id", "path")


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, path AS last, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS fired, CAST(0 AS BIGINT) AS firing FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.path - s.last > 536 THEN e.path ELSE s.last END, CASE WHEN s.fired > 0 THEN 1 ELSE s.n + 1 END, CASE WHEN e.path - s.last > 536 THEN 1 ELSE 0 END, s.firing + CASE WHEN e.path - s.last > 536 THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, event_id, n, firing FROM s WHERE fired > 0""")
def q_delta_trigger(spark, d):
    return B.delta_trigger(odometer(spark, d), "user_id", "path", ["ts", "event_id"]).select("user_id", F.col("at.event_id").alias("event_id"), "n", "firing")


def order_lines(spark, d) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_quantity")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # an order has 7 lines at most


@query("SELECT l_orderkey, l_linenumber AS no, l_partkey AS part, l_quantity AS quantity FROM lineitem")
def q_unnest(spark, d):
    return B.unnest(order_lines(spark, d), "lines", ["no", "part", "quantity"])


@query("""SELECT l_orderkey, CAST(a[1].l_quantity AS BIGINT) AS first_quantity, a[2].l_partkey AS second_part, a[9].l_partkey AS ninth_part, 'lines' AS kind FROM (SELECT l_orderkey, list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_quantity': l_quantity} ORDER BY l_linenumber, l_partkey, l_quantity) AS a FROM lineitem GROUP BY l_orderkey)""")
def q_positional_signals(spark, d):
    a = F.col("lines")
    return order_lines(spark, d).select("l_orderkey", B.at(a, 1)["l_quantity"].cast("bigint").alias("first_quantity"), B.at(a, 2)["l_partkey"].alias("second_part"), B.at(a, 9)["l_partkey"].alias("ninth_part"), F.lit("lines").alias("kind"))


@query("""SELECT l_orderkey, m[1][1] AS a11, m[2][1] AS a21, m[1][3] AS a13 FROM (SELECT l_orderkey, [list(l_partkey ORDER BY l_linenumber, l_partkey), list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey)] AS m FROM lineitem GROUP BY l_orderkey)""")
def q_nested_subscript(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    m = F.array(F.col("x.l_partkey"), F.col("x.l_suppkey"))
    return rows.select("l_orderkey", B.at(m, 1, 1).alias("a11"), B.at(m, 2, 1).alias("a21"), B.at(m, 1, 3).alias("a13"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate AS \"date\" FROM orders")
def q_struct_flatten(spark, d):
    packed = table(spark, d, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("date")).alias("operation"))
    return B.flatten(packed, "operation")


@query("""SELECT event_id, CASE WHEN k IS NULL OR k = '' THEN -99999 ELSE try_cast(k AS BIGINT) END AS k_int, CAST(CASE WHEN k IS NULL OR k = '' THEN CAST(-99999 AS DECIMAL(18,8)) ELSE try_cast(k AS DECIMAL(18,8)) END AS DOUBLE) AS k_dec, CASE WHEN k IS NULL THEN -99999 ELSE try_cast(k AS BIGINT) END AS k_loose
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events)""")
def q_sentinel_cast(spark, d):
    k = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 5 == 0, None).otherwise(X.json_string(F.col("props"), "k"))
    return table(spark, d, "events").select("event_id", k.alias("k")).select("event_id", X.sentinel(F.col("k")).alias("k_int"), X.sentinel(F.col("k"), "decimal(18,8)").cast("double").alias("k_dec"), X.sentinel(F.col("k"), strict_empty=False).alias("k_loose"))


@query("SELECT event_id, concat_ws('&', CAST(user_id AS VARCHAR), nullif(event_type, 'view'), CAST(event_id AS VARCHAR)) AS row_key, md5(concat(CAST(user_id AS VARCHAR), 'pepper')) AS masked FROM events")
def q_mask_key(spark, d):
    return table(spark, d, "events").select("event_id", X.row_key(F.col("user_id"), F.nullif(F.col("event_type"), F.lit("view")), F.col("event_id")).alias("row_key"), X.masked(F.col("user_id"), "pepper").alias("masked"))


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS log_ts, strftime(ts, '%Y-%m-%d') AS dt, CAST(ts AS DATE) AS stat_date FROM events")
def q_epoch_partition(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    at = table(spark, d, "events").select("event_id", X.epoch_ms_to_timestamp(ms).alias("log_ts"))
    return at.select("event_id", "log_ts", X.partition_day(F.col("log_ts")).alias("dt"), F.to_date("log_ts").alias("stat_date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '9999-99-99' END AS dt FROM orders")
def q_default_date(spark, d):
    s = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.col("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.default_day(s).alias("dt"))


@query("SELECT user_id, CAST(count_if(value > 30.451) AS BIGINT) AS brake, CAST(count_if(value > 100) AS BIGINT) AS hard_to FROM events GROUP BY user_id")
def q_braking(spark, d):
    return B.conditional_counts(table(spark, d, "events"), "user_id", {"brake": F.col("value") > 30.451, "hard_to": F.col("value") > 100})


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events")
def q_row_number(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("bigint").alias("rn"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_keep_last(spark, d):
    return B.keep_last(table(spark, d, "events"), "user_id", ["ts", "event_id"])


@query("SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 2")
def q_top2(spark, d):
    return B.top_n(table(spark, d, "events"), "event_type", [F.desc("value"), F.col("event_id")]).select("event_type", "value", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'error' THEN -value ELSE value END), 4) AS total FROM events GROUP BY user_id")
def q_retract_sum(spark, d):
    return B.retract_sum(table(spark, d, "events"), "user_id", "value", F.col("event_type") == "error").select("user_id", F.round("total", 4).alias("total"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE concat('a=', event_type, ',b=', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END) END AS s FROM events")
def q_map_to_string(spark, d):
    m = F.when(F.col("event_id") % 10 != 0, F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("string"))))
    return table(spark, d, "events").select("event_id", X.map_to_string(m).alias("s"))


@query("""SELECT event_id, ['brake', 'hard_to', 'unsafe_follow', 'force_to_quit'][i] AS type, p[i] AS value FROM (SELECT event_id, [CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR), 'x', 'y'][1:3 + event_id % 3] AS p FROM events), unnest(generate_series(1, 4)) AS g(i) WHERE i <= len(p)""")
def q_parse_special(spark, d):
    parts = F.array(F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"), F.lit("x"), F.lit("y"))
    s = F.array_join(F.slice(parts, F.lit(1), (F.col("event_id") % 3 + 3).cast("int")), ",")
    return table(spark, d, "events").select("event_id", F.inline(X.special_parts(s)))


@query("SELECT p_partkey, 2020 AS none, CAST(p_size * 2020 AS INTEGER) AS one, CAST(p_size * 3 * 2020 AS INTEGER) AS more FROM part")
def q_factor_udf(spark, d):
    p = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", X.factor().alias("none"), X.factor(F.array(p)).alias("one"), X.factor(F.array(p, F.lit(3))).alias("more"))


@query("SELECT c_custkey, round((c_custkey % 60 + c_custkey % 3600 / 60.0e0 / 60.0e0) / 60.0e0 + abs(c_nationkey - 12), 9) AS degrees FROM customer")
def q_dms(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(X.to_degrees(F.col("c_nationkey") - 12, F.col("c_custkey") % 60, F.col("c_custkey") % 3600 / F.lit(60.0)), 9).alias("degrees"))


def points(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", (F.lit(70.0) + F.col("c_custkey") % 700 / F.lit(10.0)).alias("lng"), (F.lit(0.5) + F.col("c_custkey") % 560 / F.lit(10.0)).alias("lat"))


POINTS = "p AS (SELECT c_custkey, 70.0e0 + (c_custkey % 700) / 10.0e0 AS lng, 0.5e0 + (c_custkey % 560) / 10.0e0 AS lat FROM customer)"


def _gcj_sql(src: str, out: str) -> str:
    """SQL of the grid's shift, from columns lng and lat of src to lng and lat of out."""
    wave = "(20.0e0*sin(6.0e0*x*pi()) + 20.0e0*sin(2.0e0*x*pi()))*2.0e0/3.0e0"
    lat = f"-100.0e0 + 2.0e0*x + 3.0e0*y + 0.2e0*y*y + 0.1e0*x*y + 0.2e0*sqrt(abs(x)) + {wave} + (20.0e0*sin(y*pi()) + 40.0e0*sin(y/3.0e0*pi()))*2.0e0/3.0e0 + (160.0e0*sin(y/12.0e0*pi()) + 320.0e0*sin(y*pi()/30.0e0))*2.0e0/3.0e0"
    lng = f"300.0e0 + x + 2.0e0*y + 0.1e0*x*x + 0.1e0*x*y + 0.1e0*sqrt(abs(x)) + {wave} + (20.0e0*sin(x*pi()) + 40.0e0*sin(x/3.0e0*pi()))*2.0e0/3.0e0 + (150.0e0*sin(x/12.0e0*pi()) + 300.0e0*sin(x/30.0e0*pi()))*2.0e0/3.0e0"
    return f"""{out}_a AS (SELECT *, lng - 105.0e0 AS x, lat - 35.0e0 AS y, 1.0e0 - 0.00669342162296594323e0*pow(sin(lat/180.0e0*pi()), 2) AS m FROM {src}),
{out}_b AS (SELECT *, ({lat})*180.0e0/((6378245.0e0*(1 - 0.00669342162296594323e0))/(m*sqrt(m))*pi()) AS d_lat, ({lng})*180.0e0/(6378245.0e0/sqrt(m)*cos(lat/180.0e0*pi())*pi()) AS d_lng, lng BETWEEN 72.004e0 AND 137.8347e0 AND lat BETWEEN 0.8293e0 AND 55.8271e0 AS inside FROM {out}_a),
{out} AS (SELECT c_custkey, CASE WHEN inside THEN lng + d_lng ELSE lng END AS lng, CASE WHEN inside THEN lat + d_lat ELSE lat END AS lat FROM {out}_b)"""


def _back_sql(src: str, out: str) -> str:
    return f"{_gcj_sql(src, out + '_f')},\n{out} AS (SELECT c_custkey, 2.0e0*s.lng - f.lng AS lng, 2.0e0*s.lat - f.lat AS lat FROM {src} s JOIN {out}_f f USING (c_custkey))"


def _bd_sql(src: str, out: str) -> str:
    return f"{out}_a AS (SELECT *, sqrt(lng*lng + lat*lat) + 0.00002e0*sin(lat*(pi()*3000.0e0/180.0e0)) AS z, atan2(lat, lng) + 0.000003e0*cos(lng*(pi()*3000.0e0/180.0e0)) AS t FROM {src}), {out} AS (SELECT c_custkey, z*cos(t) + 0.0065e0 AS lng, z*sin(t) + 0.006e0 AS lat FROM {out}_a)"


def _bd_back_sql(src: str, out: str) -> str:
    return f"{out}_a AS (SELECT c_custkey, lng - 0.0065e0 AS x, lat - 0.006e0 AS y FROM {src}), {out}_b AS (SELECT *, sqrt(x*x + y*y) - 0.00002e0*sin(y*(pi()*3000.0e0/180.0e0)) AS z, atan2(y, x) - 0.000003e0*cos(x*(pi()*3000.0e0/180.0e0)) AS t FROM {out}_a), {out} AS (SELECT c_custkey, z*cos(t) AS lng, z*sin(t) AS lat FROM {out}_b)"


def _rounded(spark, d, f) -> DataFrame:
    lng, lat = f(F.col("lng"), F.col("lat"))
    return points(spark, d).select("c_custkey", F.round(lng, 8).alias("lng"), F.round(lat, 8).alias("lat"))


_LAST = " SELECT c_custkey, round(lng, 8) AS lng, round(lat, 8) AS lat FROM o"


@query(f"WITH {POINTS}, {_gcj_sql('p', 'o')}{_LAST}")
def q_gcj02(spark, d):
    return _rounded(spark, d, X.wgs84_to_gcj02)


@query(f"WITH {POINTS}, {_back_sql('p', 'o')}{_LAST}")
def q_gcj02_inverse(spark, d):
    return _rounded(spark, d, X.gcj02_to_wgs84)


@query(f"WITH {POINTS}, {_bd_sql('p', 'o')}{_LAST}")
def q_bd09(spark, d):
    return _rounded(spark, d, X.gcj02_to_bd09)


@query(f"WITH {POINTS}, {_bd_back_sql('p', 'o')}{_LAST}")
def q_bd09_inverse(spark, d):
    return _rounded(spark, d, X.bd09_to_gcj02)


@query(f"WITH {POINTS}, {_gcj_sql('p', 'g')}, {_bd_sql('g', 'o')}{_LAST}")
def q_wgs84_bd09(spark, d):
    return _rounded(spark, d, lambda x, y: X.convert_coordinates("bd09", "wgs84", x, y))


@query(f"WITH {POINTS}, {_bd_back_sql('p', 'g')}, {_back_sql('g', 'o')}{_LAST}")
def q_bd09_wgs84(spark, d):
    return _rounded(spark, d, lambda x, y: X.convert_coordinates("wgs84", "bd09", x, y))


@query("SELECT c_custkey, lng NOT BETWEEN 72.004e0 AND 137.8347e0 OR lat NOT BETWEEN 0.8293e0 AND 55.8271e0 AS outside FROM (WITH " + POINTS + " SELECT * FROM p)")
def q_out_of_box(spark, d):
    return points(spark, d).select("c_custkey", (~X.in_box(F.col("lng"), F.col("lat"))).alias("outside"))


@query("SELECT event_id, event_id | 32 AS bit_on, event_id & ~CAST(1 AS BIGINT) AS bit_off, xor(event_id, 32) AS flipped, (event_id & 32) <> 0 AS tested FROM events")
def q_bits(spark, d):
    x = F.col("event_id")
    return table(spark, d, "events").select("event_id", X.bit_set(x, 5).alias("bit_on"), X.bit_clear(x, 0).alias("bit_off"), X.bit_toggle(x, 5).alias("flipped"), X.bit_test(x, 5).alias("tested"))


@query("SELECT event_id, event_id % 3 = 0 AS sci FROM events")
def q_sci_notation(spark, d):
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5E-3"))).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", X.is_scientific(s).alias("sci"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) <= 5")
def q_rate_limit(spark, d):
    return B.rate_limited(table(spark, d, "events"), [], "ts", ["ts", "event_id"], "1 hour", 5).select("event_id", "event_type")


@query("SELECT event_id, epoch_us(ts) // 1000000 - 28800 AS seconds, printf('%.6f', value) AS six, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k, 0.0e0 AS missing FROM events")
def q_dates_and_json(spark, d):
    s = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", X.epoch_seconds(s).alias("seconds"), X.fixed_six(F.col("value")).alias("six"), X.json_double(F.col("props"), "k").alias("k"), X.json_double(F.col("props"), "none").alias("missing"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_tumble(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts) - h * INTERVAL 12 HOUR AS window_start, count(*) AS n FROM events, unnest([0, 1]) AS g(h) GROUP BY ALL")
def q_hop(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "24 hours", "12 hours")
    return table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR, true) AS gap FROM events)) GROUP BY user_id, s""")
def q_session(spark, d):
    w = F.session_window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_id, value, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 DAY, ts) ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 3")
def q_window_topn(spark, d):
    day = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return B.top_n(day, "day", [F.desc("value"), F.col("event_id")], 3).select("day", "event_id", "value", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT n_name, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def q_join_inner(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def q_join_outer(spark, d):
    o, c = table(spark, d, "orders").filter("o_totalprice > 300000"), table(spark, d, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def q_semi(spark, d):
    o, c = table(spark, d, "orders").filter("o_totalprice > 100000"), table(spark, d, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q_anti(spark, d):
    o, c = table(spark, d, "orders").filter("o_totalprice > 300000"), table(spark, d, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey")


@query("(SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click') EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 150")
def q_setop(spark, d):
    e = table(spark, d, "events")
    of = lambda c: e.filter(c).select("user_id")
    return of("event_type = 'view'").intersect(of("event_type = 'click'")).subtract(of("event_type = 'error' AND value > 150"))


@query("SELECT event_type, user_id % 5 AS g, count(*) AS n FROM events GROUP BY CUBE (event_type, g)")
def q_cube(spark, d):
    return table(spark, d, "events").withColumn("g", F.col("user_id") % 5).cube("event_type", "g").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id)")
def q_rollup(spark, d):
    return table(spark, d, "events").rollup("event_type", "user_id").agg(F.count("*").alias("n"))


@query("""SELECT p.event_id, v.event_id AS right_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def q_asof(spark, d):
    of = lambda kind: table(spark, d, "events").filter(F.col("event_type") == kind).select("event_id", "ts", "user_id")
    return B.asof_join(of("purchase"), of("view"), "user_id", "ts", ["event_id"]).select("event_id", "right_event_id")


@query(ORACLES["q_asof"])
def q_asof_stretches(spark, d):
    """The same by stretches of a day, so that a key's rows are many tasks'."""
    of = lambda kind: table(spark, d, "events").filter(F.col("event_type") == kind).select("event_id", "ts", "user_id")
    return B.asof_join(of("purchase"), of("view"), "user_id", "ts", ["event_id"], stretch="1 day").select("event_id", "right_event_id")


@query("""SELECT event_id, count(*) OVER w AS nth, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, min(value) OVER w AS least, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def q_running_by_key(spark, d):
    cents = F.round(F.col("value") * 100).cast("bigint")
    out = B.running(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"nth": ("count", F.lit(1)), "cents": ("sum", cents), "least": ("min", "value"), "most": ("max", "value")})
    return out.select("event_id", "nth", "cents", "least", "most")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER w AS nth, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity FROM lineitem WINDOW w AS (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def q_running_all(spark, d):
    """Numbers and sums along a whole table, latest rows first, without a window over all of it."""
    order = [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = B.running(table(spark, d, "lineitem"), [], order, {"nth": ("count", F.lit(1)), "quantity": ("sum", F.col("l_quantity").cast("bigint"))})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "nth", "quantity")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + (i * INTERVAL 6 HOUR) AS window_end, count(*) AS n FROM events, unnest([1, 2, 3, 4]) AS g(i) WHERE ts < time_bucket(INTERVAL 1 DAY, ts) + (i * INTERVAL 6 HOUR) GROUP BY ALL""")
def q_cumulate(spark, d):
    return B.cumulate(table(spark, d, "events"), "ts", "6 hours", "1 day", [], [F.count("*").alias("n")])


@query("""SELECT 'INSERT INTO of_' || event_type || ' SELECT e.* FROM events e JOIN known_' || event_type || ' k ON e.user_id = k.user_id' AS statement, 'of_' || event_type AS target, 'events,known_' || event_type AS sources, count(*) AS n_rows FROM events GROUP BY event_type
UNION ALL SELECT 'WITH t AS (SELECT * FROM events) SELECT * FROM t, log_' || event_type, '', 'events,log_' || event_type, count(*) FROM events GROUP BY event_type""")
def q_lineage_tables(spark, d):
    """Two statements for each kind of event that the table has: what they write and read, and how many rows that kind has."""
    kinds = table(spark, d, "events").groupBy("event_type").count().collect()  # a row a kind
    made = [(s.format(k["event_type"]), k["count"]) for k in kinds for s in ("INSERT INTO of_{0} SELECT e.* FROM events e JOIN known_{0} k ON e.user_id = k.user_id", "WITH t AS (SELECT * FROM events) SELECT * FROM t, log_{0}")]
    found = [(x.statement, x.target or "", ",".join(sorted(x.sources)), n) for s, n in made for x in (table_lineage(spark, s),)]
    return spark.createDataFrame(found, "statement string, target string, sources string, n_rows long")


@query("SELECT o_orderkey, c_name FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def q_join_right(spark, d):
    o, c = table(spark, d, "orders").filter("o_totalprice > 300000"), table(spark, d, "customer").filter("c_acctbal > 0")
    return c.join(o, o.o_custkey == c.c_custkey, "right").select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal < 0) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey")
def q_join_full(spark, d):
    o, c = table(spark, d, "orders").filter("o_totalprice > 300000"), table(spark, d, "customer").filter("c_acctbal < 0")
    return c.join(o, o.o_custkey == c.c_custkey, "full").select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey > r_regionkey AND length(n_name) > length(r_name)")
def q_join_theta(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return n.join(r, (n.n_regionkey > r.r_regionkey) & (F.length("n_name") > F.length("r_name"))).select("r_name", "n_name")  # Spark broadcasts a side whose files are small


@query("SELECT a.r_name AS one, b.r_name AS other FROM region a CROSS JOIN region b")
def q_join_cross(spark, d):
    r = table(spark, d, "region")
    return r.select(F.col("r_name").alias("one")).crossJoin(r.select(F.col("r_name").alias("other")))  # 5 rows each


@query("SELECT p.event_id, v.event_id AS right_event_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts >= p.ts - INTERVAL 6 HOUR AND v.ts <= p.ts + INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND v.event_type = 'view'")
def q_join_interval(spark, d):
    of = lambda kind: table(spark, d, "events").filter(F.col("event_type") == kind).select("event_id", "ts", "user_id")
    return B.interval_join(of("purchase"), of("view"), "user_id", "ts", "6 hours", "1 hour").select("event_id", "right_event_id")


@query("SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT user_id FROM events WHERE event_type = 'click'")
def q_union(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'view'").select("user_id").union(e.filter("event_type = 'click'").select("user_id")).distinct()


@query("SELECT event_id, 'v' AS kind FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'c' FROM events WHERE event_type = 'click'")
def q_union_all(spark, d):
    e = table(spark, d, "events")
    of = lambda kind: e.filter(F.col("event_type") == kind).select("event_id", F.lit(kind[0]).alias("kind"))
    return of("view").unionByName(of("click"))


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT ALL SELECT user_id FROM events WHERE event_type = 'click'")
def q_intersect_all(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'view'").select("user_id").intersectAll(e.filter("event_type = 'click'").select("user_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def q_order_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10)


@query("SELECT DISTINCT l_returnflag, l_linestatus, month(l_shipdate) AS m FROM lineitem")
def q_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.month("l_shipdate").cast("bigint").alias("m")).distinct()


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) > 60 AND max(value) > 50")
def q_having(spark, d):
    got = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.max("value").alias("_most"))
    return got.filter("n > 60 AND _most > 50").drop("_most")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def q_grouping_sets(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("_halyard_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM _halyard_lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, lag(o_orderkey) OVER t AS before, lead(o_orderkey, 2) OVER t AS after, CAST(ntile(4) OVER t AS BIGINT) AS quarter, first_value(o_orderkey) OVER t AS first, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, round(percent_rank() OVER w, 9) AS share
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def q_rank_functions(spark, d):
    w, t = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = t.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return rows.select("o_orderkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("d"), F.lag("o_orderkey").over(t).alias("before"), F.lead("o_orderkey", 2).over(t).alias("after"), F.ntile(4).over(t).cast("bigint").alias("quarter"), F.first("o_orderkey").over(t).alias("first"), F.last("o_orderkey").over(whole).alias("last"), F.round(F.percent_rank().over(w), 9).alias("share"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS near FROM events")
def q_frames(spark, d):
    by = Window.partitionBy("user_id")
    day = by.orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(day).alias("day_n"), F.round(F.avg("value").over(by.orderBy("ts", "event_id").rowsBetween(-2, 1)), 6).alias("near"))


@query("SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y/%m/%d %H:%M:%S') AS shown, date_trunc('second', ts) AS local FROM events")
def q_format_epoch(spark, d):
    e = table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select("event_id", X.format_epoch_ms(ms, "yyyy/MM/dd HH:mm:ss").alias("shown"), X.local_time(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("local"))


@query(f"WITH {POINTS}, {_gcj_sql('p', 'o')} SELECT c_custkey, round(lng + d_lng, 8) AS lng, round(lat + d_lat, 8) AS lat FROM o_b")
def q_gcj02_everywhere(spark, d):
    return _rounded(spark, d, lambda x, y: X.wgs84_to_gcj02(x, y, check_box=False))


@query(f"WITH {POINTS}, {_bd_sql('p', 'o').replace('pi()*3000.0e0/180.0e0', 'pi()')} SELECT c_custkey, round(lng, 8) AS lng, round(lat, 8) AS lat FROM o")
def q_bd09_angle(spark, d):
    from math import pi

    return _rounded(spark, d, lambda x, y: X.gcj02_to_bd09(x, y, angle=pi))


def _script_events(spark, d, name: str) -> str:
    return _script_view(spark, d, "events", name)


@query("SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts) - h * INTERVAL 12 HOUR AS window_start, count(*) AS n FROM events, unnest([0, 1]) AS g(h) GROUP BY ALL")
def q_script_hop(spark, d):
    e = _script_events(spark, d, "hop")
    return spark.sql(rewrite_query(f"SELECT event_type, window_start, count(*) AS n FROM TABLE(HOP(TABLE {e}, DESCRIPTOR(ts), INTERVAL '12' HOURS, INTERVAL '24' HOURS)) GROUP BY event_type, window_start, window_end"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS n FROM events GROUP BY ALL")
def q_script_tumble(spark, d):
    e = _script_events(spark, d, "tumble")
    return spark.sql(rewrite_query(f"SELECT event_type, TUMBLE_START(ts, INTERVAL '1' DAY) AS window_start, TUMBLE_END(ts, INTERVAL '1' DAY) AS window_end, count(*) AS n FROM {e} GROUP BY event_type, TUMBLE(ts, INTERVAL '1' DAY)"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + (i * INTERVAL 6 HOUR) AS window_end, count(*) AS n FROM events, unnest([1, 2, 3, 4]) AS g(i) WHERE ts < time_bucket(INTERVAL 1 DAY, ts) + (i * INTERVAL 6 HOUR) GROUP BY ALL""")
def q_script_cumulate(spark, d):
    e = _script_events(spark, d, "cumulate")
    return spark.sql(rewrite_query(f"SELECT window_start, window_end, count(*) AS n FROM TABLE(CUMULATE(TABLE {e}, DESCRIPTOR(ts), INTERVAL '6' HOUR, INTERVAL '1' DAY)) GROUP BY window_start, window_end"))


@query("""SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR, true) AS gap FROM events)) GROUP BY user_id, s""")
def q_script_session(spark, d):
    e = _script_events(spark, d, "session")
    return spark.sql(rewrite_query(f"SELECT user_id, window_start, window_end, count(*) AS n FROM TABLE(SESSION(TABLE {e} PARTITION BY user_id, DESCRIPTOR(ts), INTERVAL '1' HOUR)) GROUP BY user_id, window_start, window_end"))


@query("""SELECT event_id, min(ts) OVER (PARTITION BY s) AS window_start, max(ts) OVER (PARTITION BY s) + INTERVAL 5 MINUTE AS window_end FROM (SELECT *, sum(gap) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT event_id, ts, CAST(coalesce(ts > lag(ts) OVER (ORDER BY ts, event_id) + INTERVAL 5 MINUTE, true) AS INTEGER) AS gap FROM events))""")
def q_script_session_all(spark, d):
    """A session table without keys, whose sessions run over the borders of range partitions."""
    e = _script_events(spark, d, "sessions")
    return Runner(spark).execute(f"SELECT event_id, window_start, window_end FROM TABLE(SESSION(TABLE {e}, DESCRIPTOR(ts), INTERVAL '5' MINUTE))")


def _script(spark, d, streaming: bool) -> DataFrame:
    """A script with a source, two stored sinks and a statement set; the rows of both sinks."""
    name, where = f"s{uuid.uuid4().hex}", scratch(spark, "script")
    source = f"{d}/events.parquet"
    if streaming:  # a stream reads a folder
        source = f"{where}/in"
        table(spark, d, "events").write.parquet(source)
    runner = Runner(spark, {"t": name, "in": source}, streaming, f"{where}/checkpoints", warehouse=where)
    runner.run("""SET table.sql-dialect=default;
CREATE TABLE ${t}_src (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING, seen AS CAST(event_id AS BIGINT)/10, WATERMARK FOR ts AS ts - INTERVAL '5' SECOND) WITH ('connector'='filesystem', 'path'='${in}', 'format'='parquet');
SET table.sql-dialect=hive;
CREATE TABLE ${t}_a (event_id BIGINT, kind STRING) PARTITIONED BY (dt STRING) STORED AS parquet TBLPROPERTIES ('sink.partition-commit.trigger'='partition-time', 'sink.partition-commit.delay'='1 h');
CREATE TABLE ${t}_b (event_id BIGINT, kind STRING) STORED AS orc;
CREATE TABLE ${t}_gone (x INT);
DROP TABLE ${t}_gone;
BEGIN STATEMENT SET;
INSERT INTO ${t}_a SELECT event_id, event_type, DATE_FORMAT(ts, 'yyyy-MM-dd') FROM ${t}_src WHERE value > 50;
INSERT INTO ${t}_b (kind, event_id) SELECT concat('b ', event_type), seen FROM ${t}_src WHERE user_id < 5;
END;
""")
    runner.wait(0)
    a = spark.read.option("recursiveFileLookup", "true").parquet(f"{where}/{name}_a") if streaming else spark.table(f"{name}_a")
    b = spark.read.schema("event_id BIGINT, kind STRING").orc(f"{where}/{name}_b")
    out = a.select("event_id", "kind").union(b)
    return out


_SCRIPT_SQL = "SELECT event_id, event_type AS kind FROM events WHERE value > 50 UNION ALL SELECT event_id // 10, concat('b ', event_type) FROM events WHERE user_id < 5"


@query(_SCRIPT_SQL)
def q_script_batch(spark, d):
    return _script(spark, d, False)


@query(_SCRIPT_SQL)
def q_script_stream(spark, d):
    return _script(spark, d, True)


@query("SELECT event_id AS a, user_id AS b FROM events WHERE event_type = 'click' UNION ALL SELECT 1, 2 UNION ALL SELECT event_id, event_id + user_id FROM events WHERE event_type = 'view'")
def q_script_insert(spark, d):
    name, where, events = f"i{uuid.uuid4().hex}", scratch(spark, "script"), _script_events(spark, d, "insert")
    runner = Runner(spark, {"t": name, "e": events}, warehouse=where)
    runner.run("""SET table.sql-dialect=hive;
CREATE TABLE ${t} (a BIGINT, b BIGINT);
INSERT INTO ${t} SELECT event_id, value FROM ${e};
INSERT OVERWRITE ${t} (b, a) SELECT user_id, event_id FROM ${e} WHERE event_type = 'click';
INSERT INTO ${t} VALUES (1, 2);
INSERT INTO ${t} WITH x AS (SELECT event_id AS p, event_id + user_id AS q FROM ${e} WHERE event_type = 'view') SELECT p, q FROM x;
""")
    return spark.table(name)


def _script_view(spark, d, source: str, name: str | None = None) -> str:
    view = f"{name or source}_{uuid.uuid4().hex}"
    table(spark, d, source).createOrReplaceTempView(view)
    return view


@query("""SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, 'none' AS missing, json_exists(props, '$.k') AS has, event_type AS kind, CASE WHEN event_type = 'error' THEN -1 ELSE CAST(floor(value) AS INTEGER) END AS whole, concat('["', event_type, '"]') AS kinds FROM events""")
def q_script_json_functions(spark, d):
    e = _script_view(spark, d, "events")
    return spark.sql(rewrite_query(f"""SELECT event_id, JSON_VALUE(props, '$.k' RETURNING INTEGER) AS k, JSON_VALUE(props, 'lax $.z' DEFAULT 'none' ON EMPTY) AS missing, JSON_EXISTS(props, '$.k') AS has,
JSON_VALUE(j, '$.a[0]') AS kind, JSON_VALUE(j, '$.v' RETURNING INTEGER DEFAULT -1 ON ERROR) AS whole, JSON_QUERY(j, '$.a') AS kinds
FROM (SELECT event_id, props, concat('{{"a": ["', event_type, '"], "v": ', CASE WHEN event_type = 'error' THEN '"none"' ELSE CAST(CAST(floor(value) AS INT) AS STRING) END, '}}') AS j FROM {e}) AS x"""))


@query("""SELECT c_custkey, split_part(c_name, '#', 2) AS number, CAST(NULL AS VARCHAR) AS outside, regexp_extract(c_name, '^[A-Za-z]+') AS word, CASE WHEN regexp_matches(c_name, '([1-9])[0-9]$') THEN regexp_extract(c_name, '([1-9])[0-9]$', 1) END AS ten,
regexp_full_match(c_mktsegment, '[A-Z]+') AS letters, true AS digits, c_mktsegment AS segment, sha256(c_name) AS digest, c_name AS back, CASE WHEN c_nationkey > 5 THEN greatest(c_nationkey, 10) END AS most, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer""")
def q_script_text_functions(spark, d):
    c = _script_view(spark, d, "customer")
    return spark.sql(rewrite_query(f"""SELECT c_custkey, SPLIT_INDEX(c_name, '#', 1) AS number, SPLIT_INDEX(c_name, '#', 2) AS outside, REGEXP_EXTRACT(c_name, '^[A-Za-z]+') AS word, REGEXP_EXTRACT(c_name, '([1-9])[0-9]$', 1) AS ten,
IS_ALPHA(c_mktsegment) AS letters, IS_DIGIT(SPLIT_INDEX(c_name, '#', 1)) AS digits, STR_TO_MAP(concat('name=', c_name, ',segment=', c_mktsegment))['segment'] AS segment, SHA256(c_name) AS digest, FROM_BASE64(TO_BASE64(c_name)) AS back,
GREATEST(CASE WHEN c_nationkey > 5 THEN c_nationkey END, 10) AS most, CAST(TRUNCATE(c_acctbal) AS BIGINT) AS whole FROM {c}"""))


@query("""SELECT event_id, datediff('day', TIMESTAMP '2023-12-31', ts) * 24 + hour(ts) AS hours, strftime(ts, '%Y/%m/%d') AS day, CAST(NULL AS VARCHAR) AS none, strftime(timezone('Asia/Shanghai', to_timestamp(event_id * 100000)), '%Y-%m-%d %H:%M:%S') AS east,
CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, date_trunc('hour', ts) AS floored, CASE WHEN ts = date_trunc('day', ts) THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS ceiled, CAST(weekofyear(ts) AS INTEGER) AS week, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tokyo,
CAST(datesub('month', TIMESTAMP '2023-01-31', ts) AS BIGINT) AS months FROM events""")
def q_script_time_functions(spark, d):
    e = _script_view(spark, d, "events")
    return spark.sql(rewrite_query(f"""SELECT event_id, TIMESTAMPDIFF(HOUR, CAST('2023-12-31 00:00:00' AS TIMESTAMP(3)), ts) AS hours, DATE_FORMAT(CAST(ts AS STRING), 'yyyy/MM/dd') AS day, DATE_FORMAT(event_type, 'yyyy') AS none,
FROM_UNIXTIME(event_id * 100000, 'yyyy-MM-dd HH:mm:ss', 'Asia/Shanghai') AS east, UNIX_TIMESTAMP(DATE_FORMAT(ts, 'dd.MM.yyyy HH:mm:ss'), 'dd.MM.yyyy HH:mm:ss') AS seconds, FLOOR(ts TO HOUR) AS floored, CEIL(ts TO DAY) AS ceiled, WEEK(ts) AS week,
CONVERT_TZ(CAST(ts AS STRING), 'UTC', 'Asia/Tokyo') AS tokyo, TIMESTAMPDIFF(MONTH, TIMESTAMP '2023-01-31 00:00:00', ts) AS months FROM {e}"""))


@query("""SELECT l_orderkey, CAST(count(*) AS INTEGER) AS lines, list_sort(list(l_linenumber))[1] AS first, CAST(least(count(*), 3) AS INTEGER) AS cut, CASE WHEN count(*) = 1 THEN min(l_partkey) END AS only, CAST(count(*) * 2 AS INTEGER) AS twice, max(l_partkey) AS part, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey""")
def q_script_collection_functions(spark, d):
    """Arrays of an order's lines: sizes, places, slices and the only entry."""
    i = _script_view(spark, d, "lineitem")
    return spark.sql(rewrite_query(f"""SELECT l_orderkey, CARDINALITY(ns) AS lines, ns[1] AS first, CARDINALITY(ARRAY_SLICE(ns, 1, 3)) AS cut, ELEMENT(CASE WHEN CARDINALITY(ps) = 1 THEN ps END) AS only, CARDINALITY(ARRAY_CONCAT(ns, ARRAY_REVERSE(ns))) AS twice,
CAST(ROW(top, flags) AS ROW<part BIGINT, flags STRING>).part AS part, flags
FROM (SELECT l_orderkey, sort_array(collect_list(l_linenumber)) AS ns, collect_list(l_partkey) AS ps, max(l_partkey) AS top, LISTAGG(DISTINCT l_returnflag, '|') WITHIN GROUP (ORDER BY l_returnflag) AS flags FROM {i} GROUP BY l_orderkey) AS x"""))


#: Whether a micro-batch without rows follows, for what the watermark lets go.
_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def _replayed(spark, name: str, build, *sources: tuple[DataFrame, list], write=None) -> DataFrame:
    """What a stream gives. sources: frames and conditions; the k-th condition's rows of all frames come together, as files of a folder of their own, and are one
    micro-batch of one run of the query, which goes on from its checkpoint; the last run ends with what the watermark then lets go. build: the stream's operators, from a stream per frame. write: starts another sink."""
    where = scratch(spark, name)
    streams = []
    for k, (df, _) in enumerate(sources):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/in{k}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        streams.append(spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{where}/in{k}"))
    out = build(*streams)
    runs = len(sources[0][1])
    idle = spark.conf.get(_IDLE)
    try:
        for n in range(runs):
            for k, (df, cuts) in enumerate(sources):
                df.filter(cuts[n]).write.parquet(f"{where}/in{k}/cut{n}")
            spark.conf.set(_IDLE, str(n == runs - 1).lower())
            writer = out.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
            with state_in_rocksdb(spark):
                if write is not None:
                    write(writer, where)
                else:
                    writer.format("parquet").option("path", f"{where}/out").outputMode("append").start().awaitTermination()
    finally:
        spark.conf.set(_IDLE, idle)
    return spark.read.schema(out.schema).parquet(f"{where}/out")


def _updates(writer, where: str) -> None:
    """A sink for update mode: all rows that the stream ever gave."""
    writer.outputMode("update").foreachBatch(lambda batch, batch_id: batch.write.mode("append").parquet(f"{where}/out")).start().awaitTermination()


@query("""SELECT event_type, window_start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, (SELECT max(ts) FROM events) AS latest FROM events WHERE ts >= TIMESTAMP '2024-01-15') WHERE window_start + INTERVAL 1 DAY <= latest - INTERVAL 12 HOUR GROUP BY ALL""")
def q_watermark_late(spark, d):
    """Rows of early days come in a third micro-batch, behind the watermark of the first, and count nowhere; windows that it hasn't passed are not given yet."""
    events = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    recent = F.col("ts") >= "2024-01-15"
    w = F.window("ts", "1 day")
    build = lambda e: e.withWatermark("ts", "12 hours").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("window_start"), "n")
    out = _replayed(spark, "late", build, (events, [recent & (F.col("event_id") % 2 == 0), recent & (F.col("event_id") % 2 == 1), ~recent]))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT event_type, window_start, rn AS total FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 5 = 0""")
def q_count_trigger_stream(spark, d):
    events = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    build = lambda e: stateful.count_trigger_stream(e.withWatermark("ts", "40 days"), "event_type", "ts", "1 day")
    return _replayed(spark, "counts", build, (events, [F.col("ts") < "2024-01-15", F.col("ts") >= "2024-01-15"])).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(ORACLES["q_delta_trigger"].replace("SELECT user_id, event_id, n, firing FROM s", "SELECT user_id, n, firing FROM s"))
def q_delta_trigger_stream(spark, d):
    build = lambda e: stateful.delta_trigger_stream(e, "user_id", "path", ["ts", "event_id"])
    return _replayed(spark, "delta", build, (odometer(spark, d), [F.col("ts") < "2024-01-10", F.col("ts") >= "2024-01-10"]))


@query("SELECT event_id, 'map_to_string' AS name, 'udf' AS kind, 'map_to_string(m MAP<STRING, STRING>)' AS invocation, 'STRING' AS returns, concat('k=', event_type) AS shown FROM events")
def q_function_catalog(spark, d):
    """What the catalogue says of a function, and what the function, called by that name, makes of each row."""
    register_functions(spark)
    told = catalog_frame(spark).filter("name = 'map_to_string'").first()
    shown = F.expr(f"{told['name']}(map('k', event_type))")
    return table(spark, d, "events").select("event_id", *[F.lit(told[c]).alias(c) for c in ("name", "kind", "invocation", "returns")], shown.alias("shown"))


@query("""WITH v AS (SELECT * FROM (VALUES ('o_custkey', 'who', true), ('o_totalprice', 'price', false), ('o_custkey', 'price', false)) AS v(source_column, sink_column, plain)),
n AS (SELECT 'o_custkey' AS source_column, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) FROM orders) SELECT source_column, sink_column, plain, n FROM v JOIN n USING (source_column)""")
def q_lineage_columns(spark, d):
    """Which columns an insert's columns come from, and how many different values each of these has."""
    source, sink = f"lin_{uuid.uuid4().hex}", f"lin_{uuid.uuid4().hex}"
    orders = table(spark, d, "orders")
    orders.createOrReplaceTempView(source)
    spark.range(0).select(F.lit(1).alias("who"), F.lit(1.0).alias("price")).createOrReplaceTempView(sink)
    found = insert_lineage(spark, f"INSERT INTO {sink} SELECT o_custkey, o_totalprice + o_custkey FROM {source}")
    edges = spark.createDataFrame([(x.source_column, x.sink_column, x.transform is None) for x in found], "source_column string, sink_column string, plain boolean")
    names = sorted({x.source_column for x in found})
    counts = orders.agg(*[F.count_distinct(c).alias(c) for c in names]).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("source_column", "n"))
    return edges.join(counts, "source_column").select("source_column", "sink_column", "plain", "n")


@query("""WITH e AS (SELECT *, sign(value - lag(value) OVER w) AS way, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, way ORDER BY k) AS island FROM e WHERE way IS NOT NULL),
runs AS (SELECT user_id, way, min(k) AS a, max(k) AS b, count(*) AS n, min_by(event_id, k) AS first, max_by(event_id, k) AS last, max(value) AS most FROM r GROUP BY user_id, way, island)
SELECT u.user_id, u.first AS first_event, d.last AS last_event, u.n AS n_up, d.n AS n_down, u.most AS peak FROM runs u JOIN runs d ON u.user_id = d.user_id AND u.way = 1 AND d.way = -1 AND d.a = u.b + 1""")
def q_row_pattern(spark, d):
    """A rise and then a fall of a user's values, each as long as it goes."""
    keys, order = ["user_id"], ["ts", "event_id"]
    last = patterns.before("value", keys, order)
    rows = patterns.match_rows(table(spark, d, "events"), keys, order, "UP+ DOWN+", {"UP": F.col("value") > last, "DOWN": F.col("value") < last})
    up = F.col("variable") == "UP"
    return rows.groupBy("user_id", "match_no").agg(F.min_by("event_id", "nth").alias("first_event"), F.max_by("event_id", "nth").alias("last_event"), F.count_if(up).alias("n_up"), F.count_if(~up).alias("n_down"), F.max(F.when(up, F.col("value"))).alias("peak")).drop("match_no")


def _timed(spark, d, kind: str | None = None) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return events if kind is None else events.filter(F.col("event_type") == kind).select("event_id", "ts", "user_id")


#: Two micro-batches that overlap by a day and a half: rows of the second come late, but within two days.
_EARLY = "(ts < '2024-01-13 12:00:00' OR ts < '2024-01-15' AND event_id % 2 = 0)"
_CUTS = [_EARLY, f"NOT {_EARLY}"]


def _passed(*kinds: str) -> str:
    """SQL of the watermark in the end: two days behind the least of the kinds' latest times, in milliseconds."""
    return "least(" + ", ".join(f"(SELECT max(epoch_ms(ts)) FROM events{f' WHERE event_type = {k!r}' if k else ''})" for k in kinds) + ") - 172800000"


@query(ORACLES["q_join_interval"])
def q_join_interval_stream(spark, d):
    late = lambda s: s.withWatermark("ts", "2 days")
    build = lambda p, v: interval_join_stream(late(p), late(v), "user_id", "ts", "6 hours", "1 hour").select("event_id", "right_event_id")
    return _replayed(spark, "interval", build, (_timed(spark, d, "purchase"), _CUTS), (_timed(spark, d, "view"), _CUTS))


@query(f"""SELECT p.event_id, v.event_id AS right_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND v.ts >= p.ts - INTERVAL 6 HOUR AND v.ts <= p.ts + INTERVAL 1 HOUR
WHERE v.event_id IS NOT NULL OR epoch_us(p.ts) + 3600000000 <= ({_passed('purchase', 'view')}) * 1000""")
def q_join_interval_outer_stream(spark, d):
    """Rows without a partner are given when the watermark has passed what they could meet; those of the last two days wait."""
    late = lambda s: s.withWatermark("ts", "2 days")
    build = lambda p, v: interval_join_stream(late(p), late(v), "user_id", "ts", "6 hours", "1 hour", "left").select("event_id", "right_event_id")
    return _replayed(spark, "interval-outer", build, (_timed(spark, d, "purchase"), _CUTS), (_timed(spark, d, "view"), _CUTS))


@query(f"SELECT a.* FROM ({ORACLES['q_asof']}) a JOIN events p USING (event_id) WHERE epoch_us(p.ts) <= ({_passed('purchase', 'view')}) * 1000")
def q_temporal_join_stream(spark, d):
    late = lambda s: s.withWatermark("ts", "2 days")
    build = lambda p, v: temporal_join_stream(late(p), late(v), "user_id", "ts", ["event_id"], ["event_id"]).select("event_id", "right_event_id")
    return _replayed(spark, "temporal", build, (_timed(spark, d, "purchase"), _CUTS), (_timed(spark, d, "view"), _CUTS))


@query(f"""SELECT event_id, nth, round(running_sum, 3) AS running_sum, round(near_avg, 6) AS near_avg FROM (SELECT event_id, ts, row_number() OVER w AS nth, sum(value) OVER w AS running_sum, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near_avg
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE epoch_us(ts) <= ({_passed('')}) * 1000""")
def q_over_stream(spark, d):
    build = lambda e: over_stream(e.withWatermark("ts", "2 days"), ["user_id"], "ts", ["event_id"], "value", 2)
    out = _replayed(spark, "over", build, (_timed(spark, d), _CUTS))
    return out.select("event_id", "nth", F.round("running_sum", 3).alias("running_sum"), F.round("near_avg", 6).alias("near_avg"))


@query("""SELECT event_id, kind, nth, round(total, 3) AS total, round(day_avg, 6) AS day_avg, n_near, most_near, first_kind, kind_before FROM (SELECT event_id, ts, event_type AS kind, row_number() OVER w AS nth, sum(value) OVER w AS total,
avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_avg, count(*) OVER near AS n_near, max(ts) OVER near AS most_near,
first_value(event_type) OVER near AS first_kind, lag(event_type, 2) OVER w AS kind_before
FROM events WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), near AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) FROM events WHERE event_type <> 'view') - 172800000000""")
def q_script_over_stream(spark, d):
    """OVER of a script on a stream whose rows come out of order: numbers, running sums, frames of rows and of time, earlier values. Spark filters before it takes the watermark."""
    view = f"over_{uuid.uuid4().hex}"

    def build(e):
        e.withWatermark("ts", "2 days").createOrReplaceTempView(view)
        near = "OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
        return Runner(spark, streaming=True).execute(f"""SELECT event_id, kind, nth, total, day_avg, n_near, most_near, first_kind, kind_before FROM (
SELECT *, event_type AS kind, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) AS nth, SUM(`value`) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total,
AVG(`value`) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_avg, COUNT(*) {near} AS n_near, MAX(ts) {near} AS most_near,
FIRST_VALUE(event_type) {near} AS first_kind, LAG(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts) AS kind_before FROM {view} WHERE event_type <> 'view') AS x""")

    out = _replayed(spark, "overs", build, (_timed(spark, d), _CUTS))
    return out.withColumns({"total": F.round("total", 3), "day_avg": F.round("day_avg", 6), "most_near": F.col("most_near").cast("timestamp_ntz")})


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 5 AND epoch_us(ts) <= ({_passed('')}) * 1000")
def q_rate_limit_stream(spark, d):
    build = lambda e: rate_limited_stream(e.withWatermark("ts", "2 days"), [], "ts", ["event_id"], "1 hour", 5).select("event_id", "event_type")
    return _replayed(spark, "rate", build, (_timed(spark, d), _CUTS))


@query("""WITH c AS (SELECT *, ts < TIMESTAMP '2024-01-20' AS had, event_id % 3 = 0 OR value > 120 AS gone FROM events),
r AS (SELECT event_type, value FROM c WHERE NOT (had AND gone))
SELECT k.event_type, count(value) AS n, count(DISTINCT value) AS kinds, min(value) AS least, max(value) AS most, list_sort(list(value) FILTER (value IS NOT NULL), 'DESC')[2] AS second FROM (SELECT DISTINCT event_type FROM events) k LEFT JOIN r USING (event_type) GROUP BY k.event_type""")
def q_changelog_aggregates(spark, d):
    """Early rows, then later ones together with what is taken back of the early ones: a third of them, and all high values."""
    e = _timed(spark, d)
    gone = (F.col("ts") < "2024-01-20") & ((F.col("event_id") % 3 == 0) | (F.col("value") > 120))
    changes = e.withColumn("op", F.lit("+")).unionByName(e.filter(gone).withColumn("op", F.lit("-")))
    cuts = [(F.col("ts") < "2024-01-20") & (F.col("op") == "+"), (F.col("ts") >= "2024-01-20") | (F.col("op") == "-")]
    build = lambda s: changelog_aggregates(s, "event_type", "value", F.col("op") == "-")
    out = _replayed(spark, "changelog", build, (changes, cuts), write=_updates)
    return B.keep_last(out, "event_type", ["changes"]).drop("changes")


@query("""WITH w AS (SELECT max(epoch_ms(ts)) - 43200000 AS first FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_id % 2 = 0), u AS (SELECT max(epoch_ms(ts)) - 43200000 AS last FROM events WHERE ts >= TIMESTAMP '2024-01-10' OR event_id % 2 = 1),
e AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start, epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) + 86400000 AS ends, ts >= TIMESTAMP '2024-01-10' AND event_id % 2 = 0 AS early FROM events WHERE ts >= TIMESTAMP '2024-01-10' OR event_id % 2 = 1),
r AS (SELECT *, NOT early AND ends <= first AS late, NOT early AND ends + 1036800000 <= first AS lost FROM e, w),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, window_start ORDER BY late, ts, event_id) AS n, round(sum(value) OVER (PARTITION BY event_type, window_start ORDER BY late, ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total, count(*) OVER (PARTITION BY event_type, window_start) AS alls, count_if(NOT late) OVER (PARTITION BY event_type, window_start) AS timely FROM r WHERE NOT lost)
SELECT event_type, window_start, n, total, CASE WHEN late THEN n - timely + CAST(timely > 0 AS INTEGER) ELSE 1 END AS firing, NULL AS late_id FROM k, u WHERE late OR n = timely AND ends <= last
UNION ALL SELECT event_type, window_start, NULL, NULL, NULL, event_id FROM r WHERE lost""")
def q_allowed_lateness(spark, d):
    """Windows of a day, twelve days of lateness. The second micro-batch has rows in time, late rows that fire their window again, and rows for the side output."""
    early = (F.col("ts") >= "2024-01-10") & (F.col("event_id") % 2 == 0)
    cuts = [early, (F.col("event_id") % 2 == 1)]
    build = lambda e: windows_with_lateness(e.withWatermark("ts", "12 hours"), ["event_type"], "ts", ["event_id"], "value", "1 day", "12 days")
    out = _replayed(spark, "lateness", build, (_timed(spark, d), cuts))
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"), "firing", F.get_json_object("late_row", "$.event_id").cast("bigint").alias("late_id"))


@query("SELECT 'a' AS sink, event_id, event_type AS dt FROM events UNION ALL SELECT 'b', event_id, NULL FROM events WHERE value > 50")
def q_exactly_once_stream(spark, d):
    """Two sinks of one stream, the second of which fails once in each micro-batch, when the first has written: restarted, both have each row once."""
    failed: set[int] = set()

    def write(writer, where: str) -> None:
        ledger = Ledger(spark, f"{where}/ledger")
        a, b = OnceFiles(f"{where}/a", ledger, partition=["dt"]), OnceFiles(f"{where}/b", ledger)

        def broken(batch: DataFrame, batch_id: int) -> None:
            if batch_id not in failed:
                failed.add(batch_id)
                raise OSError("the other side is down")
            b(batch.filter("value > 50"), batch_id)

        each = fan_out([lambda batch, batch_id: a(batch, batch_id), broken])
        supervised(lambda: writer.foreachBatch(each).start(), 3, 0)
        spark.read.parquet(f"{where}/a").select(F.lit("a").alias("sink"), "event_id", F.col("dt").cast("string").alias("dt")).unionByName(spark.read.parquet(f"{where}/b").select(F.lit("b").alias("sink"), "event_id", F.lit(None).cast("string").alias("dt"))).write.mode("overwrite").parquet(f"{where}/out")

    rows = _timed(spark, d).withColumn("dt", F.col("event_type"))
    where: list[str] = []
    _replayed(spark, "once", lambda s: s, (rows, [F.col("ts") < "2024-01-15", F.col("ts") >= "2024-01-15"]), write=lambda writer, at: (where.append(at), write(writer, at)))
    return spark.read.parquet(f"{where[0]}/out")


@query("""SELECT 'earliest' AS mode, event_id FROM events UNION ALL SELECT 'latest', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'
UNION ALL SELECT 'group', event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' UNION ALL SELECT 'same group', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'""")
def q_startup_modes(spark, d):
    """Files of JSON lines, one half written before the queries first run and one after; the last query is a new one of the group."""
    where = scratch(spark, "startup")
    events = table(spark, d, "events").select("event_id", "ts")
    runs = [("earliest", "earliest-offset", None, (0, 1)), ("latest", "latest-offset", None, (0, 1)), ("group", "group-offsets", "g", (0,)), ("same group", "group-offsets", "g", (1,))]
    for n, half in enumerate(("ts < '2024-01-15'", "ts >= '2024-01-15'")):
        events.filter(half).write.mode("append").json(f"{where}/in")
        for name, mode, group, when in runs:
            if n in when:
                rows = lines_stream(spark, f"{where}/in", mode, group).select(F.lit(name).alias("mode"), F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"))
                q = rows.writeStream.format("parquet").option("path", f"{where}/{name}").option("checkpointLocation", f"{where}/checkpoint {name}").trigger(availableNow=True).start()
                q.awaitTermination()
                if group:
                    keep_place(q, f"{where}/in", group)
    out = [spark.read.schema("mode string, event_id long").parquet(f"{where}/{name}") for name, *_ in runs]
    return out[0].union(out[1]).union(out[2]).union(out[3])
