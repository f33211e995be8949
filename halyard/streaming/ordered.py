"""Operators that need a key's rows in the order of event time: rows wait until the watermark has passed them, then a fold takes them one by one.

Keys are dealt to a fixed number of groups by their hash, as each call to a state takes a way to the JVM and back. State of a group: the rows
inside the watermark's delay, in chunks, and what the fold remembers of each of its keys, a small JSON value. Rows that come behind the watermark are
dropped, as by Spark's own operators. Rows and keys travel as JSON between Spark and the fold, so any schema goes with one state layout.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from halyard.streaming.mapstate import PROVIDER

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: Groups that keys are dealt to. A group's known keys are written anew whenever rows of it are given, and its waiting rows are read into a task: with very many
#: keys or rows inside the delay take more. A checkpoint belongs to the number that it was begun with.
GROUPS = 1 << 12
#: Rows of a chunk of waiting rows, and of a frame that goes back to Spark.
CHUNK = 1 << 12

#: A fold: what a key remembers (None at first) and its next row as a dict give what it remembers now, and the values of one output row, or None.
Fold = Callable[[object, dict], tuple[object, tuple | None]]


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which processors with lists, maps and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def packed(*columns: Column) -> Column:
    """Columns as one JSON object, nulls included, times to the microsecond."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", **_FORMATS})


def unpacked(body: Column, schema: T.StructType) -> Column:
    return F.from_json(body, schema, _FORMATS)


def _sortable(tie: str) -> list:
    """Nulls come first, as in Spark's windows."""
    return [(v is not None, v if v is not None else 0) for v in json.loads(tie).values()]


def dealt(keys: list[Column], kinds: list[str], groups: int = GROUPS) -> list[Column]:
    """_group and key: the number of a key's group, and the key as JSON. Spark's groups don't tell -0.0 from 0.0."""
    key = packed(*[(k + F.lit(0).cast(kind) if kind in ("float", "double") else k).alias(f"k{n}") for n, (k, kind) in enumerate(zip(keys, kinds))]) if keys else F.lit("{}")
    return [F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_group"), key.alias("key")]


class _Ordered(StatefulProcessor):
    """Gives _key and the fold's values."""

    def __init__(self, fold: Fold, columns: list[str]) -> None:
        self.fold, self.columns = fold, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk string")
        self.known = handle.getValueState("known", "value string")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Rows ahead of the watermark wait. Those that it has passed are given by the group's timer, which comes after the input."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = None
        for frame in rows:
            frame = frame[frame["us"] > passed]
            if len(frame):
                self.waiting.appendList(_chunks(list(zip(*(frame[c].tolist() for c in ("key", "us", "rank", "tie", "body"))))))
                least = int(frame["us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        yield pd.DataFrame([], columns=self.columns, dtype=object)

    def _wake(self, us: int) -> None:
        """One timer a group: at its earliest waiting row."""
        ms = -(-us // 1000)
        before = self.due.get() if self.due.exists() else None
        if before is None or ms < before[0]:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.due.update((ms,))
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for (chunk,) in self.waiting.get():
            for row in json.loads(chunk):
                (ready if row[1] <= passed else rest).append(row)
        ready.sort(key=lambda r: (r[0], r[1], r[2], _sortable(r[3])))
        known = json.loads(self.known.get()[0]) if self.known.exists() else {}
        out = []
        for k, same in groupby(ready, key=lambda r: r[0]):
            known[k], given = self.folded(known.get(k), [tuple(r[1:]) for r in same])
            out.extend((k, *values) for values in given)
        self.known.update((json.dumps(known),))
        self.due.clear()
        if rest:
            self.waiting.put(_chunks(rest))
            self._wake(min(r[1] for r in rest))
        else:
            self.waiting.clear()
        for n in range(0, len(out), CHUNK):
            yield pd.DataFrame(out[n : n + CHUNK], columns=self.columns, dtype=object)

    def folded(self, state, ready: list[tuple]) -> tuple[object, list[tuple]]:
        """What the key remembers after its next rows, which are in order, and the values of the output rows."""
        out = []
        for us, rank, _, body in ready:
            state, given = self.fold(state, {"_us": us, "_rank": rank, "_body": body})
            if given is not None:
                out.append(given)
        return state, out

    def close(self) -> None:
        pass


def _chunks(rows: list) -> list[tuple[str]]:
    return [(json.dumps(rows[n : n + CHUNK]),) for n in range(0, len(rows), CHUNK)]


def in_order(df: DataFrame, keys: list[str], ts: str, order: list[str], fold: Fold, returns: str, body: list[str] | None = None, rank: Column | None = None, apart: list[str] | None = None, groups: int = GROUPS) -> DataFrame:
    """keys and the columns of `returns` (DDL): what fold gives for each row of a key, in the order of ts, rank and `order`.

    df needs a watermark on ts. A row is given when the watermark has passed it, so late rows inside its delay are in their place. fold gets
    dicts with _us (microseconds), _rank and _body (JSON of the columns `body`, by default all); json.loads() it where it is needed. Null keys are a key.
    apart: those of the keys whose values never share a group, so that what is known of old ones isn't touched again.
    """
    names = df.columns if body is None else body
    kinds = dict(df.dtypes)
    by = [F.col(f"`{k}`").alias(f"_by{n}") for n, k in enumerate(apart or [])]
    rows = df.select(
        *dealt([F.col(f"`{k}`") for k in keys], [kinds[k] for k in keys], groups),
        *by,
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        (rank if rank is not None else F.lit(0)).cast("int").alias("rank"),
        packed(*[F.col(f"`{c}`") for c in order]).alias("tie"),
        packed(*[F.col(f"`{c}`") for c in names]).alias("body"),
    ).filter("us is not null")
    values = [f.name for f in T.StructType.fromDDL(returns).fields]
    group = ["_group", *(f"_by{n}" for n in range(len(by)))]
    out = rows.groupBy(*group).transformWithStateInPandas(_Ordered(fold, ["_key", *values]), f"_key string, {returns}", "Append", "EventTime")
    key = T.StructType([T.StructField(f"k{n}", df.schema[k].dataType) for n, k in enumerate(keys)])
    shown = [F.col("_key")[f"k{n}"].alias(k) for n, k in enumerate(keys)]
    return out.select(unpacked(F.col("_key"), key).alias("_key"), *values).select(*shown, *values) if keys else out.select(*values)


def temporal_join_stream(left: DataFrame, right: DataFrame, on: str, ts: str, right_cols: list[str], left_order: list[str], strict: bool = False, groups: int = GROUPS) -> DataFrame:
    """Each left row with right_cols (prefixed right_) of the last right row of its key that isn't later (strict: is earlier), nulls where there is none: the batch
    asof_join() over two streams with watermarks on ts.

    Both sides of a key wait until the watermark has passed them and are then taken in order, so a key remembers one version and what lies
    inside the delay. Of right rows with one time the last by right_cols counts. left_order: the order of left rows with one time.
    """
    stamp = F.col(ts).cast("timestamp")
    side = lambda df, rank, body, tie: df.select(F.col(on).alias("key"), stamp.alias("at"), F.lit(rank).alias("rank"), tie.alias("order"), body.alias("body"))
    a = side(left, 0 if strict else 1, packed(*[F.col(f"`{c}`") for c in left.columns]), packed(*[F.col(f"`{c}`") for c in left_order]))
    b = side(right, 1 if strict else 0, packed(*[F.col(f"`{c}`") for c in right_cols]), packed(*[F.col(f"`{c}`") for c in right_cols]))
    version = 1 if strict else 0

    def fold(state, row):
        if row["_rank"] == version:
            return row["_body"], None
        return state, (row["_body"], state)

    both = a.unionByName(b)
    kind = dict(both.dtypes)["key"]
    rows = both.select(*dealt([F.col("key")], [kind], groups), F.unix_micros("at").alias("us"), "rank", F.col("order").alias("tie"), "body").filter("us is not null")
    out = rows.groupBy("_group").transformWithStateInPandas(_Ordered(fold, ["_key", "left", "right"]), "_key string, left string, right string", "Append", "EventTime")
    versions = T.StructType([T.StructField(c, right.schema[c].dataType) for c in right_cols])
    return out.select(unpacked(F.col("left"), left.schema).alias("l"), unpacked(F.col("right"), versions).alias("r")).select("l.*", *[F.col(f"r.`{c}`").alias(f"right_{c}") for c in right_cols])


def over_stream(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str, before: int = 2) -> DataFrame:
    """The columns of df with nth (the row's number in its key), running_sum and near_avg (of `value` in this row and the `before` ones before it, nulls
    left out): OVER with running and bounded frames, ordered by ts and `order`. A key remembers its count, its sum and `before` values.
    """
    def fold(state, row):
        n, total, near = state or (0, None, [])
        v = json.loads(row["_body"])[value]
        v = float(v) if v is not None else None
        total = v if total is None else total + (v or 0.0)
        near = [*near, v]
        some = [x for x in near if x is not None]
        return (n + 1, total, near[-before:] if before else []), (row["_body"], n + 1, total, sum(some) / len(some) if some else None)

    out = in_order(df, keys, ts, order, fold, "row string, nth long, running_sum double, near_avg double")
    return out.select(unpacked(F.col("row"), df.schema).alias("row"), "nth", "running_sum", "near_avg").select("row.*", "nth", "running_sum", "near_avg")


def rate_limited_stream(df: DataFrame, keys: list[str], ts: str, order: list[str], per: str = "1 second", n: int = 60) -> DataFrame:
    """The first n rows of each key in each stretch of event time, by ts and `order`: the batch rate_limited() over a stream. The stretches of a key are
    apart, so a hot key is dealt to many tasks."""
    slotted = df.withColumn("_slot", F.unix_micros(F.window(F.col(ts).cast("timestamp"), per)["start"]))

    def fold(state, row):
        seen = (state or 0) + 1
        return seen, (row["_body"],) if seen <= n else None

    out = in_order(slotted, [*keys, "_slot"], ts, order, fold, "_row string", df.columns, apart=["_slot"])
    return out.select(unpacked(F.col("_row"), df.schema).alias("row")).select("row.*")
