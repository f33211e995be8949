"""Operators with state for Structured Streaming. State is a few numbers a key, never its rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def delta_trigger_stream(df: DataFrame, key: str, value: str, order: list[str], threshold: float = 536.0) -> DataFrame:
    """key, n, firing: the batch delta_trigger() over a stream. Rows of a micro-batch are taken in order; rows of later ones come later.

    State: the value at the last firing, the rows since, the number of firings.
    """
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"), *order).filter("v is not null")
    kind = dict(rows.dtypes)["key"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, firing = state.get if state.exists else (None, 0, 0)
        out = []
        for value_ in pd.concat(list(frames)).sort_values(order)["v"]:
            n += 1
            if last is None:
                last = value_
            elif value_ - last > threshold:
                firing += 1
                out.append((k[0], n, firing))
                last, n = value_, 0
        state.update((last, n, firing))
        yield pd.DataFrame(out, columns=["key", "n", "firing"])

    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, n long, firing long", "last double, n long, firing long", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)


def count_trigger_stream(df: DataFrame, key: str, ts: str | None = None, size: str = "5 seconds", every: int = 5) -> DataFrame:
    """key, window_start, total: the running count of a key in a tumbling window at each `every`-th row.

    Without ts windows are of processing time, and state goes when a window has ended; with ts they are of event time, and it goes
    when the watermark has passed (df needs one).
    """
    at = F.current_timestamp() if ts is None else F.col(ts).cast("timestamp")
    w = F.window(at, size)
    rows = df.select(F.col(key).alias("key"), w["start"].alias("window_start"), w["end"].alias("_end"), *([ts] if ts else []))
    kind = dict(rows.dtypes)["key"]
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ts is None else GroupStateTimeout.EventTimeTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        more = sum(map(len, frames))
        fired = range(n - n % every + every, n + more + 1, every)
        state.update((n + more,))
        end = pd.Timestamp(k[2]).timestamp() * 1000
        if ts is None:
            state.setTimeoutDuration(max(1, int(end - state.getCurrentProcessingTimeMs())))
        elif end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(end))
        yield pd.DataFrame({"key": [k[0]] * len(fired), "window_start": [k[1]] * len(fired), "total": list(fired)})

    out = rows.groupBy("key", "window_start", "_end").applyInPandasWithState(step, f"key {kind}, window_start timestamp, total long", "n long", "append", timeout)
    return out.withColumnRenamed("key", key)


def top2_changes(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, op, value, rank: changes of each key's two largest values; a rank's old value is taken back (-) before its new one is given (+)."""
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v is not null")
    kind = dict(rows.dtypes)["key"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = [x for x in (state.get if state.exists else ()) if x is not None]
        best = sorted([*old, *(v for f in frames for v in f["v"].nlargest(2))], reverse=True)[:2]
        out = []
        for rank in range(2):
            a, b = (x[rank] if rank < len(x) else None for x in (old, best))
            if a != b:
                if a is not None:
                    out.append((k[0], "-", a, rank + 1))
                out.append((k[0], "+", b, rank + 1))
        state.update((*best, *[None] * (2 - len(best))))
        yield pd.DataFrame(out, columns=["key", "op", "value", "rank"])

    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, op string, value double, rank int", "a double, b double", "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)


def keep_last_stream(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key so far; write it in update mode."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def per_window(df: DataFrame, ts: str, size: str, keys: list[str], late: str = "0 seconds", emit: Column | None = None) -> DataFrame:
    """'ok' (or emit) once for each key and event-time window, when the watermark closes it."""
    marked = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return marked.groupBy(*keys, F.window(ts, size)).agg((emit if emit is not None else F.first(F.lit("ok"))).alias("result"))
