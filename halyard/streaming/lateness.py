"""Event-time windows with allowed lateness: late rows fire their window again, still later ones go to a side output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from halyard.operators.batch import micros
from halyard.streaming.ordered import _sortable, packed, unpacked


class _Late(StatefulProcessor):
    """A window of a key. State: rows, their sum and firings so far, from the first row until the watermark is past its end by the lateness."""

    def __init__(self, size_ms: int, lateness_ms: int, columns: list[str]) -> None:
        self.size, self.lateness, self.columns = size_ms, lateness_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, total double, fired long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end, now = key[-1] // 1000 + self.size, timerValues.getCurrentWatermarkInMs()
        frame = pd.concat(list(rows))  # rows of one window in one micro-batch
        if now >= end + self.lateness:
            yield self._given(key, [(None, None, None, body) for body in frame["body"]])
            return
        n, total, fired = self.sums.get() if self.sums.exists() else (0, 0.0, 0)
        if now < end:  # in time
            if not n:
                self.handle.registerTimer(end)
            self.sums.update((n + len(frame), total + float(frame["v"].sum()), fired))
            yield self._given(key, [])
            return
        out = []
        if n and not fired:  # the watermark passed its end before these rows came; the window's own firing is first
            fired = 1
            out.append((n, total, fired, None))
        if not n:
            self.handle.registerTimer(end + self.lateness)
        late = sorted(zip(frame["us"].tolist(), map(_sortable, frame["tie"].tolist()), frame["v"].tolist()))
        for _, _, v in late:
            n, total, fired = n + 1, total + (0.0 if v != v else v), fired + 1
            out.append((n, total, fired, None))
        self.sums.update((n, total, fired))
        yield self._given(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, now = key[-1] // 1000 + self.size, timerValues.getCurrentWatermarkInMs()
        out = []
        if self.sums.exists():
            n, total, fired = self.sums.get()
            if not fired:
                out, fired = [(n, total, 1, None)], 1
                self.sums.update((n, total, fired))
            if now >= end + self.lateness:
                self.sums.clear()
            elif expiredTimerInfo.getExpiryTimeInMs() <= end:
                self.handle.registerTimer(end + self.lateness)
        yield self._given(key, out)

    def _given(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def windows_with_lateness(df: DataFrame, keys: list[str], ts: str, order: list[str], value: str, size: str, lateness: str) -> DataFrame:
    """keys, window_start, n, total, firing, late_row (JSON): counts and sums of a key's tumbling windows, at each firing.

    df needs a watermark on ts. A window fires when the watermark reaches its end, and again for each late row (in the order of ts and `order`, inside a
    micro-batch) until it is past the end by `lateness`; then its state goes. Rows that come later still are given as late_row, with nulls for the
    counts, never dropped: late_rows() and firings() tell the two outputs apart. Null values add nothing to total.
    """
    start = F.unix_micros(F.window(F.col(ts).cast("timestamp"), size)["start"])
    rows = df.select(*[F.col(f"`{k}`") for k in keys], start.alias("_start"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), packed(*[F.col(f"`{c}`") for c in order]).alias("tie"), F.col(value).cast("double").alias("v"), packed(*[F.col(f"`{c}`") for c in df.columns]).alias("body")).filter("us is not null")
    kinds = dict(rows.dtypes)
    names = [*keys, "_start", "n", "total", "firing", "late_row"]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_start long, n long, total double, firing long, late_row string"])
    out = rows.groupBy(*keys, "_start").transformWithStateInPandas(_Late(micros(size) // 1000, micros(lateness) // 1000, names), schema, "Append", "EventTime")
    return out.select(*keys, F.timestamp_micros("_start").alias("window_start"), "n", "total", "firing", "late_row")


def firings(out: DataFrame) -> DataFrame:
    return out.filter("late_row is null").drop("late_row")


def late_rows(out: DataFrame, like: DataFrame) -> DataFrame:
    """The side output: rows of the stream `like` that came too late for their window."""
    return out.filter("late_row is not null").select(unpacked(F.col("late_row"), like.schema).alias("row")).select("row.*")
