"""Aggregates over a changelog: rows that are added and taken back, kept as a sorted multiset a key, so that minimum, maximum, the largest two and distinct counts follow."""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Different values of a chunk at most; a fuller one is cut in two.
CHUNK = 4096


class SortedMultiset:
    """Values with their counts in sorted chunks, of which only those are read and written that changes, or the answers, touch.

    chunks: by number, the values and counts of a chunk as bytes. index: of each chunk, in order, its number, least value, and how many of its values
    count: (number, low, distinct, rows). A count may be negative for a while: a value that was taken back before it came. Only values with a positive
    count are seen.
    """

    def __init__(self, chunks: MutableMapping[int, tuple[bytes, bytes]], index: list[tuple[int, float, int, int]], size: int = CHUNK) -> None:
        self.chunks, self.index, self.size = chunks, index, size

    def change(self, values: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts (negative ones take back). Values are finite or infinite, never NaN."""
        values, where = np.unique(values, return_inverse=True)
        counts = np.bincount(where, counts, values.size).astype(np.int64)
        values, counts = values[counts != 0], counts[counts != 0]
        if not values.size:
            return
        if not self.index:
            self.index = [(0, -np.inf, 0, 0)]
            self.chunks[0] = (b"", b"")
        lows = np.array([low for _, low, _, _ in self.index])
        of = np.maximum(np.searchsorted(lows, values, "right") - 1, 0)
        after, fresh = [], max(n for n, *_ in self.index) + 1
        touched = set(of.tolist())
        for k, entry in enumerate(self.index):
            if k not in touched:
                after.append(entry)
                continue
            number, low, _, _ = entry
            old, had = (np.frombuffer(x, t) for x, t in zip(self.chunks[number], ("<f8", "<i8")))
            mine = of == k
            both, place = np.unique(np.concatenate((old, values[mine])), return_inverse=True)
            sums = np.bincount(place, np.concatenate((had, counts[mine])), both.size).astype(np.int64)
            both, sums = both[sums != 0], sums[sums != 0]
            pieces = max(1, -(-both.size // self.size))
            if not both.size and len(self.index) > 1 and k:
                del self.chunks[number]
                continue
            for x, (v, c) in enumerate(zip(np.array_split(both, pieces), np.array_split(sums, pieces))):
                self.chunks[number] = (v.astype("<f8").tobytes(), c.astype("<i8").tobytes())
                after.append((number, low if x == 0 else float(v[0]), int((c > 0).sum()), int(c[c > 0].sum())))
                number, fresh = fresh, fresh + 1
        self.index = after

    @property
    def rows(self) -> int:
        return sum(n for *_, n in self.index)

    @property
    def distinct(self) -> int:
        return sum(d for _, _, d, _ in self.index)

    def _seen(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        v, c = (np.frombuffer(x, t) for x, t in zip(self.chunks[number], ("<f8", "<i8")))
        return v[c > 0], c[c > 0]

    def smallest(self) -> float | None:
        return next((float(self._seen(n)[0][0]) for n, _, d, _ in self.index if d), None)

    def largest(self, k: int = 1) -> list[float]:
        """The k largest rows, equal ones as often as they are there, from the last chunks."""
        out: list[float] = []
        for number, _, d, _ in reversed(self.index):
            if d and len(out) < k:
                v, c = self._seen(number)
                for x, n in zip(v[::-1][:k].tolist(), c[::-1][:k].tolist()):
                    out += [x] * min(n, k - len(out))
        return out


class _Stored(MutableMapping):
    """Chunks in a map state."""

    def __init__(self, state) -> None:
        self.state = state

    def __getitem__(self, number: int) -> tuple[bytes, bytes]:
        found = self.state.getValue((number,))
        return bytes(found[0]), bytes(found[1])

    def __setitem__(self, number: int, value: tuple[bytes, bytes]) -> None:
        self.state.updateValue((number,), value)

    def __delitem__(self, number: int) -> None:
        self.state.removeKey((number,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


_INDEX = np.dtype([("number", "<i8"), ("low", "<f8"), ("distinct", "<i8"), ("rows", "<i8")])


class _Aggregates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "number long", "vals binary, counts binary")
        self.index = handle.getValueState("entries", "entries binary")
        self.seen = handle.getValueState("changes", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index = [tuple(x) for x in np.frombuffer(bytes(self.index.get()[0]), _INDEX).tolist()] if self.index.exists() else []
        held = SortedMultiset(_Stored(self.chunks), index)
        n = self.seen.get()[0] if self.seen.exists() else 0
        for frame in rows:
            held.change(frame["v"].to_numpy("f8"), frame["sign"].to_numpy("i8"))
            n += len(frame)
        self.index.update((np.array(held.index, _INDEX).tobytes(),))
        self.seen.update((n,))
        top = [*held.largest(2), None, None][:2]
        yield pd.DataFrame([(key[0], n, held.rows, held.distinct, held.smallest(), *top)], columns=["key", "changes", "n", "kinds", "least", "most", "second"], dtype=object)

    def close(self) -> None:
        pass


def changelog_aggregates(df: DataFrame, key: str, value: str, retracts: Column) -> DataFrame:
    """key, changes, n, kinds, least, most, second: after each micro-batch, for each key that changed in it, the number of changes so far, and of the rows that remain
    their number, that of their different values, the least, and the largest two (equal rows count twice; nulls where there are fewer).

    A row adds its value; where `retracts` holds it takes an equal one back, also one that comes only later. Null and NaN values are left out; a
    key without rows remains, with n = 0. A micro-batch reads and writes the chunks of a key that its values fall into, and those at the ends.
    Write it in update mode; the row of a key with the largest `changes` is the last.
    """
    sign = F.when(F.coalesce(retracts, F.lit(False)), -1).otherwise(1)
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v"), sign.cast("long").alias("sign")).filter("v is not null and not isnan(v)")
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithStateInPandas(_Aggregates(), f"key {kind}, changes long, n long, kinds long, least double, most double, second double", "Update", "None")
    return out.withColumnRenamed("key", key)
