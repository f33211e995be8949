"""Row patterns: matches of a regular expression over a key's rows in order, each of whose variables is a condition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sign that stands for a row of which no condition holds; conditions add their bits.
_FIRST = 0x100
_MOST = 12


def before(column: str, keys: list[str], order: list[str], n: int = 1) -> Column:
    """The value n rows earlier in a row's key, for conditions."""
    return F.lag(column, n).over(Window.partitionBy(*keys).orderBy(*order))


def compiled(pattern: str, variables: list[str]) -> regex.Pattern:
    """A pattern of variables, brackets, | and the quantifiers * + ? {n,m} (greedy, or reluctant with ?) as an expression over signs, one for each set of conditions."""
    out, at = [], 0
    for m in regex.finditer(r"[A-Za-z_]\w*|\{\d*,?\d*\}|[()|*+?]|\s+", pattern):
        if m.start() != at:
            raise ValueError(f"can't read {pattern[at : m.start()]!r} in a pattern")
        at, word = m.end(), m[0]
        if word[0].isalpha() or word[0] == "_":
            if word not in variables:
                raise ValueError(f"no condition for {word}")
            bit = variables.index(word)
            signs = "".join(chr(_FIRST + s) for s in range(1 << len(variables)) if s >> bit & 1)
            out.append(f"(?P<{word}>[{signs}])")
        elif word == "(":
            out.append("(?:")
        else:
            out.append(word.strip())
    if at != len(pattern):
        raise ValueError(f"can't read {pattern[at:]!r} in a pattern")
    return regex.compile("".join(out))


class _Scan:
    """The rows of one key that a match may still begin at, and their signs."""

    def __init__(self, pattern: regex.Pattern, variables: list[str], overlapping: bool) -> None:
        self.pattern, self.variables, self.overlapping = pattern, variables, overlapping
        self.begin()

    def begin(self) -> None:
        self.signs, self.rows, self.matches = "", [], 0

    def add(self, signs: str, rows: pa.RecordBatch) -> None:
        self.signs += signs
        self.rows.append(rows)

    def found(self, last: bool) -> list[pa.RecordBatch]:
        """Rows of the matches that no further row can change; last: none will come. The first row of what is open, and those after it, stay."""
        at, places, numbers, nths, names = 0, [], [], [], []
        while True:
            m = self.pattern.search(self.signs, at, partial=not last)
            if m is None:
                at = len(self.signs)
                break
            # What could go on to the end of the signs may become another match with more of them.
            if not last and (m.partial or self.pattern.fullmatch(self.signs, m.start(), partial=True) is not None):
                at = m.start()
                break
            if m.end() == m.start():
                at = m.end() + 1
                if at > len(self.signs):
                    at = len(self.signs)
                    break
                continue
            self.matches += 1
            mine = sorted((a, v) for v in self.variables if v in self.pattern.groupindex for a, _ in m.spans(v))
            places += [a for a, _ in mine]
            names += [v for _, v in mine]
            numbers += [self.matches] * len(mine)
            nths += range(1, len(mine) + 1)
            at = m.start() + 1 if self.overlapping else m.end()
        out = []
        if places or at:
            held = pa.Table.from_batches(self.rows)
            if places:
                got = held.take(pa.array(places)).combine_chunks().to_batches()[0]
                out.append(pa.RecordBatch.from_arrays([*got.columns, pa.array(numbers, pa.int64()), pa.array(nths, pa.int64()), pa.array(names, pa.string())], [*got.schema.names, "match_no", "nth", "variable"]))
            self.rows = held.slice(at).to_batches()
            self.signs = self.signs[at:]
        return out


def _matched(pattern: str, variables: list[str], overlapping: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key and order."""
        own, key, begun = _Scan(compiled(pattern, variables), variables, overlapping), None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_key")
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])).tolist()
            signs = (batch.column("_sign").to_numpy() + _FIRST).astype(np.uint32).tobytes().decode("utf-32-le")
            rows = batch.select(["_row"])
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                now = keys[a].as_py()
                if begun and now != key:
                    yield from own.found(True)
                    own.begin()
                key, begun = now, True
                own.add(signs[a:b], rows.slice(a, b - a))
            yield from own.found(False)
        yield from own.found(True)

    return scan


def match_rows(df: DataFrame, keys: list[str], order: list[str], pattern: str, define: dict[str, Column], overlapping: bool = False) -> DataFrame:
    """The columns of df with match_no (from 1 in a key), nth (in the match) and variable, for each row of each match of the pattern.

    define: the variables' conditions, on columns of df and on before(); F.lit(True) for any row. Rows of a key are taken by `order`, which
    should leave no ties. A match begins as early as it can and its quantifiers take as much as they can (with ? as little); the next one begins
    after its last row, or with overlapping after its first. Null conditions don't hold, null keys are a key, an empty table gives no rows.

    Conditions are evaluated by Spark; a key's rows are then signs, scanned in sorted batches. Only rows that an open match may need are held,
    so a key of any length takes time, not memory, unless one match is as long. Measures are groupBy() over the rows of a match.
    """
    if not 0 < len(define) <= _MOST:
        raise ValueError(f"one to {_MOST} variables, not {len(define)}")
    sign = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(define.values())), F.lit(0))
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    rows = dealt.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), sign.cast("int").alias("_sign"), *[F.col(f"`{c}`").alias(f"_o{n}") for n, c in enumerate([*keys, *order])])
    rows = rows.sortWithinPartitions(*[f"_o{n}" for n in range(len(keys) + len(order))])
    text = F.to_json(F.struct(*[f"_o{n}" for n in range(len(keys))]))
    kind = dict(rows.dtypes)["_row"]
    out = rows.select("_row", "_sign", text.alias("_key")).mapInArrow(_matched(pattern, list(define), overlapping), f"_row {kind}, match_no long, nth long, variable string")
    return out.select("_row.*", "match_no", "nth", "variable")
