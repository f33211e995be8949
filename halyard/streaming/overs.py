"""Values over rows (OVER) on streams, along event time: ranks, sums, averages, extremes, first and last values, earlier values."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators.batch import micros
from halyard.streaming.ordered import _Ordered, dealt, packed, unpacked

KINDS = ("row_number", "rank", "dense_rank", "count", "sum", "avg", "min", "max", "first_value", "last_value", "lag")
_RANKS = KINDS[:3]
_EXACT = Context(prec=80)


@dataclass(frozen=True)
class Over:
    """A value of each row over its key's rows up to it.

    kind: one of KINDS; of: the column, none for ranks. Frame: rows=n takes the row and the n before it, rows=-1 all before it; span='1 hour' the rows of that time up to the
    row's, those of the same time and order included; neither: all rows up to the row's time and order. lag looks `offset` rows back.
    """

    kind: str
    of: Column | None = None
    rows: int | None = None
    span: str | None = None
    offset: int = 1


@dataclass(frozen=True)
class _Plan:
    """An Over as tasks need it. number: how its values are read (int, float, decimal or none); scale: that of a decimal result."""

    kind: str
    rows: int | None
    span: int | None
    offset: int
    number: str | None
    scale: int

    def read(self, v):
        if v is None or self.number is None:
            return v
        return Decimal(v) if self.number == "decimal" else float(v) if self.number == "float" else v

    def written(self, v):
        return str(v) if isinstance(v, Decimal) else v

    def added(self, total, v):
        if v is None or total is None:
            return total if v is None else v
        out = _EXACT.add(total, v) if self.number == "decimal" else total + v
        if self.number == "int" and self.kind == "sum" and not -(2**63) <= out < 2**63:
            raise OverflowError("the sum of an OVER is beyond 64 bits")
        return out

    def better(self, best, v):
        if v is None or best is None:
            return best if v is None else v
        above = (v != v, v) > (best != best, best)  # a NaN is the largest
        return v if above == (self.kind == "max") and (v != best) else best

    def mean(self, total, n: int):
        if not n:
            return None
        if self.number != "decimal":
            return total / n
        return _EXACT.divide(total, Decimal(n)).quantize(Decimal(1).scaleb(-self.scale), ROUND_HALF_UP, _EXACT)

    def joined(self, so_far, v):
        """The running value with one more row's; an average's is a pair of sum and number, the others' a list of one, so that null is told from nothing."""
        if self.kind == "count":
            return [(so_far[0] if so_far else 0) + (v is not None)]
        if self.kind == "first_value":
            return so_far or [v]
        if self.kind == "last_value":
            return [v]
        old = self.read(so_far[0]) if so_far else None
        if self.kind == "avg":
            return [self.written(self.added(old, self.read(v))), (so_far[1] if so_far else 0) + (v is not None)]
        return [self.written((self.added if self.kind == "sum" else self.better)(old, self.read(v)))]

    def shown(self, so_far):
        if not so_far:
            return 0 if self.kind == "count" else None
        return self.written(self.mean(self.read(so_far[0]), so_far[1])) if self.kind == "avg" else so_far[0]

    def over(self, values: list):
        out = None
        for v in values:
            out = self.joined(out, v)
        return self.shown(out)

    def step(self, state, us: int, run: list) -> tuple[object, list]:
        """What is remembered, and the values of the rows of one time and order."""
        n = len(run)
        if self.kind in _RANKS:
            seen = state or 0
            if self.kind == "row_number":
                return seen + n, list(range(seen + 1, seen + n + 1))
            return seen + (n if self.kind == "rank" else 1), [seen + 1] * n
        out = []
        if self.kind == "lag":
            near = state or []
            for v in run:
                near = [*near, v][-self.offset - 1 :]
                out.append(near[0] if len(near) > self.offset else None)
            return near, out
        if self.span is not None:
            near = [x for x in state or [] if x[0] >= us - self.span] + [[us, v] for v in run]
            return near, [self.over([v for _, v in near])] * n
        if self.rows is not None and self.rows >= 0:
            near = state or []
            for v in run:
                near = [*near, v][-self.rows - 1 :]
                out.append(self.over(near))
            return near, out
        for v in run:
            state = self.joined(state, v)
            out.append(self.shown(state))
        return state, out if self.rows is not None else out[-1:] * n


class _Overs(_Ordered):
    def __init__(self, plans: list[_Plan], columns: list[str]) -> None:
        super().__init__(None, columns)
        self.plans = plans

    def folded(self, state, ready: list[tuple]) -> tuple[object, list[tuple]]:
        out, states = [], state or [None] * len(self.plans)
        for (us, _), same in groupby(ready, key=lambda r: (r[0], r[2])):
            rows = [json.loads(body) for _, _, _, body in same]
            values = []
            for n, plan in enumerate(self.plans):
                states[n], given = plan.step(states[n], us, [r[f"v{n}"] for r in rows])
                values.append(given)
            out.extend((r["row"], json.dumps({f"v{n}": v for n, v in enumerate(of_row)})) for r, of_row in zip(rows, zip(*values)))
        return states, out


def over_rows(df: DataFrame, keys: list[Column], ts: str, order: list[str], values: dict[str, Over]) -> DataFrame:
    """df with a column for each of `values`, as Spark's windows give them in batch, over a stream with a watermark on ts: PARTITION BY keys ORDER BY ts, order.

    Rows wait until the watermark has passed them, so those that come out of order within its delay are in their place; rows behind it, or without a time, go. State of a group of keys:
    those rows, and for each value a running one or its frame's. Types are those of Spark's windows. Nulls come first in an order, and null keys are a key.
    """
    for v in values.values():
        if v.kind not in KINDS:
            raise ValueError(f"{v.kind} isn't known OVER a stream")
    columns = [F.lit(None).cast("int") if v.of is None else v.of for v in values.values()]
    own = df.select(*[of.alias(f"a{n}") for n, of in enumerate(columns)]).schema
    windows = []
    for n, v in enumerate(values.values()):
        given = [] if v.kind in _RANKS else [F.col(f"a{n}"), v.offset] if v.kind == "lag" else [F.col(f"a{n}")]
        windows.append(getattr(F, v.kind)(*given).over(Window.partitionBy(F.lit(1)).orderBy(F.lit(1))).alias(f"v{n}"))
    types = df.sparkSession.createDataFrame([], own).select(*windows).schema
    plans, arguments, shown, back = [], [], [], []
    for n, (name, v) in enumerate(values.items()):
        of, kind, to = columns[n], own[f"a{n}"].dataType, types[f"v{n}"].dataType
        number = None
        if v.kind in ("sum", "avg", "min", "max"):
            number = "decimal" if isinstance(kind, T.DecimalType) else "int" if isinstance(kind, T.IntegralType) else "float" if isinstance(kind, T.FractionalType) else None
            if number is None and not isinstance(kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
                raise ValueError(f"no {v.kind} of {kind.simpleString()} OVER a stream")
        time = isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and v.kind != "count"
        if number == "decimal":
            of = of.cast("string")
        elif number == "float" and v.kind in ("sum", "avg"):
            of = of.cast("double")
        elif time:
            of = F.unix_micros(of.cast("timestamp"))
        elif v.kind == "count":
            of = F.when(of.isNotNull(), 1)
        plans.append(_Plan(v.kind, v.rows, micros(v.span) if v.span else None, v.offset, number, getattr(to, "scale", 0)))
        arguments.append(of.alias(f"v{n}"))
        shown.append(T.StructField(f"v{n}", T.LongType() if time else to))
        got = F.col(f"v.v{n}")
        back.append((F.timestamp_micros(got).cast(to) if time else got).alias(name))
    whole = packed(*[F.col(f"`{c}`") for c in df.columns])
    kinds = [kind for _, kind in df.select(*[k.alias(f"k{n}") for n, k in enumerate(keys)]).dtypes]
    rows = df.select(
        *dealt(keys, kinds),
        F.unix_micros(F.col(f"`{ts}`").cast("timestamp")).alias("us"),
        F.lit(0).alias("rank"),
        packed(*[F.col(f"`{c}`") for c in order]).alias("tie") if order else F.lit("{}").alias("tie"),
        packed(whole.alias("row"), *arguments).alias("body"),
    ).filter("us is not null")
    out = rows.groupBy("_group").transformWithStateInPandas(_Overs(plans, ["_key", "row", "value"]), "_key string, row string, value string", "Append", "EventTime")
    return out.select(unpacked(F.col("row"), df.schema).alias("row"), unpacked(F.col("value"), T.StructType(shown)).alias("v")).select("row.*", *back)
