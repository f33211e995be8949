"""Batch operators: each is a plan over DataFrame operations; only the delta trigger, whose state runs along a key, scans in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.session import scratch


def flatten(df: DataFrame, struct: str, keep: list[str] | None = None) -> DataFrame:
    """All fields of a struct as columns, in one projection made from the schema."""
    return df.select(*(keep if keep is not None else [c for c in df.columns if c != struct]), *[F.col(f"{struct}.`{f.name}`").alias(f.name) for f in df.schema[struct].dataType.fields])


def unnest(df: DataFrame, array: str, names: list[str] | None = None) -> DataFrame:
    """A row per struct of an array, its fields as columns; rows with an empty or null array go."""
    fields = [f.name for f in df.schema[array].dataType.elementType.fields]
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.explode(array).alias("_item")).select(*rest, *[F.col(f"_item.`{f}`").alias(n) for f, n in zip(fields, names or fields)])


def at(array: Column, *places: int) -> Column:
    """array[i][j]... counted from 1; null outside."""
    for i in places:
        array = F.get(array, F.lit(i - 1))
    return array


def running_count(df: DataFrame, key: str, order: list[str], name: str = "running", part: Column | None = None) -> DataFrame:
    """The count of a key's rows so far, for each row.

    part: something that never falls along the order, such as the day of a first column that is a time. With it counts are two-level: rows
    are numbered inside each part of a key, and the parts before, counted first, are added up; so a key with a large share of all rows is
    dealt to as many tasks as it has parts. Without it a key is one task's.
    """
    if part is None:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = df.withColumn("_part", part)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy(F.col("_p").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select("_k", "_p", before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    joined = rows.withColumn("_nth", nth).join(parts, F.col(key).eqNullSafe(F.col("_k")) & F.col("_part").eqNullSafe(F.col("_p")))
    return joined.select(*df.columns, (F.col("_nth") + F.col("_before")).alias(name))


def conditional_counts(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def retract_sum(df: DataFrame, key: str, value: str, retracts: Column, name: str = "total") -> DataFrame:
    """Sums by key where rows with `retracts` take their value back; no values sum to 0."""
    return df.groupBy(key).agg(F.coalesce(F.sum(F.when(retracts, -F.col(value)).otherwise(F.col(value))), F.lit(0)).alias(name))


def top_n(df: DataFrame, key: str, order: list[Column], n: int = 2, rank: str = "rank") -> DataFrame:
    """The first n rows of each key with their rank; Spark keeps n rows a task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) <= n)


def keep_last(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. Tasks sort their rows by key, as a row is no hash aggregate's buffer, and pass on one row a key; the shuffle carries no more."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(key).agg(best).select(key, "_last.*").select(*df.columns)


def rate_limited(df: DataFrame, key: list[str], ts: str, order: list[str], per: str = "1 second", n: int = 60) -> DataFrame:
    """The first n rows of each key in each stretch of time."""
    slot = F.window(F.col(ts).cast("timestamp"), per)["start"]
    return df.withColumn("_slot", slot).withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_slot").orderBy(*order))).filter(F.col("_nth") <= n).drop("_slot", "_nth")


def count_trigger(df: DataFrame, key: str, ts: str, order: list[str], size: str = "5 seconds", every: int = 5) -> DataFrame:
    """key, window_start, total: the running count of a key in a tumbling window, at each `every`-th row; a rest emits nothing."""
    slot = df.withColumn("window_start", F.window(F.col(ts).cast("timestamp"), size)["start"].cast("timestamp_ntz"))
    nth = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(*order))
    return slot.withColumn("total", nth.cast("bigint")).filter(F.col("total") % every == 0).select(key, "window_start", "total")


def _firings(values: np.ndarray, last: float, threshold: float) -> list[int]:
    """Places where values exceed what they were at the firing before (at first: last) by more than threshold.

    A firing's value is the largest so far, so the next one is where the running maximum first exceeds it by enough.
    """
    out: list[int] = []
    if threshold < 0:  # then a lower value may fire
        for i, v in enumerate(values.tolist()):
            if v - last > threshold:
                out.append(i)
                last = v
        return out
    most = np.maximum.accumulate(values)
    i = int(np.searchsorted(most, last, "right"))
    while i < most.size:
        if most[i] - last > threshold:
            out.append(i)
            last = float(most[i])
        # differences, not sums, decide, so the search lands at most a rounding error before the place
        i = max(i + 1, int(np.searchsorted(most, np.nextafter(last + threshold, -np.inf), "right")))
    return out


def _delta_scan(threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key and order; state is one key, its value at the last firing, the rows since, its firings."""
        key, last, since, fired = None, 0.0, 0, 0
        begun = False
        for batch in batches:
            keys, values = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            if not values.size:
                continue
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            ends = np.append(starts[1:], values.size)
            most = np.maximum.reduceat(values, starts)
            at, n, firing = [], [], []
            quiet = (most - values[starts] <= threshold).tolist() if threshold >= 0 else [False] * starts.size
            for run, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                if run == 0 and begun and keys[0].as_py() == key:
                    first = a
                else:
                    last, since, fired, first = float(values[a]), 1, 0, a + 1
                    if quiet[run] and b < values.size:
                        continue
                done = first - since  # so that i - done + 1 rows have come since the last firing
                for i in _firings(values[first:b], last, threshold):
                    i += first
                    fired += 1
                    at.append(i)
                    n.append(i - done + 1)
                    firing.append(fired)
                    last, done = float(values[i]), i + 1
                since = b - done
            key, begun = keys[-1].as_py(), True
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([keys.take(rows), batch.column(1).take(rows), pa.array(n, pa.int64()), pa.array(firing, pa.int64())], ["key", "at", "n", "firing"])

    return scan


def delta_trigger(df: DataFrame, key: str, value: str, order: list[str], threshold: float = 536.0) -> DataFrame:
    """key, at (struct of order), n, firing: whenever a key's value has grown by more than threshold since the last firing (at first: since
    its first row), the number of rows since then, the triggering one included.

    Partitions are sorted and scanned in Arrow batches, so a long key takes time but no memory; time goes with the rows for sorting, and with
    the firings for the rest.
    """
    rows = df.select(F.col(key).alias("key"), F.struct(*order).alias("at"), F.col(value).cast("double").alias("v")).filter("v is not null")
    kind = dict(rows.dtypes)
    out = rows.repartition("key").sortWithinPartitions("key", "at").mapInArrow(_delta_scan(threshold), f"key {kind['key']}, at {kind['at']}, n long, firing long")
    return out.withColumnRenamed("key", key)


def asof_join(left: DataFrame, right: DataFrame, on: str, ts: str, right_cols: list[str], strict: bool = False, stretch: str | None = None) -> DataFrame:
    """Each left row with right_cols of the last right row of its key that isn't later (strict: is earlier); nulls where there is none, or no key or time.

    A union sorted by key and time with a running last value: linear in both sides, where a range join would meet all pairs of a key.
    stretch, '6 hours' for instance, cuts time so that a hot key is dealt to many tasks: each begins with the last right row of the stretches before it, which
    comes from one row for each key and stretch. It costs a second look at both sides' keys and times.
    """
    side = F.lit(0 if not strict else 1)
    known = right.filter(F.col(on).isNotNull() & F.col(ts).isNotNull())
    slot = F.lit(0) if stretch is None else F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(micros(stretch)))
    mine, theirs = F.struct(*left.columns), F.struct(*right_cols)
    l_type, r_type = left.select(mine.alias("x")).schema["x"].dataType, T.StructType([right.schema[c] for c in right_cols])
    a = left.select(F.col(on), F.col(ts), slot.alias("_slot"), mine.alias("_l"), F.lit(None).cast(r_type).alias("_r"), (F.lit(1) - side).alias("_side"))
    b = known.select(F.col(on), F.col(ts), slot.alias("_slot"), F.lit(None).cast(l_type).alias("_l"), theirs.alias("_r"), side.alias("_side"))
    both = a.unionByName(b)
    if stretch is not None:
        ends = known.groupBy(on, slot.alias("_slot")).agg(F.max_by(theirs, F.struct(F.col(ts), theirs)).alias("_r"))
        asked = left.filter(F.col(on).isNotNull() & F.col(ts).isNotNull()).select(on, slot.alias("_slot"), F.lit(None).cast(r_type).alias("_r")).distinct()
        before = Window.partitionBy(on).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        stretches = asked.unionByName(ends).groupBy(on, "_slot").agg(F.first("_r", ignorenulls=True).alias("_r"))
        carried = stretches.withColumn("_r", F.last("_r", ignorenulls=True).over(before)).filter("_r is not null")
        both = both.unionByName(carried.select(on, F.lit(None).cast(left.schema[ts].dataType).alias(ts), "_slot", F.lit(None).cast(l_type).alias("_l"), "_r", F.lit(-1).alias("_side")))
    w = Window.partitionBy(on, "_slot").orderBy(ts, "_side", F.col("_r").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_l is not null")
    return out.select("_l.*", *[F.col(f"_last.`{c}`").alias(f"right_{c}") for c in right_cols])


def interval_join(left: DataFrame, right: DataFrame, on: str, ts: str, before: str, after: str = "0 seconds") -> DataFrame:
    """Pairs of rows with one key, where the right one's time is at most `before` earlier and `after` later than the left one's; right columns are prefixed right_.

    Time is cut into stretches as long as the interval; a left row meets only the rows of the two or three that its interval touches, by an
    equi-join on key and stretch. So a hot key is dealt to many tasks, and rows that are far apart never meet.
    """
    low, high = micros(before), micros(after)
    width = max(1, low + high)
    clock = lambda c: F.unix_micros(c.cast("timestamp"))
    slot = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    a = left.withColumn("_at", clock(F.col(ts))).withColumn("_slot", F.explode(F.sequence(slot(F.col("_at") - low), slot(F.col("_at") + high))))
    b = right.select(F.col(on).alias("_on"), slot(clock(F.col(ts))).alias("_at_slot"), clock(F.col(ts)).alias("_right_at"), *[F.col(f"`{c}`").alias(f"right_{c}") for c in right.columns])
    near = (F.col("_right_at") >= F.col("_at") - low) & (F.col("_right_at") <= F.col("_at") + high)
    return a.join(b, (a[on] == b["_on"]) & (a["_slot"] == b["_at_slot"]) & near).select(*[a[c] for c in left.columns], *[c for c in b.columns if c.startswith("right_")])


_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}


def micros(length: str) -> int:
    """'6 hours' in microseconds."""
    n, unit = length.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def cumulate(df: DataFrame, ts: str, step: str, size: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates over windows that begin with each stretch of `size` and end after 1, 2, ... steps of it. A row counts for at most
    size / step ends; partial sums in each task keep the shuffle to one row per key and end."""
    whole, part = micros(size), micros(step)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    inside = F.pmod(at, F.lit(whole))
    first = at - inside + (F.floor(inside / part) + 1) * part
    ends = F.sequence(first.cast("bigint"), at - inside + whole, F.lit(part).cast("bigint"))
    stamp = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    wide = df.withColumn("window_start", stamp(at - inside)).withColumn("window_end", F.explode(F.transform(ends, stamp)))
    return wide.groupBy(*keys, "window_start", "window_end").agg(*aggs)


#: How running values of two stretches of rows, the earlier one second, become one's.
_JOINED = {"count": lambda x, y: x + F.coalesce(y, F.lit(0)), "sum": lambda x, y: F.coalesce(x + y, x, y), "min": F.least, "max": F.greatest}


def running(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, tuple[str, str | Column]]) -> DataFrame:
    """df with running values: values names each with its kind (count, sum, min or max) and a column; a row's value is over its key's rows up to it, itself included.

    No window runs over all rows of a key, nor, without keys, of the table: rows are dealt to range partitions of keys and order, written once, and values run inside
    each partition. Only a partition's first key can have begun before it; what it brings, one row for each partition, comes from partitions' totals and is joined
    back. Rows equal in order come in any order, and a third of all rows may be equal; rows without a key are one key's. Counts of a column leave its nulls out.
    """
    spark = df.sparkSession
    cells = {name: (kind, F.col(of) if isinstance(of, str) else of) for name, (kind, of) in values.items()}
    dealt = df.withColumns({f"_v{n}": of for n, (_, of) in enumerate(cells.values())}).withColumn("_n", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys, *order, "_n").withColumn("_part", F.spark_partition_id())
    path = scratch(spark, "running")
    dealt.write.parquet(path)
    parts = spark.read.schema(dealt.schema).parquet(path)
    fold = {name: getattr(F, kind)(f"_v{n}") for n, (name, (kind, _)) in enumerate(cells.items())}
    inside = Window.partitionBy("_part", *keys).orderBy(*order, "_n").rowsBetween(Window.unboundedPreceding, 0)
    own = [F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)]
    totals = parts.groupBy(F.col("_part").alias("_of"), *own).agg(*[v.alias(f"_t{n}") for n, v in enumerate(fold.values())])
    before = Window.partitionBy(*[f"_k{n}" for n in range(len(keys))]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    again = {"count": F.sum}
    carry = totals.select("_of", *[f"_k{n}" for n in range(len(keys))], F.count("*").over(before).alias("_parts"), *[again.get(kind, getattr(F, kind))(f"_t{n}").over(before).alias(f"_c{n}") for n, (kind, _) in enumerate(cells.values())]).filter("_parts > 0")
    on = [F.col("_part") == F.col("_of"), *[F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]]
    local = parts.withColumns({f"_r{n}": v.over(inside) for n, v in enumerate(fold.values())})
    got = [_JOINED[kind](F.col(f"_r{n}"), F.col(f"_c{n}")).alias(name) for n, (name, (kind, _)) in enumerate(cells.items())]
    return local.join(carry, on, "left").select(*[F.col(f"`{c}`") for c in df.columns], *got)


def session_rows(df: DataFrame, ts: str, gap: str, keys: list[str] | None = None) -> DataFrame:
    """df with window_start and window_end (of ts's type; the last row's time plus gap) of each row's session: rows that follow each other by at most gap. Rows without a time go.

    No window runs over all rows, or all of a key: rows are dealt to range partitions of keys and time, written once, and gaps are found inside each.
    Only the first and last session of a partition and key can go on beyond it; these, two rows at most for each, are joined to chains in the order of
    partitions, and what a chain covers is joined back. A time that a third of all rows share is dealt to several partitions too.
    """
    keys, length, spark = keys or [], micros(gap), df.sparkSession
    own = [f"_k{n}" for n in range(len(keys))]
    rows = df.select(F.struct(*df.columns).alias("_row"), *[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)], F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).filter("_us is not null")
    order = [*own, "_us", "_n"]
    dealt = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    path = scratch(spark, "sessions")
    dealt.write.parquet(path)
    parts = spark.read.schema(dealt.schema).parquet(path)
    of = ["_part", *own]
    inside = Window.partitionBy(*of).orderBy("_us")
    new = F.when(F.col("_us") <= F.lag("_us").over(inside) + length, 0).otherwise(1)
    cut = parts.withColumn("_new", new).withColumn("_s", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    spans = cut.groupBy(*of, "_s").agg(F.min("_us").alias("_from"), F.max("_us").alias("_to"))
    border = spans.withColumn("_last", F.max("_s").over(Window.partitionBy(*of))).filter("_s = 1 or _s = _last")
    along = Window.partitionBy(*own).orderBy("_part", "_s")  # two rows at most for each partition
    goes_on = F.col("_from") <= F.lag("_to").over(along) + length
    chains = border.withColumn("_chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*own, "_chain")
    ends = chains.select(*[F.col(c).alias(f"{c}_of") for c in (*of, "_s")], F.min("_from").over(whole).alias("_begin"), F.max("_to").over(whole).alias("_end"))
    local = Window.partitionBy(*of, "_s")
    mine = cut.withColumn("_from", F.min("_us").over(local)).withColumn("_to", F.max("_us").over(local))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in (*of, "_s")]
    kind = dict(df.dtypes)[ts]
    stamp = lambda c: F.timestamp_micros(c).cast(kind)
    joined = mine.join(ends, on, "left")
    return joined.select("_row.*", stamp(F.coalesce("_begin", "_from")).alias("window_start"), stamp(F.coalesce("_end", "_to") + length).alias("window_end"))
