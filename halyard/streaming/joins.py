"""Joins of two streams by Spark's own symmetric join, whose state goes as the watermarks pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators.batch import micros


def interval_join_stream(left: DataFrame, right: DataFrame, on: str, ts: str, before: str, after: str = "0 seconds", how: str = "inner") -> DataFrame:
    """The batch interval_join() over two streams with watermarks on ts: pairs of one key, the right row at most `before` earlier and `after` later than the left one;
    right columns are prefixed right_.

    A row is kept as long as a partner may still come by the watermarks. Inner: time is cut into stretches as long as the interval, and rows meet
    by key and stretch, so a hot key is dealt to many tasks; a left row is kept once for each stretch that it touches. Outer ("left", "right", "full"):
    rows meet by key alone, and one without a partner is given, with nulls, when the watermark has passed all that it could meet.
    """
    low, high = micros(before), micros(after)
    width = max(1, low + high)
    right = right.select([F.col(f"`{c}`").alias(f"right_{c}") for c in right.columns])
    clock = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    near = F.expr(f"`right_{ts}` >= `{ts}` - INTERVAL {low} MICROSECONDS AND `right_{ts}` <= `{ts}` + INTERVAL {high} MICROSECONDS")
    same = F.col(on) == F.col(f"right_{on}")
    if how != "inner":
        return left.join(right, same & near, how)
    slot = lambda us: F.floor(us / F.lit(width)).cast("bigint")
    a = left.withColumn("_slot", F.explode(F.sequence(slot(clock(ts) - low), slot(clock(ts) + high))))
    b = right.withColumn("_at_slot", slot(clock(f"right_{ts}")))
    return a.join(b, same & (F.col("_slot") == F.col("_at_slot")) & near).drop("_slot", "_at_slot")
