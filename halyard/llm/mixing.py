"""Mixing sources to target weights by systematic sampling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import WORD, frozen, ranked, text_of, whole

#: Weights by the source's place in code-point order, repeating, and how often a source may be taken at most.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Expected copies are counted in whole units of 1/ONE, so no sum of fractions can cross a boundary by rounding.
BITS = 24
ONE = 1 << BITS
#: Below this many sources the per-source table (about 60 bytes a row) is broadcast, else shuffled.
BROADCAST_SOURCES = 50_000
#: Rows that a hash cell of a source and size class holds, about: what one window task numbers.
CELL_ROWS = 1_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes below 64 by themselves, larger ones by 64 steps in each power of two: sorted sampling needs no finer order."""
    power = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")
    return F.when(size < 64, size).otherwise(power.cast("long") * 64 + F.floor(size / F.pow(F.lit(2.0), power - 6)).cast("long") - 64)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight and target.

    The targets share the total by weight; one above most times its source's size stops there, and the excess goes to the others by
    weight until none is above. One number a round comes to the driver; every round stops at least one source more.
    """
    every = ranked(sizes, ["source"], "_place")
    listed = frozen(every.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights)).cast("int") + 1)), "sources")
    cap = F.col("source_size") * float(most)
    total = float(listed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * level >= cap if stopped >= 0 else F.lit(False)
        got = listed.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if got[0] == stopped or got[2] is None:
            break
        stopped, level = got[0], max(level, (total - got[1]) / got[2])
    return listed.select("source", "source_size", "weight", F.least(cap, F.col("weight") * level).alias("target"))


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, most: int, seed: int) -> DataFrame:
    """docs with _size, _source_size, _target and _copies."""
    size = words(text_of(docs, text_col))
    hashed = F.xxhash64(docs[id_col], F.lit(seed))
    sized = frozen(docs.select(docs[source_col].alias("source"), size_class(size).alias("_class"), hashed.alias("_hash"), size.alias("_size")), "sizes")
    # As many cells as the commonest size class of any source needs, so a hot one is dealt to more tasks the more rows it has.
    most_rows = sized.groupBy("source", "_class").count().agg(F.max("count")).first()[0] or 0
    ways = max(1, -(-most_rows // CELL_ROWS))
    # Counts and sums by cell: a hot source or size arrives as one row for each task and cell.
    sized = sized.withColumn("_cell", F.pmod("_hash", F.lit(ways)))
    cells = frozen(sized.groupBy("source", "_class", "_cell").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")), "cells")
    goal = targets(cells.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most * ONE), F.floor(F.col("target") / F.col("source_size") * ONE))).otherwise(0).cast("long")
    goal = goal.select("source", "source_size", "target", rate.alias("_rate"), F.pmod(F.xxhash64("source", F.lit(seed + 1)), F.lit(ONE)).alias("_offset"))
    if goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    # The sum of the documents before each cell: for a source, a row for each size class (1,600 at most) and each cell that isn't empty.
    order = Window.partitionBy("source").orderBy("_class", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    before = before.join(goal, before["source"].eqNullSafe(goal["source"])).select(before["source"].alias("_s"), F.col("_class").alias("_c"), F.col("_cell").alias("_h"), "_before", "source_size", "target", "_rate", "_offset")
    own = docs.select(whole(docs), docs[id_col].alias("_id"), docs[source_col].alias("_source"), size.alias("_size"), size_class(size).alias("_class"), F.pmod(hashed, F.lit(ways)).alias("_cell"))
    mixed = own.join(before, own["_source"].eqNullSafe(before["_s"]) & (own["_class"] == before["_c"]) & (own["_cell"] == before["_h"]))
    nth = F.row_number().over(Window.partitionBy("_s", "_c", "_h").orderBy("_size", F.xxhash64("_id", F.lit(seed)), "_id")) - 1
    from_, to = F.col("_rank") * F.col("_rate") + F.col("_offset"), (F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")
    ranks = mixed.withColumn("_rank", F.col("_before") + nth)
    return ranks.withColumn("_copies", F.shiftright(to, BITS) - F.shiftright(from_, BITS))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to most times); the same columns.

    See mix_report() for the rule. Nulls: a null text has size 0, null sources form one source, the last; a null id only
    affects the order. Repeated rows are sampled like any others. An empty table gives an empty one.
    """
    picked = _copies(docs, id_col, text_col, source_col, weights, most, seed).filter("_copies > 0")
    return picked.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_doc.*")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """A row per row of docs: <id_col>, size, source_size, target, taken, copies.

    Systematic sampling: within a source, documents lie in order of size class, hash cell and hash; each has target/source_size
    expected copies; their running sum starts at one random offset, and a document is emitted once for every whole number that
    its own stretch of the sum crosses. So no document is taken more than most times, and as neighbours have like sizes, the
    words taken come within about one document of the target. Order and offset hang on ids and seed only: reruns agree.

    Running sums are two-level: counts by (source, size class, cell) are summed over cells, then rows are numbered inside a
    cell. No task sees a source's rows together.
    """
    only = docs.select(docs[id_col], docs[text_col], docs[source_col])
    out = _copies(only, id_col, text_col, source_col, weights, most, seed)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def op1_mix_sources(spark, sf_dir):
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
