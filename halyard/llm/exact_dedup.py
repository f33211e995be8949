"""Exact dedup by a tree merge of sorted digest runs. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import SPACES, frozen, keep_rows, text_of

#: Runs that one merge takes together, and rows of a partition that form one leaf at most.
FAN_IN, LEAF_ROWS = 16, 8192
KEY = ("_digest", "_bytes", "_check")


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def _leaves(docs: DataFrame, id_col: str, text_col: str, leaf_rows: int) -> DataFrame:
    """Sorted runs: a row per partition, block of leaf_rows rows and distinct text, with the rows that have it.

    A digest is verified by the text's length and a second, unrelated hash. Only digests and ids leave the scan.
    """
    row = F.monotonically_increasing_id()
    rows = docs.select(docs[id_col].alias("_id"), normalised(text_of(docs, text_col)).alias("_norm"), row.alias("_row"))
    digests = rows.select("_id", "_row", F.unhex(F.sha2("_norm", 256)).alias("_digest"), F.octet_length("_norm").alias("_bytes"), F.xxhash64("_norm").alias("_check"))
    at = F.shiftright("_row", 33).cast("int").alias("_run"), F.expr(f"(_row & {2**33 - 1}) div {leaf_rows}").alias("_block")
    member = F.struct(F.isnull("_id").alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    return digests.select("*", *at).groupBy(*KEY, "_run", "_block").agg(F.sort_array(F.collect_list(member)).alias("_members"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """A row per row of docs: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each stretch of white space became one space. Of equal texts the row with
    the smallest id stays; a null id comes last, and of repeated rows with that id exactly one stays. A null text is an empty
    one, and empty texts are equal. Other columns are ignored; an empty table gives no rows.

    Every partition's digests form sorted runs of at most leaf_rows rows. In each round fan_in neighbouring runs are exchanged
    by digest and merged by sorted aggregation, which keeps the smallest row and the count; log_fan_in(partitions) rounds
    leave one run. A text with a third of all rows brings a row per leaf, never its members, to any task. The way down joins
    leaves, not rows.
    """
    leaves = frozen(_leaves(docs, id_col, text_col, leaf_rows), "digest-runs")
    runs = leaves.select(*KEY, "_run", F.element_at("_members", 1).alias("_first"), F.size("_members").cast("long").alias("_n"))
    last = leaves.agg(F.max("_run")).first()[0] or 0
    while True:
        runs = runs.withColumn("_run", F.expr(f"_run div {fan_in}")).groupBy(*KEY, "_run").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
        last //= fan_in
        if not last:
            break
    found = leaves.select(*KEY, "_members").join(runs.drop("_run"), list(KEY))
    rows = found.select("_digest", "_first", "_n", F.explode("_members").alias("_m"))
    return rows.select(
        F.col("_m.id").alias(id_col),
        F.col("_first.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        (F.col("_m.row") == F.col("_first.row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() doesn't keep; the same columns, whatever their names.

    A null text is empty, so of null and empty texts one row stays; a null id comes first, as in exact_dedup(). Of rows equal in id and text
    one stays, and an empty table gives no rows.
    """
    rows = frozen(exact_dedup(docs, id_col, text_col), "exact")
    repeated = not rows.groupBy(id_col, "text_sha256").count().filter("count > 1").isEmpty()
    keys = {id_col: docs[id_col], "text_sha256": F.sha2(normalised(text_of(docs, text_col)), 256)}
    return keep_rows(docs, keys, rows.filter("kept"), repeated)


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d
"""
