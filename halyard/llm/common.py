"""What the corpus operators share: tables in the shared folder, ranks, row keys."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.session import shared_dir

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: The setting by which Spark deletes a statement's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[tuple[SparkSession, str]] = []


def frozen(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it: lineage ends here, and a lost executor loses nothing.

    The write's shuffle files are deleted when it has ended, as nothing reads them again. The tables of a session are dropped when the
    driver's Python ends; released() and drop_frozen() do it earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/halyard-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.frozen_at = path
    return out


def released(*frozen_tables: DataFrame) -> None:
    """Deletes tables of frozen() that nothing will read again."""
    for table in frozen_tables:
        spark, path = table.sparkSession, table.frozen_at
        _deleted(spark, path)
        _written.remove((spark, path))


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_frozen() -> None:
    """Deletes the tables that frozen() wrote. Call it when no DataFrame that reads them is needed any more."""
    while _written:
        spark, path = _written.pop()
        try:
            _deleted(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


atexit.register(drop_frozen)


def give_back() -> None:
    """Returns what this process has freed to the system; else a worker that waits for tasks keeps the most it ever used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def giving_back(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """For functions over the batches of a task: give_back() when the task has ended."""
    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


@contextmanager
def batch_bytes(spark: SparkSession, most: int):
    """Statements run inside send batches of about so many bytes at most to Python: an executor's JVM keeps buffers of the largest that it ever made."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The whole text; null is the empty text."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 over a global order, without a window over all rows: range partitions are frozen, counted and offset."""
    parts = frozen(df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).withColumn("_part", F.spark_partition_id()), "ranks")
    before = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    joined = parts.withColumn("_in", F.row_number().over(inside) - 1).join(before.select("_part", "_before"), "_part")
    return joined.withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def whole(docs: DataFrame, name: str = "_doc") -> Column:
    """All columns of docs as one struct, so that none of their names can clash with an operator's."""
    return F.struct(*[docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]).alias(name)


def keep_rows(docs: DataFrame, keys: dict[str, Column], kept: DataFrame, repeated: bool) -> DataFrame:
    """The rows of docs whose keys are in kept (nulls match nulls), with docs' columns.

    keys: by the names that kept has. repeated: rows with equal keys occur, of which one stays.
    The rows meet in a shuffled hash join, so long texts aren't sorted.
    """
    own = {f"_own_{n}": c for n, c in enumerate(keys.values())}
    left = docs.select(whole(docs), *[c.alias(k) for k, c in own.items()])
    right = kept.select(*[F.col(k).alias(f"_kept_{n}") for n, k in enumerate(keys)]).hint("shuffle_hash")
    on = [left[f"_own_{n}"].eqNullSafe(right[f"_kept_{n}"]) for n in range(len(keys))]
    out = left.join(right, on, "left_semi")
    if repeated:
        order = [F.col("_doc").getField(n) for n, kind in docs.dtypes if not any(x in kind for x in ("map", "variant"))]
        out = out.withColumn("_nth", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).filter("_nth = 1")
    return out.select("_doc.*")
