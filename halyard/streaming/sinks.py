"""Sinks for micro-batches, and the loop that restarts a query."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.streaming.exactly_once import Ledger, OnceFiles


def _touch(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True).close()


_UNITS = {"ms": 1e-3, "millisecond": 1e-3, "s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


def seconds(length: str) -> float:
    """'1 h', '1h', '5 seconds' or '30' (seconds) as seconds."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]*)\s*", length.lower())
    unit = None if m is None else m[2] or "s"
    unit = unit if unit is None or unit in _UNITS else unit.removesuffix("s")
    if unit not in _UNITS:
        raise ValueError(f"no length of time: {length!r}")
    return float(m[1]) * _UNITS[unit]


class PartitionCommit:
    """foreachBatch sink: appends files by partition day, and marks a day done when event time has passed its end by the delay and the watermark's.

    Done means a _SUCCESS file in the day's folder and, with a table name, the partition in the catalog. Days that were open when a query
    ended are found again in the folder, as those without such a file. With a ledger a micro-batch's rows are there once, however often it is
    replayed; without one, at least once, as with any appending file sink.
    """

    def __init__(self, path: str, fmt: str = "parquet", partition: str = "dt", delay_s: float = 0, watermark_s: float = 0, zone: str = "UTC", table: str | None = None, compression: str = "snappy", ledger: Ledger | None = None, name: str | None = None) -> None:
        self.path, self.format, self.partition, self.table = path.rstrip("/"), fmt, partition, table
        self.delay_s, self.zone, self.compression = delay_s + watermark_s, zone, compression
        self.once = OnceFiles(path, ledger, name, fmt, [partition], {"compression": compression}) if ledger is not None else None
        self.open: set[str] | None = None
        self.latest: float | None = None

    def __call__(self, batch: DataFrame, batch_id: int, newest: float | None) -> None:
        """newest: the latest event time of the batch in epoch seconds, None if it has none."""
        spark = batch.sparkSession
        if self.open is None:
            self.open = self._left_open(spark)
        if self.once is not None:
            days = [unquote(x.partition("=")[2]) for x in self.once(batch, batch_id)]
        else:
            batch.persist()
            try:
                batch.write.mode("append").format(self.format).option("compression", self.compression).partitionBy(self.partition).save(self.path)
                days = [r[0] for r in batch.select(F.col(self.partition).cast("string")).distinct().collect()]  # a row per day in a micro-batch
            finally:
                batch.unpersist()
        self.open.update(d for d in days if d is not None and d != "__HIVE_DEFAULT_PARTITION__")
        if newest is not None:
            self.latest = max(self.latest or 0, newest)
        self.commit(spark)

    def _left_open(self, spark: SparkSession) -> set[str]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return set()
        found = {x.getPath().getName().partition("=")[2]: x.getPath() for x in fs.listStatus(where) if x.isDirectory() and x.getPath().getName().startswith(f"{self.partition}=")}
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return {day for day, path in found.items() if not fs.exists(done(path, "_SUCCESS"))}

    def end_of(self, day: str) -> float:
        import datetime
        import zoneinfo

        start = datetime.datetime.fromisoformat(day).replace(tzinfo=zoneinfo.ZoneInfo(self.zone))
        return (start + datetime.timedelta(days=1)).timestamp()

    def commit(self, spark: SparkSession) -> list[str]:
        done = []
        for day in sorted(self.open or ()):
            try:
                end = self.end_of(day)
            except ValueError:  # a default day never ends
                continue
            if self.latest is not None and self.latest >= end + self.delay_s:
                if self.table:
                    spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS PARTITION (`{self.partition}` = '{day}') LOCATION '{self.path}/{self.partition}={day}'")
                    spark.catalog.refreshTable(self.table)
                _touch(spark, f"{self.path}/{self.partition}={day}/_SUCCESS")
                done.append(day)
        if self.open:
            self.open.difference_update(done)
        return done


def retrying(write: Callable[[], None], retries: int = 3, wait_s: float = 1.0) -> None:
    for k in range(retries + 1):
        try:
            return write()
        except Exception:  # noqa: BLE001  any failure of the other side is tried again
            if k == retries:
                raise
            time.sleep(wait_s * 2**k)


def jdbc_sink(url: str, table: str, batch_size: int = 20_000, retries: int = 3, properties: dict[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for a columnar database reached by JDBC; each task writes in its own batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        retrying(lambda: batch.write.mode("append").option("batchsize", batch_size).jdbc(url, table, properties=properties or {}), retries)

    return write


def fan_out(sinks: Iterable[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One reading of each micro-batch for several sinks."""
    sinks = list(sinks)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def supervised(start: Callable[[], object], attempts: int = 10, wait_s: float = 60.0, running: object | None = None) -> None:
    """Waits for a query (started here, or running already), and starts it again from its checkpoint after a failure, `attempts` times."""
    for k in range(attempts + 1):
        try:
            return (running if k == 0 and running is not None else start()).awaitTermination()
        except Exception:  # noqa: BLE001  whatever ended the query, its checkpoint is whole
            if k == attempts:
                raise
            time.sleep(wait_s)


def supervised_all(queries: list, starts: list[Callable[[], object]], attempts: int = 10, wait_s: float = 60.0) -> None:
    """supervised() for several running queries at once; the first that fails for good raises here, when the others have been told to stop."""
    if not queries:
        return
    now = list(queries)

    def again(k: int) -> Callable[[], object]:
        def start():
            now[k] = starts[k]()
            return now[k]

        return start

    with ThreadPoolExecutor(len(queries)) as pool:
        jobs = [pool.submit(supervised, again(k), attempts, wait_s, q) for k, q in enumerate(queries)]
        done, _ = wait(jobs, return_when=FIRST_EXCEPTION)
        failed = next((j for j in done if j.exception() is not None), None)
        if failed is not None:
            for q in now:
                q.stop()
            failed.result()
