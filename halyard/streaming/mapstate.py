"""Operators with a map as a key's state: entries are read and written one by one, so a key may have more of them than memory holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_map_state(spark: SparkSession) -> None:
    """Map state lives in RocksDB; queries that start from now on keep theirs there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Counts(StatefulProcessor):
    """Counts of a key's values. Late entries never leave, as the stream has no end for a value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "value string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for frame in rows:
            for value, n in frame["value"].value_counts(sort=False).items():
                seen[value] = seen.get(value, 0) + int(n)
        for value, n in seen.items():
            before = self.counts.getValue((value,))
            seen[value] = n + (before[0] if before is not None else 0)
            self.counts.updateValue((value,), (seen[value],))
        yield pd.DataFrame({"key": [key[0]] * len(seen), "value": list(seen), "n": list(seen.values())})

    def close(self) -> None:
        pass


def value_counts_stream(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n: after each micro-batch, how often each value that came in it has been seen with its key so far. Null values are left out. Write it in update mode."""
    rows = df.select(F.col(key).alias("key"), F.col(value).cast("string").alias("value")).filter("value is not null")
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithStateInPandas(_Counts(), f"key {kind}, value string, n long", "Update", "None")
    return out.select(F.col("key").alias(key), F.col("value").alias(value), "n")
