"""Every query that has SQL against DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from halyard.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        if isinstance(x, (int, float)) or type(x).__name__ in ("int64", "float64", "int32", "Decimal"):
            return round(float(x), 6) + 0.0
        return str(x)

    return sorted((tuple(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
