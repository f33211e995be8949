"""Functions that scripts can call by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: SQL bodies: Spark inlines them, so they cost what their expressions cost.
SQL_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION map_to_string(m MAP<STRING, STRING>) RETURNS STRING RETURN coalesce(array_join(transform(map_entries(m), e -> concat(e.key, '=', coalesce(e.value, 'null'))), ','), '')",
    "CREATE OR REPLACE TEMPORARY FUNCTION parse_special_udtf(s STRING) RETURNS TABLE(type STRING, value STRING) RETURN SELECT element_at(array('brake', 'hard_to', 'unsafe_follow', 'force_to_quit'), pos + 1), col FROM (SELECT posexplode(slice(split(regexp_replace(s, ',+$', ''), ','), 1, 4)) AS (pos, col)) WHERE s IS NOT NULL",
)


def register_functions(spark: SparkSession) -> None:
    for statement in SQL_FUNCTIONS:
        spark.sql(statement)
