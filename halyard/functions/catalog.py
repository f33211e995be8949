"""Which functions scripts can call: name, kind, how they are called, what they return."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class FunctionInfo:
    name: str
    kind: str
    invocation: str
    returns: str


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    """DESCRIBE FUNCTION EXTENDED as labels and values; lines without a label go on the one before."""
    out: dict[str, str] = {}
    label = ""
    for (line,) in spark.sql(f"DESCRIBE FUNCTION EXTENDED {name}").collect():
        if m := re.match(r"([A-Z][A-Za-z ]*):\s*(.*)", line):
            label = m[1]
            out[label] = m[2].strip()
        elif label:
            out[label] = f"{out[label]}, {line.strip()}".removeprefix(", ")
    return out


def function_catalog(spark: SparkSession) -> list[FunctionInfo]:
    """The session's own functions. Kind is udf for one value a row, udaf for one a group, udtf for rows."""
    found = []
    for (name,) in spark.sql("SHOW USER FUNCTIONS").collect():
        about, short = _described(spark, name), name.rpartition(".")[2]
        usage = about.get("Usage", "")
        if usage.startswith("{"):  # a temporary SQL function's parts
            parts = json.loads(usage)
            table, given, returns = parts.get("sqlFunction.isTableFunc") == "true", parts.get("sqlFunction.inputParam", ""), parts.get("sqlFunction.returnType", "")
        else:
            table, given, returns = about.get("Type", "").upper() == "TABLE", about.get("Input", ""), about.get("Returns", "")
        kind = "udtf" if table else "udaf" if "Aggregat" in about.get("Class", "") else "udf"
        given, returns = (re.sub(r"\s*,\s*", ", ", re.sub(r"\s+", " ", x)).strip() for x in ("" if given in ("()", "N/A") else given, returns))
        found.append(FunctionInfo(short, kind, f"{short}({given})", returns))
    return sorted(found, key=lambda f: f.name)


def catalog_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, f.kind, f.invocation, f.returns) for f in function_catalog(spark)], "name string, kind string, invocation string, returns string")
