"""What a physical plan does, in numbers that tests can hold on to."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class PlanFacts:
    exchanges: int
    broadcasts: int
    python: int
    codegen: int
    pushed: list[str]
    read: list[str]


def plan_facts(df: DataFrame) -> PlanFacts:
    text = df._jdf.queryExecution().executedPlan().toString()
    return PlanFacts(
        len(re.findall(r"\bExchange ", text)),
        len(re.findall(r"BroadcastExchange", text)),
        len(re.findall(r"Python|Pandas|InArrow", text)),
        len(set(re.findall(r"\*\((\d+)\)", text))),
        re.findall(r"PushedFilters: \[([^\]]*)\]", text),
        re.findall(r"ReadSchema: struct<([^\n]*)>", text),
    )
