"""Which tables a statement reads and writes, from Spark's own parser."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Lineage:
    statement: str
    target: str | None = None
    sources: set[str] = field(default_factory=set)
    with_tables: set[str] = field(default_factory=set)


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _name(parts) -> str:
    return ".".join(_each(parts))


def table_lineage(spark: SparkSession, statement: str) -> Lineage:
    """Sources are relations that the plan and its subqueries name, less its WITH names and, for inserts, nothing else; the target is what
    an INSERT, CREATE TABLE AS or CREATE VIEW writes. Raises ParseException for what Spark's SQL can't parse."""
    out = Lineage(statement)
    stack = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            out.sources.add(_name(node.multipartIdentifier()))
        elif kind == "InsertIntoStatement":
            out.target = _name(node.table().multipartIdentifier())
        elif kind in ("CreateTableAsSelect", "ReplaceTableAsSelect", "CreateView", "CreateViewStatement") and hasattr(node, "name"):
            target = node.child() if kind == "CreateView" else node.name()
            out.target = _name(target.nameParts()) if hasattr(target, "nameParts") else None
        elif kind == "CreateViewCommand":
            out.target = node.name().unquotedString()
            stack.append(node.plan())
        elif kind == "UnresolvedWith":
            for pair in _each(node.cteRelations()):
                out.with_tables.add(pair._1())
                stack.append(pair._2())
        stack.extend(_each(node.children()))
        expressions = list(_each(node.expressions()))
        while expressions:
            e = expressions.pop()
            if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                stack.append(e.plan())
            expressions.extend(_each(e.children()))
    out.sources -= out.with_tables
    return out


def sources_of(spark: SparkSession, query: str) -> set[str]:
    return table_lineage(spark, query).sources


def script_lineage(spark: SparkSession, script: str) -> list[Lineage]:
    """Of each statement of a script, split at semicolons; blank ones are skipped, and those that can't be parsed have no tables."""
    from halyard.script.splitter import statements_of

    out = []
    for statement in statements_of(script):
        try:
            out.append(table_lineage(spark, statement))
        except Exception as e:  # noqa: BLE001  a statement of another dialect
            if "ParseException" not in type(e).__name__:
                raise
            out.append(Lineage(statement))
    return out


def insert_sources(spark: SparkSession, script: str) -> set[str]:
    """Tables that a script's inserts read, less those that they write."""
    found = [x for x in script_lineage(spark, script) if x.statement.lstrip().lower().startswith("insert")]
    return set().union(*(x.sources for x in found)) - {x.target for x in found} if found else set()
