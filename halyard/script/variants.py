"""Of one table's statements, those of two sister tables: its history, a partition a load, and its months without a column."""

from __future__ import annotations

import re
from dataclasses import replace

from halyard.script.ddl import TableDef, parse_create, spark_create
from halyard.script.inserts import parse_insert
from halyard.script.tokens import arguments, quoted, tokenize

# Names of the sisters and of their partition columns.
HISTORY, MONTHS = "_td_his", "_cm"
LOADED, MONTH = "partition_time", "perf_month"


def _sister(table: TableDef, suffix: str, partition: str, without: str | None = None) -> TableDef:
    columns = [(n, t) for n, t in table.columns if n != without and n not in table.partitions]
    parts = [*table.path[:-1], table.path[-1] + suffix]
    return replace(table, name=".".join(parts), parts=parts, columns=[*columns, (partition, "STRING")], partitions=[partition])


def create_variants(ddl: str, without: str) -> dict[str, str]:
    """CREATE TABLE statements by "his" and "cm"; the latter has no column `without`."""
    table = parse_create(ddl)
    return {"his": spark_create(_sister(table, HISTORY, LOADED)), "cm": spark_create(_sister(table, MONTHS, MONTH, without))}


def _select_list(query: str) -> tuple[str, list[str], str]:
    """The query up to its first SELECT's list, the list, and what follows from FROM on."""
    tokens = [t for t in tokenize(query) if t[0] != "comment"]
    depth, begin, end = 0, None, len(tokens)
    for k, (_, v) in enumerate(tokens):
        depth += (v in ("(", "[")) - (v in (")", "]"))
        if depth == 0 and v.upper() == "SELECT" and begin is None:
            begin = k + 1
        elif depth == 0 and v.upper() == "FROM" and begin is not None:
            end = k
            break
    if begin is None:
        raise ValueError("the query has no select list")
    text = lambda ts: "".join(v for _, v in ts)
    return text(tokens[:begin]), [text(a).strip() for a in arguments(tokens[begin:end])], text(tokens[end:])


def _without_ranges(rest: str, column: str) -> str:
    """The rest of a query without the conjuncts of its WHERE that bound `column` from both sides or either."""
    m = re.search(r"(?is)^(.*?)\bWHERE\b(.*?)(\bGROUP\s+BY\b.*|\bORDER\s+BY\b.*|\bLIMIT\b.*)?$", rest)
    if not m:
        return rest
    kept = [c for c in re.split(r"(?i)\s+AND\s+", m[2].strip()) if not re.search(rf"\b{re.escape(column)}\b\s*(?:>=|<=|>|<)", c)]
    return m[1].rstrip() + (f" WHERE {' AND '.join(kept)}" if kept else "") + (f" {m[3]}" if m[3] else "")


def insert_variants(dml: str, without: str, month: str, variables: dict[str, str] | None = None) -> dict[str, str]:
    """INSERT OVERWRITE statements by "his" and "cm", from one insert.

    The history's partition is a variable of the call; the months' partition is the expression `month`, which follows the other columns, and
    the column `without` goes, with what bounds it. variables: names as the insert has them, and as the variants shall.
    """
    for old, new in (variables or {}).items():
        dml = dml.replace(old, new)
    i = parse_insert(dml)
    head, items, rest = _select_list(i.query)
    named = lambda suffix: quoted([*i.parts[:-1], i.parts[-1] + suffix])
    kept = [x for x in items if not re.search(rf"(?:\bAS\s+|^|\.)`?{re.escape(without)}`?$", x, re.I)]
    his = f"INSERT OVERWRITE TABLE {named(HISTORY)} PARTITION (`{LOADED}` = '${{hivevar:{LOADED}}}') {head} {', '.join(items)} {rest}"
    cm = f"INSERT OVERWRITE TABLE {named(MONTHS)} PARTITION (`{MONTH}`) {head} {', '.join([*kept, f'{month} AS {MONTH}'])} {_without_ranges(rest, without)}"
    return {"his": his.strip(), "cm": cm.strip()}
