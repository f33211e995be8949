"""INSERT statements taken apart by tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from halyard.script.rewrites import rewrite_query
from halyard.script.tokens import closing, name_at, placed, quoted, unquoted

_QUERY = ("SELECT", "WITH", "VALUES", "TABLE", "FROM")


@dataclass
class Insert:
    """parts: the target's name; partition: its PARTITION clause, None for a dynamic column; query: in Spark's SQL."""

    parts: list[str]
    overwrite: bool
    query: str
    columns: list[str] | None = None
    partition: dict[str, str | None] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return ".".join(self.parts)

    def sql(self, source: str) -> str:
        """The statement for a stored table, from a view with the query's rows."""
        clause = ""
        if self.partition:
            clause = " PARTITION (" + ", ".join(f"`{c}`" + (f" = {v}" if v is not None else "") for c, v in self.partition.items()) + ")"
        listed = f" ({', '.join(f'`{c}`' for c in self.columns)})" if self.columns else ""
        return f"INSERT {'OVERWRITE' if self.overwrite else 'INTO'} {quoted(self.parts)}{clause}{listed} SELECT * FROM {source}"


def parse_insert(sql: str, **hooks) -> Insert:
    """INSERT INTO or OVERWRITE [TABLE] a.b [PARTITION (p = 'x', q)] [(columns)] query. The query may be SELECT, WITH, VALUES, TABLE or one in brackets; hooks are rewrite_query()'s."""
    tokens = placed(sql)
    words = [t[1].upper() for t in tokens]
    if words[:2] not in (["INSERT", "INTO"], ["INSERT", "OVERWRITE"]):
        raise ValueError("not an insert")
    parts, k = name_at(tokens, 3 if words[2] == "TABLE" else 2)
    partition: dict[str, str | None] = {}
    if k < len(words) and words[k] == "PARTITION":
        end = closing(tokens, k + 1)
        j = k + 2
        while j < end:
            column = unquoted(tokens[j][1])
            if words[j + 1] == "=":
                stop = next((x for x in range(j + 2, end) if words[x] == ","), end)
                partition[column] = sql[tokens[j + 2][2] : tokens[stop][2]].strip()
                j = stop + 1
            else:
                partition[column] = None
                j += 2
        k = end + 1
    columns = None
    if k < len(words) and words[k] == "(" and words[k + 1] not in _QUERY and words[k + 1] != "(":
        end = closing(tokens, k)
        columns = [unquoted(t[1]) for t in tokens[k + 1 : end] if t[1] != ","]
        k = end + 1
    if k >= len(tokens):
        raise ValueError(f"the insert into {'.'.join(parts)} has no query")
    return Insert(parts, words[1] == "OVERWRITE", rewrite_query(sql[tokens[k][2] :].rstrip().rstrip(";"), **hooks), columns, partition)
