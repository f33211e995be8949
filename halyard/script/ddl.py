"""CREATE TABLE statements of the two script dialects."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from halyard.script.rewrites import rewrite_query
from halyard.script.tokens import quoted, significant, unquoted


@dataclass
class Watermark:
    column: str
    delay: str


@dataclass
class TableDef:
    name: str
    columns: list[tuple[str, str]] = field(default_factory=list)
    computed: list[tuple[str, str]] = field(default_factory=list)
    watermark: Watermark | None = None
    options: dict[str, str] = field(default_factory=dict)
    partitions: list[str] = field(default_factory=list)
    stored_as: str | None = None
    properties: dict[str, str] = field(default_factory=dict)
    if_not_exists: bool = False
    parts: list[str] = field(default_factory=list)

    @property
    def path(self) -> list[str]:
        """The parts of the name."""
        return self.parts or [self.name]

    @property
    def schema(self) -> str:
        """The physical columns as Spark DDL."""
        return ", ".join(f"`{n}` {t}" for n, t in self.columns)


class _Reader:
    def __init__(self, sql: str) -> None:
        self.tokens, self.at = significant(sql), 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def take(self, *words: str) -> bool:
        if all(self.peek(k).upper() == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"{word} expected before {self.peek() or 'the end'}")

    def until(self, *stops: str) -> str:
        """Text up to a stop outside brackets, which isn't taken."""
        depth, out = 0, []
        while self.at < len(self.tokens):
            t = self.peek()
            if depth == 0 and t.upper() in stops:
                break
            depth += (t in "([{") - (t in ")]}")
            out.append(self.next())
        return " ".join(out)

    def pairs(self) -> dict[str, str]:
        self.need("(")
        out = {}
        while not self.take(")"):
            key = unquoted(self.next())
            self.need("=")
            out[key] = unquoted(self.next())
            self.take(",")
        return out

    def type(self) -> str:
        word = self.next().upper()
        if word in ("ROW", "STRUCT"):
            close = ">" if self.peek() == "<" else ")"
            self.next()
            fields = []
            while not self.take(close):
                name = unquoted(self.next())
                self.take(":")
                fields.append(f"`{name}`: {self.type()}")
                self.comment()
                self.take(",")
            return f"STRUCT<{', '.join(fields)}>"
        if word == "ARRAY":
            self.need("<")
            inner = self.type()
            self.need(">")
            return f"ARRAY<{inner}>"
        if word == "MAP":
            self.need("<")
            key = self.type()
            self.need(",")
            value = self.type()
            self.need(">")
            return f"MAP<{key}, {value}>"
        size = ""
        if self.take("("):
            size = "(" + self.until(")").replace(" ", "") + ")"
            self.need(")")
        if word == "TIMESTAMP":
            return "TIMESTAMP" if self.take("WITH", "LOCAL", "TIME", "ZONE") or "".join(x.upper() for x in (self.peek(), self.peek(1))) == "WITHLOCAL" else "TIMESTAMP_NTZ"
        if word == "TIMESTAMP_LTZ":
            return "TIMESTAMP"
        if word in ("VARCHAR", "CHAR", "STRING"):
            return "STRING"
        if word in ("BYTES", "VARBINARY"):
            return "BINARY"
        if word in ("DECIMAL", "NUMERIC", "DEC"):
            return "DECIMAL" + (size or "(10,0)")
        return word

    def comment(self) -> None:
        while True:
            if self.take("COMMENT"):
                self.next()
            elif not (self.take("NOT", "NULL") or self.take("NULL")):
                return


def spark_type(sql: str) -> str:
    """A column type of the scripts as Spark's."""
    return _Reader(sql).type()


def parse_create(sql: str) -> TableDef:
    """CREATE TABLE of either dialect. Quotes and comments may hold any signs."""
    r = _Reader(sql)
    r.need("CREATE")
    r.take("TEMPORARY")
    r.take("EXTERNAL")
    r.need("TABLE")
    exists = r.take("IF", "NOT", "EXISTS")
    name = [unquoted(r.next())]
    while r.take("."):
        name.append(unquoted(r.next()))
    out = TableDef(".".join(name), if_not_exists=exists, parts=name)
    if r.take("("):
        while not r.take(")"):
            if r.take("WATERMARK", "FOR"):
                column = unquoted(r.next())
                r.need("AS")
                text = r.until(",", ")")
                m = re.search(r"INTERVAL\s+'([^']+)'\s+(\w+)", text, re.I)
                out.watermark = Watermark(column, f"{m[1]} {m[2].lower()}s" if m else "0 seconds")
            elif r.take("PRIMARY", "KEY"):
                r.until(",", ")")
            else:
                column = unquoted(r.next())
                if r.take("AS"):
                    out.computed.append((column, rewrite_query(r.until(",", ")", "COMMENT"))))
                else:
                    out.columns.append((column, r.type()))
                r.comment()
            r.take(",")
    while r.peek() not in ("", ";"):
        if r.take("COMMENT"):
            r.next()
        elif r.take("PARTITIONED", "BY"):
            r.need("(")
            while not r.take(")"):
                column = unquoted(r.next())
                out.partitions.append(column)
                if r.peek() not in (",", ")"):
                    out.columns.append((column, r.type()))
                    r.comment()
                r.take(",")
        elif r.take("STORED", "AS"):
            out.stored_as = unquoted(r.next()).lower()
        elif r.take("WITH"):
            out.options = r.pairs()
        elif r.take("TBLPROPERTIES"):
            out.properties = r.pairs()
        else:
            raise ValueError(f"unknown clause at {r.peek()}")
    return out


def spark_create(table: TableDef, location: str | None = None) -> str:
    """The Spark statement for a stored table; properties of partition commit stay with the sink."""
    kept = {k: v for k, v in table.properties.items() if not k.startswith(("partition.", "sink.partition-commit"))}
    parts = [f"CREATE TABLE IF NOT EXISTS {quoted(table.path)} ({table.schema})", f"USING {table.stored_as or 'parquet'}"]
    if table.partitions:
        parts.append(f"PARTITIONED BY ({', '.join(f'`{p}`' for p in table.partitions)})")
    if location:
        parts.append(f"LOCATION '{location}'")
    if kept:
        parts.append("TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in kept.items()) + ")")
    return " ".join(parts)


def infer_ddl(spark, sample: str, name: str, sink: str | None = None) -> tuple[str, str]:
    """From a sample JSON object: the DDL of a source with that shape, every leaf a string, and of a flat sink."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    ddl = spark.range(1).select(F.schema_of_json(F.lit(sample))).first()[0]
    schema = T._parse_datatype_string(ddl)

    def text(t: T.DataType) -> str:
        if isinstance(t, T.StructType):
            return "ROW<" + ", ".join(f"`{f.name}` {text(f.dataType)}" for f in t.fields) + ">"
        if isinstance(t, T.ArrayType):
            return f"ARRAY<{text(t.elementType)}>"
        return "STRING"

    def leaves(t: T.StructType):
        for f in t.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(inner, T.StructType):
                yield from (x.name for x in inner.fields)
            else:
                yield f.name

    source = f"CREATE TABLE {name} (\n" + ",\n".join(f"  `{f.name}` {text(f.dataType)}" for f in schema.fields) + "\n)"
    target = f"CREATE TABLE {sink or name + '_sink'} (\n" + ",\n".join(f"  `{c}` STRING" for c in dict.fromkeys(leaves(schema))) + "\n)"
    return source, target
