"""Runs scripts: session commands, tables, views, inserts and statement sets, in batch or streaming mode."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions.registry import register_functions
from halyard.lineage.tables import sources_of
from halyard.operators.batch import session_rows
from halyard.script.commands import Command, parse_command
from halyard.script.ddl import TableDef, parse_create, spark_create
from halyard.script.inserts import Insert, parse_insert
from halyard.script.rewrites import rewrite_query
from halyard.script.splitter import read_script, split_script
from halyard.script.tokens import name_at, quoted, significant, unquoted
from halyard.sources.connectors import read_table
from halyard.sources.lines import keep_place
from halyard.streaming.exactly_once import Ledger, OnceFiles, OnceJdbc, once
from halyard.streaming.ordered import state_in_rocksdb
from halyard.streaming.sinks import PartitionCommit, fan_out, jdbc_sink, seconds, supervised_all

#: Nodes of a plan that treats each row by itself, so a micro-batch gives what the whole stream would.
_ROW_BY_ROW = ("Project", "Filter", "Generate", "SubqueryAlias", "View", "EventTimeWatermark", "StreamingRelation", "StreamingRelationV2", "StreamingExecutionRelation", "UnresolvedHint", "ResolvedHint")


class UnsupportedCommand(ValueError):
    pass


@dataclass
class Runner:
    """execute() returns a DataFrame for SELECT, SHOW, DESCRIBE and EXPLAIN, started queries for streaming inserts, else None.

    Text that is no command is skipped, as the command language has it; strict=True raises instead.
    """

    spark: SparkSession
    properties: dict[str, str] = field(default_factory=dict)
    streaming: bool = False
    checkpoints: str = "checkpoints"
    trigger: dict = field(default_factory=lambda: {"availableNow": True})
    strict: bool = False
    warehouse: str | None = None
    tables: dict[str, TableDef] = field(default_factory=dict)
    dialect: str = "default"
    pending: list[str] | None = None
    queries: list = field(default_factory=list)
    starts: list[Callable[[], object]] = field(default_factory=list)

    def __post_init__(self) -> None:
        register_functions(self.spark)

    def run_file(self, path: str) -> list:
        return self.run(read_script(path, self.spark if "://" in path else None))

    def run(self, script: str) -> list:
        return [x for s in split_script(script, self.properties) if (x := self.execute(s)) is not None]

    def execute(self, statement: str):
        command = parse_command(statement)
        if command is None:
            if self.strict:
                raise UnsupportedCommand(f"no command: {statement.strip()[:80]}")
            return None
        if command.name == "END":
            statements, self.pending = self.pending or [], None
            return self._insert_all(statements)
        if self.pending is not None:
            if not command.name.startswith("INSERT"):
                raise UnsupportedCommand(f"a statement set holds inserts only, not {command.name}")
            self.pending.append(command.operands[0])
            return None
        return self._dispatch(command)

    def _dispatch(self, c: Command):
        spark, name = self.spark, c.name
        if name == "BEGIN_STATEMENT_SET":
            self.pending = []
        elif name == "CREATE_TABLE":
            self._create(parse_create(c.operands[0]))
        elif name == "DROP_TABLE":
            self._drop(c.operands[0])
        elif name == "CREATE_VIEW":
            spark.sql(rewrite_query(c.operands[1], self._sessions, self._streams)).createOrReplaceTempView(unquoted(c.operands[0]))
        elif name == "DROP_VIEW":
            spark.sql(f"DROP VIEW {c.operands[0]}")
        elif name == "SELECT":
            return spark.sql(rewrite_query(c.operands[0], self._sessions, self._streams))
        elif name.startswith("INSERT"):
            return self._insert_all([c.operands[0]])
        elif name == "SET":
            if not c.operands:
                return spark.sql("SET")
            key, value = c.operands
            if "dialect" in key:
                self.dialect = "hive" if "HIVE" in value.upper() else "default"
            else:
                spark.conf.set(key, value.strip())
        elif name == "RESET":
            self.dialect = "default"
        elif name == "USE":
            spark.catalog.setCurrentDatabase(c.operands[0].strip())
        elif name == "USE_CATALOG":
            spark.catalog.setCurrentCatalog(c.operands[0].strip())
        elif name == "SOURCE":
            self.run_file(c.operands[0].strip())
        elif name in ("DESCRIBE", "EXPLAIN"):
            return spark.sql(f"{name} {rewrite_query(c.operands[0])}")
        elif name.startswith("SHOW_") and name != "SHOW_MODULES":
            return spark.sql(c.sql)
        elif name in ("CREATE_DATABASE", "DROP_DATABASE", "ALTER_DATABASE", "ALTER_TABLE"):
            spark.sql(c.operands[0])
        else:
            raise UnsupportedCommand(f"Unsupported command: {name.replace('_', ' ')}")
        return None

    def _sessions(self, table: str, ts: str, gap: str) -> str | None:
        """A view of a table's rows with their sessions, none for a stream; `gap` is a number and a unit."""
        df = self.spark.table(table)
        name = unquoted(ts)
        if df.isStreaming or name not in df.columns:
            return None
        view = f"_halyard_sessions_{uuid.uuid4().hex}"
        session_rows(df, name, gap.lower()).createOrReplaceTempView(view)
        return view

    def _streams(self, sql: str) -> DataFrame | None:
        """The stream that a query reads; None where it reads tables, or names what isn't known yet, such as a WITH around it."""
        try:
            df = self.spark.sql(sql)
        except AnalysisException:
            return None
        return df if df.isStreaming else None

    def _create(self, table: TableDef) -> None:
        self.tables[table.name] = table
        if table.options.get("connector") in (None, "hive") or table.stored_as or self.dialect == "hive":
            self.spark.sql(spark_create(table, f"{self.warehouse}/{table.name}" if self.warehouse else None))
        elif not self._is_sink(table):
            read_table(self.spark, table, self.streaming).createOrReplaceTempView(table.name)

    @staticmethod
    def _is_sink(table: TableDef) -> bool:
        return table.options.get("connector") in ("clickhouse", "print", "blackhole") or table.options.get("role") == "sink"

    def _drop(self, sql: str) -> None:
        """The table by its whole name. What the script itself declared as a view or sink has no stored table; else a missing one is an error, unless IF EXISTS says so."""
        tokens = significant(sql)
        words = [t.upper() for _, t in tokens]
        exists = words[2:4] == ["IF", "EXISTS"]
        parts, _ = name_at(tokens, 4 if exists else 2)
        known = self.tables.pop(".".join(parts), None)
        view = len(parts) == 1 and self.spark.catalog.dropTempView(parts[0])
        declared = view or known is not None and self._is_sink(known)
        self.spark.sql(f"DROP TABLE {'IF EXISTS ' if exists or declared else ''}{quoted(parts)}")

    def _insert_all(self, statements: list[str]):
        """One insert, or a set.

        Batch: each insert is a job; a view over a connector that several of them read is read once and persisted (on disk where memory doesn't hold it) until
        the set is done, and stored tables are scanned by each insert with its own columns and filters. Streams: inserts that treat each row of the same
        view by itself share one query, which reads each micro-batch once for all of them and gives it to each once, also when it is replayed; others
        (aggregates, joins, distinct rows) have a query each.
        """
        inserts = [parse_insert(s, sessions=self._sessions, streams=self._streams) for s in statements]
        frames = [self.spark.sql(i.query) for i in inserts]
        for i, df in zip(inserts, frames):
            self._check(i, df.columns)
        shared: dict[str, list[Insert]] = {}
        alone = []
        for i, df in zip(inserts, frames):
            view = self._stream_view(i, df) if df.isStreaming else None
            if view is not None:
                shared.setdefault(view, []).append(i)
            elif df.isStreaming:
                alone.append((i, df))
        started = []
        for view, group in shared.items():
            committing = any(self._commits(self.tables.get(i.name)) for i in group)
            started += self._started(self._many(view, group)) if len(group) > 1 or committing else self._started(self._one(group[0]))
        for i, _ in alone:
            started += self._started(self._one(i))
        batch = [i for i, df in zip(inserts, frames) if not df.isStreaming]
        counts: dict[str, int] = {}
        for i in batch:
            for name in sources_of(self.spark, i.query):
                counts[name] = counts.get(name, 0) + 1
        kept = [self.spark.table(n).persist(StorageLevel.MEMORY_AND_DISK) for n, c in counts.items() if c > 1 and self._connected(n)]
        try:
            for i in batch:
                self._write(i, self.spark.sql(i.query), 0)
        finally:
            for df in kept:
                df.unpersist()
        return started or None

    def _connected(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name) and self.spark.catalog.getTable(name).isTemporary

    def _check(self, i: Insert, given: list[str]) -> None:
        target = self.tables.get(i.name)
        fixed = {c for c, v in i.partition.items() if v is not None}
        wanted = i.columns or ([n for n, _ in target.columns if n not in fixed] if target else None)
        if wanted is not None and len(wanted) != len(given):
            raise ValueError(f"{i.name} takes {len(wanted)} columns, the query has {len(given)}")

    def _named(self, i: Insert, df: DataFrame) -> DataFrame:
        """The query's columns by position under the target's names, with the partition's fixed values."""
        target = self.tables.get(i.name)
        fixed = {c: v for c, v in i.partition.items() if v is not None}
        wanted = i.columns or ([n for n, _ in target.columns if n not in fixed] if target else None)
        if wanted:
            df = df.toDF(*wanted)
        for c, v in fixed.items():
            df = df.withColumn(c, F.expr(v))
        if target is not None and i.columns:  # columns that aren't listed are null
            df = df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in target.columns])
        return df

    def _write(self, i: Insert, df: DataFrame, batch_id: int) -> None:
        target = self.tables.get(i.name)
        if target is not None and self._is_sink(target):
            self._sink(target)(self._named(i, df), batch_id)
        else:
            df.createOrReplaceTempView("_halyard_insert")
            df.sparkSession.sql(i.sql("_halyard_insert"))

    def _sink(self, table: TableDef):
        """A database is written at the end of each micro-batch, so sink.flush-interval is the trigger's; which shard takes a row is the server's to say."""
        o = table.options
        if o.get("connector") == "clickhouse":
            url, login = o["url"].replace("clickhouse://", "jdbc:clickhouse://"), {"user": o.get("username", ""), "password": o.get("password", "")}
            if o.get("sink.exactly-once", "false").lower() == "true":  # for databases with transactions
                return OnceJdbc(url, o["table-name"], f"{self.checkpoints}/{table.name}", {k: v for k, v in login.items() if v}, int(o.get("sink.batch-size", 20_000)))
            return jdbc_sink(url, o["table-name"], int(o.get("sink.batch-size", 20_000)), int(o.get("sink.max-retries", 3)), login)
        if o.get("connector") == "print":
            return lambda batch, batch_id: batch.show(truncate=False)
        return lambda batch, batch_id: batch.write.format("noop").mode("overwrite").save()

    def _stream_view(self, i: Insert, df: DataFrame) -> str | None:
        """The one streaming view whose rows the query treats one by one; None if there is no such."""
        views = [n for n in sources_of(self.spark, i.query) if self._connected(n) and self.spark.table(n).isStreaming]
        stack = [df._jdf.queryExecution().analyzed()]
        while stack:
            node = stack.pop()
            if node.getClass().getSimpleName() not in _ROW_BY_ROW:
                return None
            children = node.children().iterator()
            while children.hasNext():
                stack.append(children.next())
        return views[0] if len(views) == 1 else None

    @staticmethod
    def _commits(table: TableDef | None) -> bool:
        return table is not None and bool(table.partitions) and (table.properties | table.options).get("sink.partition-commit.trigger") == "partition-time"

    def _location(self, i: Insert) -> str:
        return self.spark.sql(f"DESCRIBE FORMATTED {quoted(i.parts)}").filter("col_name = 'Location'").first()[1]

    def _committer(self, i: Insert, delay: str, ledger: Ledger, name: str) -> PartitionCommit:
        table = self.tables[i.name]
        o = table.properties | table.options
        return PartitionCommit(self._location(i), table.stored_as or "parquet", table.partitions[-1], seconds(o.get("sink.partition-commit.delay", "0 s")), seconds(delay), o.get("sink.partition-commit.watermark-time-zone", "UTC"), quoted(i.parts), ledger=ledger, name=name)

    def _stored_once(self, i: Insert, ledger: Ledger, name: str) -> Callable[[DataFrame, int], None] | None:
        """Files of a stored table that the script declared, each micro-batch once; None where only a statement of Spark's can write the table."""
        table = self.tables.get(i.name)
        fmt = (table.stored_as or "parquet").lower() if table is not None else None
        if fmt not in ("parquet", "orc") or i.overwrite:
            return None
        sink = OnceFiles(self._location(i), ledger, name, fmt, table.partitions)

        def write(df: DataFrame, batch_id: int) -> None:
            kinds = dict(self.spark.table(quoted(i.parts)).dtypes)
            named = self._named(i, df)
            for part in sink(named.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in kinds]), batch_id):
                spec = ", ".join(f"`{k}` = '{unquote(v)}'" for k, _, v in (x.partition("=") for x in part.split("/")))
                self.spark.sql(f"ALTER TABLE {quoted(i.parts)} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{sink.path}/{part}'")
            self.spark.catalog.refreshTable(quoted(i.parts))

        return write

    def _many(self, view: str, group: list[Insert]) -> Callable[[], object]:
        """Starts one query over a view for several inserts; event time for partition commits is that of the view's watermark column."""
        source = self.tables.get(view)
        mark = source.watermark if source is not None else None
        name = "+".join(sorted(re.sub(r"\W", "_", i.name) for i in group))
        ledger = Ledger(self.spark, f"{self.checkpoints}/{name}-ledger")
        sinks = []
        for k, i in enumerate(group):
            own = f"{k} {i.name}"
            commit = self._committer(i, mark.delay if mark else "0 seconds", ledger, own) if self._commits(self.tables.get(i.name)) else None
            target = self.tables.get(i.name)
            stored = None if commit is not None or target is not None and self._is_sink(target) else self._stored_once(i, ledger, own)
            plain = once(lambda df, batch_id, i=i: self._write(i, df, batch_id), ledger, own)

            def write(batch: DataFrame, batch_id: int, i: Insert = i, commit: PartitionCommit | None = commit, give=stored or plain) -> None:
                df = batch.sparkSession.sql(i.query)
                if commit is None:
                    give(df, batch_id)
                else:
                    newest = batch.agg(F.max(F.unix_micros(F.col(mark.column).cast("timestamp")))).first()[0] if mark else None
                    commit(self._named(i, df), batch_id, newest / 1e6 if newest is not None else None)

            sinks.append(write)
        every = fan_out(sinks)

        def each(batch: DataFrame, batch_id: int) -> None:
            batch.createOrReplaceTempView(view)  # in the query's own session
            every(batch, batch_id)

        return lambda: self.spark.table(view).writeStream.option("checkpointLocation", f"{self.checkpoints}/{name}").trigger(**self.trigger).foreachBatch(each).start()

    def _one(self, i: Insert) -> Callable[[], object]:
        """Starts a query for one insert, made anew at each start."""
        target, name = self.tables.get(i.name), re.sub(r"\W", "_", i.name)

        def start():
            df = self._named(i, self.spark.sql(i.query))
            if "TransformWithState" in df._jdf.queryExecution().analyzed().toString():  # such state lives in RocksDB
                with state_in_rocksdb(self.spark):
                    return begin(df)
            return begin(df)

        def begin(df: DataFrame):
            out = df.writeStream.option("checkpointLocation", f"{self.checkpoints}/{name}").trigger(**self.trigger)
            if target is not None and self._is_sink(target):
                return out.foreachBatch(once(self._sink(target), Ledger(self.spark, f"{self.checkpoints}/{name}-ledger"), i.name)).start()
            if self._commits(target):  # the partition's own time stands for event time
                commit = self._committer(i, "0 seconds", Ledger(self.spark, f"{self.checkpoints}/{name}-ledger"), i.name)
                at = F.unix_seconds(F.max(F.try_to_timestamp(F.col(f"`{target.partitions[-1]}`").cast("string"))))
                return out.foreachBatch(lambda b, k: commit(b, k, b.agg(at).first()[0])).start()
            return out.format((target.stored_as if target else None) or "parquet").toTable(quoted(i.parts))

        return start

    def _started(self, start: Callable[[], object]) -> list:
        query = start()
        self.queries.append(query)
        self.starts.append(start)
        return [query]

    def wait(self, attempts: int = 10, wait_s: float = 60.0) -> None:
        """Until all streaming queries have ended; each that fails is started again from its checkpoint, `attempts` times, whatever the others do."""
        supervised_all(self.queries, self.starts, attempts, wait_s)
        groups = [(t.options["path"], t.options["properties.group.id"]) for t in self.tables.values() if t.options.get("connector") == "filesystem" and "scan.startup.mode" in t.options and "properties.group.id" in t.options]
        if len(groups) == 1:  # else it isn't told which source is whose; the group's next query reads the last micro-batch again
            for q in self.queries:
                keep_place(q, *groups[0])


def main(argv: list[str] | None = None) -> None:
    import argparse

    from halyard.script.splitter import load_profile
    from halyard.session import session

    p = argparse.ArgumentParser(description="Runs a SQL script.")
    p.add_argument("--path", required=True)
    p.add_argument("--active", default="local")
    p.add_argument("--profiles", help="folder of <profile>.properties")
    p.add_argument("--jobName", default="")
    p.add_argument("--jobType", default="", help="anything: batch; nothing: streaming")
    p.add_argument("--chk_time", type=int, default=1000, help="milliseconds between micro-batches")
    p.add_argument("--parallelism", type=int, default=1)
    p.add_argument("--checkpoints", default="checkpoints", help="a folder that outlives the driver, in a shared file system on a cluster")
    p.add_argument("--attempts", type=int, default=10, help="how often a failed query is started again")
    p.add_argument("--wait", type=float, default=60.0, help="seconds before that")
    a = p.parse_args(argv)
    spark = session(a.jobName or a.path)
    if a.parallelism > 1:
        spark.conf.set("spark.sql.shuffle.partitions", a.parallelism)
    runner = Runner(spark, load_profile(a.active, a.profiles) if a.profiles else {}, not a.jobType.strip(), a.checkpoints, {"processingTime": f"{a.chk_time} milliseconds"})
    for x in runner.run_file(a.path):
        if isinstance(x, DataFrame):
            x.show(truncate=False)
    runner.wait(a.attempts, a.wait)


if __name__ == "__main__":
    main()
