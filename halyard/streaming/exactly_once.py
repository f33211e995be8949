"""Sinks that give each micro-batch once, however often it is replayed: a ledger of batch ids beside the checkpoint.

A query that fails after some of its sinks had written is started again from its checkpoint and replays that micro-batch with the same id and rows.
Each sink looks its id up first, so what was given stays as it is, and what wasn't is given now.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Files:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, where: str):
        return self.jvm.org.apache.hadoop.fs.Path(where)

    def exists(self, where: str) -> bool:
        return self.fs.exists(self.path(where))

    def delete(self, where: str) -> None:
        self.fs.delete(self.path(where), True)

    def read(self, where: str) -> str:
        stream = self.fs.open(self.path(where))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_whole(self, where: str, text: str) -> None:
        """Appears whole or not at all."""
        part = self.path(f"{where}.{uuid.uuid4().hex}.part")
        self.fs.mkdirs(part.getParent())
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(part, self.path(where)):
            self.fs.delete(part, False)
            if not self.exists(where):
                raise OSError(f"can't write {where}")

    def move(self, source: str, target: str) -> None:
        """Does nothing if it was done before."""
        a, b = self.path(source), self.path(target)
        if not self.fs.exists(a):
            if not self.fs.exists(b):
                raise OSError(f"neither {source} nor {target} is there")
            return
        self.fs.mkdirs(b.getParent())
        if not self.fs.rename(a, b):
            raise OSError(f"can't move {source} to {target}")

    def under(self, where: str) -> list[str]:
        """Files below, by their path from there, without hidden ones."""
        if not self.exists(where):
            return []
        root = self.fs.makeQualified(self.path(where)).toString().rstrip("/") + "/"
        found, out = self.fs.listFiles(self.path(where), True), []
        while found.hasNext():
            name = found.next().getPath().toString().removeprefix(root)
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                out.append(name)
        return sorted(out)


class Ledger:
    """What each sink has given: a file per sink and batch id in a folder beside the query's checkpoint.

    Entries of batches long past aren't needed, as a checkpoint replays its last batch only; the last `keep` of a sink stay.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 100) -> None:
        self.folder, self.files, self.keep = folder.rstrip("/"), Files(spark, folder), keep

    def _at(self, sink: str, batch_id: int, kind: str) -> str:
        return f"{self.folder}/{re.sub(r'\W', '_', sink)}-{hashlib.md5(sink.encode()).hexdigest()[:8]}/{batch_id:012d}.{kind}"

    def done(self, sink: str, batch_id: int) -> bool:
        return self.files.exists(self._at(sink, batch_id, "done"))

    def plan(self, sink: str, batch_id: int) -> dict | None:
        """What a former try was about to do when it had all that it needs."""
        where = self._at(sink, batch_id, "plan")
        return json.loads(self.files.read(where)) if self.files.exists(where) else None

    def planned(self, sink: str, batch_id: int, plan: dict) -> None:
        self.files.write_whole(self._at(sink, batch_id, "plan"), json.dumps(plan))

    def finish(self, sink: str, batch_id: int) -> None:
        self.files.write_whole(self._at(sink, batch_id, "done"), "")
        if batch_id >= self.keep:
            for kind in ("plan", "done"):
                self.files.delete(self._at(sink, batch_id - self.keep, kind))


def once(sink: Callable[[DataFrame, int], None], ledger: Ledger, name: str) -> Callable[[DataFrame, int], None]:
    """A sink that isn't called again for a batch that it has finished. One that fails half-way is called again, so it must undo or repeat its own work."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if not ledger.done(name, batch_id):
            sink(batch, batch_id)
            ledger.finish(name, batch_id)

    return write


class OnceFiles:
    """foreachBatch sink: the files of each micro-batch appear in the folder once.

    They are written to a hidden folder, then a plan of their moves is put into the ledger, then they are moved under names that hold the batch id.
    A try that fails before the plan leaves only hidden files, which the next one replaces; after it, the next one finishes the moves. Returns the
    partition values of the batch, as `column=value`, whether it is given now or was before.
    """

    def __init__(self, path: str, ledger: Ledger, name: str | None = None, fmt: str = "parquet", partition: list[str] | None = None, options: dict[str, str] | None = None) -> None:
        self.path, self.ledger, self.name = path.rstrip("/"), ledger, name or path
        self.format, self.partition, self.options = fmt, partition or [], options or {}
        self.token = hashlib.md5(f"{ledger.folder}/{self.name}".encode()).hexdigest()[:12]

    def __call__(self, batch: DataFrame, batch_id: int) -> list[str]:
        files = self.ledger.files
        plan = self.ledger.plan(self.name, batch_id)
        stage = f"{self.path}/_staged-{self.token}/{batch_id:012d}"
        if not self.ledger.done(self.name, batch_id):
            if plan is None:
                batch.write.mode("overwrite").format(self.format).options(**self.options).partitionBy(*self.partition).save(stage)
                moves = []
                for k, x in enumerate(files.under(stage)):
                    folder, _, file = x.rpartition("/")
                    moves.append((x, f"{folder}/b{batch_id:012d}-{self.token}-{k}-{file}".lstrip("/")))
                plan = {"moves": moves}
                self.ledger.planned(self.name, batch_id, plan)
            for source, target in plan["moves"]:
                self._moved(f"{stage}/{source}", f"{self.path}/{target}")
            self.ledger.finish(self.name, batch_id)
        files.delete(stage)
        return sorted({target.rpartition("/")[0] for _, target in (plan or {"moves": []})["moves"]} - {""})

    def _moved(self, source: str, target: str) -> None:
        self.ledger.files.move(source, target)


class OnceJdbc:
    """foreachBatch sink for a database with transactions: a batch's rows and its ledger entry are committed together.

    Tasks write to a table of the batch's own; one transaction then copies it into the target and notes the batch id in a ledger table of the
    database, so neither is there without the other. A try that fails leaves that table, which the next one replaces.
    """

    LEDGER = "halyard_ledger"

    def __init__(self, url: str, table: str, query: str, properties: dict[str, str] | None = None, batch_size: int = 20_000) -> None:
        self.url, self.table, self.query, self.properties, self.batch_size = url, table, query, properties or {}, batch_size
        self.name = hashlib.md5(f"{query}/{table}".encode()).hexdigest()

    def _connection(self, spark: SparkSession):
        jvm = spark.sparkContext._jvm
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.url, given)

    def _run(self, connection, *statements: str) -> None:
        for s in statements:
            statement = connection.createStatement()
            try:
                statement.execute(s)
            finally:
                statement.close()

    def _given(self, connection, batch_id: int) -> bool:
        if not connection.getMetaData().getTables(None, None, self.LEDGER.upper(), None).next() and not connection.getMetaData().getTables(None, None, self.LEDGER, None).next():
            self._run(connection, f"CREATE TABLE {self.LEDGER} (sink VARCHAR(32) NOT NULL, batch_id BIGINT NOT NULL, PRIMARY KEY (sink, batch_id))")
            return False
        statement = connection.createStatement()
        try:
            return statement.executeQuery(f"SELECT 1 FROM {self.LEDGER} WHERE sink = '{self.name}' AND batch_id = {batch_id}").next()
        finally:
            statement.close()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"stage_{self.name[:12]}"
        connection = self._connection(spark)
        try:
            if self._given(connection, batch_id):
                return
            batch.limit(0).write.mode("append").jdbc(self.url, self.table, properties=self.properties)  # makes it where it is missing
            batch.write.mode("overwrite").option("batchsize", self.batch_size).jdbc(self.url, own, properties=self.properties)
            names = ", ".join('"' + c.replace('"', '""') + '"' for c in batch.columns)
            connection.setAutoCommit(False)
            try:
                self._run(connection, f"INSERT INTO {self.table} ({names}) SELECT {names} FROM {own}", f"INSERT INTO {self.LEDGER} VALUES ('{self.name}', {batch_id})")
                connection.commit()
            except Exception:
                connection.rollback()
                raise
            connection.setAutoCommit(True)
            self._run(connection, f"DROP TABLE {own}")
        finally:
            connection.close()
