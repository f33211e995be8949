"""A stream of the lines of files that grow, with byte offsets: where to begin is the reader's choice, and a group's place outlives its queries."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

NAME = "halyard_lines"
#: Bytes that one task reads, and that it holds at once.
CHUNK, BLOCK = 64 << 20, 4 << 20
MODES = ("earliest-offset", "latest-offset", "group-offsets")


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at `first` or behind, before `last`; begin: where the lines that are asked for begin."""

    file: str
    begin: int
    first: int
    last: int
    end: int


class LinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.mode = options["path"], options.get("mode", "earliest-offset")
        if self.mode not in MODES:
            raise ValueError(f"no startup mode {self.mode}; there are {', '.join(MODES)}")
        self.group, self.chunk = options.get("group"), int(options.get("chunk", CHUNK))

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def _place(self) -> str:
        return f"{self._files()[1].rstrip('/')}/_groups/{self.group}.json"

    def _ends(self) -> dict[str, int]:
        """The end of the last whole line of each file; one that is being written waits."""
        system, root = self._files()
        out = {}
        for x in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = x.path[len(root.rstrip("/")) + 1 :]
            if x.type != fs.FileType.File or any(p.startswith(("_", ".")) for p in name.split("/")):
                continue
            with system.open_input_file(x.path) as f:
                at = x.size
                while at > 0:
                    size = min(at, 1 << 16)
                    f.seek(at - size)
                    cut = f.read(size).rfind(b"\n")
                    if cut >= 0:
                        out[name] = at - size + cut + 1
                        break
                    at -= size
        return out

    def initialOffset(self) -> dict:
        if self.mode == "latest-offset":
            return self._ends()
        if self.mode == "group-offsets" and self.group:
            system, _ = self._files()
            if system.get_file_info(self._place()).type == fs.FileType.File:
                with system.open_input_file(self._place()) as f:
                    return json.loads(f.read())
        return {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, last in sorted(end.items()):
            begin = start.get(name, 0)
            if last < begin:
                raise ValueError(f"{name} had {begin} bytes and has {last}")
            out += [Range(name, begin, a, min(a + self.chunk, last), last) for a in range(begin, last, self.chunk)]
        return out

    def commit(self, end: dict) -> None:
        """A group's place is kept beside the files, so that another query of the group goes on from it. Spark calls this for a micro-batch when it plans the next one."""
        if self.group:
            system, _ = self._files()
            system.create_dir(self._place().rpartition("/")[0])
            with system.open_output_stream(f"{self._place()}.part") as f:
                f.write(json.dumps(end).encode())
            system.move(f"{self._place()}.part", self._place())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = self._files()
        with system.open_input_file(f"{root.rstrip('/')}/{partition.file}") as f:
            at = partition.first
            if at > partition.begin:  # a line that began before belongs to the range before
                at -= 1
                f.seek(at)
                while at < partition.end:
                    part = f.read(min(1 << 16, partition.end - at))
                    cut = part.find(b"\n")
                    if cut >= 0:
                        at += cut + 1
                        break
                    at += len(part)
            f.seek(at)
            held, begun = b"", at  # begun: where held begins
            while begun < partition.last:
                part = f.read(min(BLOCK, partition.end - begun - len(held)))
                held += part
                lines = held.split(b"\n")
                rest = lines.pop()
                texts = []
                for line in lines:
                    if begun >= partition.last:
                        break
                    texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    begun += len(line) + 1
                held = rest
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
                if not part:
                    break


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LinesReader(dict(self.options))


def keep_place(query: StreamingQuery, path: str, group: str) -> None:
    """Notes for the group what an ended query of one source had read: its last micro-batch too, which Spark itself would only report with a next one."""
    ends = [p["sources"][0]["endOffset"] for p in (json.loads(x.json) for x in query.recentProgress) if len(p["sources"]) == 1]
    known = [json.loads(x) if isinstance(x, str) else x for x in ends if x is not None]
    if known:
        LinesReader({"path": _uri(path), "mode": "group-offsets", "group": group}).commit(known[-1])


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def lines_stream(spark: SparkSession, path: str, mode: str = "earliest-offset", group: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """value: the lines of all files below path, those to come included, in ranges of `chunk` bytes a task.

    mode, for a query without a checkpoint: earliest-offset reads all there is, latest-offset what comes from now on, group-offsets what comes behind the place that the
    last query of the group had reached (all, if there was none; its last micro-batch again, unless keep_place() was called when it ended). A query with a checkpoint goes on from there. Files only grow; names that begin with _ or .
    are left out, and a last line without its line feed waits for it. path: in any file system that driver and executors share and pyarrow can reach.
    """
    spark.dataSource.register(Lines)
    reader = spark.readStream.format(NAME).option("path", _uri(path)).option("mode", mode).option("chunk", chunk)
    return (reader.option("group", group) if group else reader).load()
