"""Fuzzy dedup of lines by MinHash over character shingles, exact verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import frozen, released, shuffle_partitions, text_of
from halyard.llm.components import Forest, components

SHINGLE, SIMILAR = 5, 0.8
#: At similarity 0.8 a pair shares one of 13 bands of 5 with a chance of 0.994, at 0.9 of 1 - 1e-5.
BANDS, ROWS = 13, 5
#: Bits by which sets are told apart before they are compared.
MARKS = 1024
#: Lines of a bucket that one task compares; larger buckets are compared in pairs of blocks. Band rows of one task.
BLOCK, TASK_ROWS = 8192, 1_000_000
#: Documents read, and shingles compared, at once; lines that a task remembers to have met.
DOCS, PAIR_HASHES, MET = 64, 1 << 18, 1 << 19


#: White space below code point 256 other than space and line feed.
OTHER_SPACES = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0"


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """normal() of each line. Texts below code point 256 with single spaces only, as most are, needn't be cut into words."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return [normal(x) for x in text.split("\n")]
    if "  " in text or any(c in text for c in OTHER_SPACES):
        return [normal(x) for x in text.split("\n")]
    return [x.strip() for x in text.lower().split("\n")]


def _runs(x: np.ndarray, n: int, by: int) -> np.ndarray:
    """Polynomials of each n consecutive entries: the first's power is the highest. Each is put together from those of its halves."""
    if n == 1:
        return x
    half = _runs(x, n // 2, by)
    out = half[: max(0, half.size - n // 2)] * np.uint64(pow(by, n // 2, 2**64))
    out += half[n // 2 :]
    if n % 2:
        out = out[: max(0, x.size - n + 1)] * np.uint64(by)
        out += x[n - 1 :]
    return out


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of SHINGLE code points of each line (shorter lines: of the whole), repeats included, line after line; and where each line's end."""
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\U0010ffff") for x in lines]
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    x = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = _runs(x, SHINGLE, 0x9E3779B97F4A7C15)
    inside = np.ones(x.size, bool)  # a run mustn't reach into the next line
    for k in range(1, SHINGLE):
        inside[np.cumsum(size) - k] = False
    h = h[inside[: h.size]]
    for shift in (32, 29):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, np.cumsum(size - SHINGLE + 1)


class Sets:
    """The shingle sets of some lines, as one sorted array: the upper bits of an entry number its line, the rest are of the shingle's hash."""

    def __init__(self, lines: list[str]) -> None:
        h, ends = shingle_hashes(lines)
        self.bits = np.uint64(max(1, len(lines)).bit_length())
        self.shift = np.uint64(64) - self.bits
        h >>= self.bits
        h |= np.repeat(np.arange(len(lines), dtype=np.uint64) << self.shift, np.diff(ends, prepend=0))
        h.sort()
        new = np.ones(h.size, bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        h = h[new]
        self.size = np.bincount((h >> self.shift).astype(np.int64), minlength=len(lines))
        self.start = np.cumsum(self.size) - self.size
        marks = np.zeros(len(lines) * MARKS, bool)
        marks[((h >> self.shift) * np.uint64(MARKS) + h % np.uint64(MARKS)).view(np.int64)] = True
        self.marks = np.packbits(marks.reshape(-1, MARKS), axis=1).view(np.uint64)
        self.hash = h & ((np.uint64(1) << self.shift) - np.uint64(1))

    def possible(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """False where the lines a[k] and b[k] can't have a similarity of `least`. A mark that just one of them has stands for a shingle that the
        other lacks, and at that similarity at most (1 - least) / (1 + least) of both sets' entries are such."""
        out = np.minimum(self.size[a], self.size[b]) >= least * np.maximum(self.size[a], self.size[b])
        for at in range(0, a.size, 1 << 16):
            some = np.flatnonzero(out[at : at + (1 << 16)]) + at
            differ = np.bitwise_count(self.marks[a[some]] ^ self.marks[b[some]]).sum(1, dtype=np.int64)
            out[some] = differ <= (1 - least) / (1 + least) * (self.size[a[some]] + self.size[b[some]]) + 1e-6
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many shingles the lines a[k] and b[k] share, for each k."""
        out, total = np.zeros(a.size, np.int64), np.cumsum(self.size[a] + self.size[b])
        at = 0
        while at < a.size:  # some pairs at once, and one at least
            upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIR_HASHES, "right"))
            upto = min(max(upto, at + 1), at + (1 << int(self.bits)))
            which = np.concatenate((a[at:upto], b[at:upto]))
            size = self.size[which]
            entries = self.hash[np.repeat(self.start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            entries |= np.repeat(np.tile(np.arange(upto - at, dtype=np.uint64), 2) << self.shift, size)
            entries.sort()
            twice = entries[1:][entries[1:] == entries[:-1]]
            out[at:upto] = np.bincount((twice >> self.shift).astype(np.int64), minlength=upto - at)
            at = upto
        return out


def signatures(lines: list[str]) -> np.ndarray:
    """A row of BANDS hashes per line. One permutation: the hashes are dealt to BANDS * ROWS bins by their upper bits, and each bin keeps its
    least; an empty bin takes that of the next filled one, marked by the distance."""
    bins = BANDS * ROWS
    least = np.full(len(lines) * bins, np.iinfo(np.uint64).max, np.uint64)
    if lines:
        h, ends = shingle_hashes(lines)
        owner = np.repeat(np.arange(len(lines)), np.diff(ends, prepend=0))
        bin_ = h >> np.uint64(32)
        bin_ *= np.uint64(bins)
        bin_ >>= np.uint64(32)
        np.minimum.at(least, owner * bins + bin_.view(np.int64), h)
    least = least.reshape(len(lines), bins)
    empty = least == np.iinfo(np.uint64).max
    filled, todo = least.copy(), empty.copy()
    for step in range(1, bins):
        rows = np.flatnonzero(todo.any(1))
        if not rows.size:
            break
        near, ok = np.roll(least[rows], -step, 1), ~np.roll(empty[rows], -step, 1)
        take = todo[rows] & ok
        filled[rows] = np.where(take, near + np.uint64(step * 0xA24BAED4963EE407 % 2**64), filled[rows])
        todo[rows] &= ~take
    out = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(ROWS):
        out = (out ^ filled[:, k::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(31)
    return out * np.uint64(2) ^ np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def identity(line: str) -> tuple[int, int]:
    """Both halves of a 128-bit hash, as signed numbers: a line's id and its check."""
    both = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (both & 0xFFFFFFFFFFFFFFFF) - 2**63, (both >> 64) - 2**63


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of documents; bands where the task meets a line first (or again after MET others)."""
    met: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            some = batch.slice(at, DOCS)
            owner, number, ids, checks, new = [], [], [], [], []
            texts: list[str] = []
            if len(met) > MET:
                met.clear()
            for r, text in enumerate(some.column("text").to_pylist()):
                for k, line in enumerate(normal_lines(text)):
                    if line:
                        id_, check = identity(line)
                        owner.append(r)
                        number.append(k)
                        ids.append(id_)
                        checks.append(check)
                        new.append(id_ not in met)
                        if id_ not in met:
                            met.add(id_)
                            texts.append(line)
            first, owner = np.array(new, bool), pa.array(owner, pa.int32())
            ends = np.append(0, np.cumsum(first) * BANDS).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(signatures(texts).view(np.int64).ravel()), mask=pa.array(~first))
            own = {n: some.column(n).take(owner) for n in ("row", "_id", "key")}
            yield pa.RecordBatch.from_pydict(own | {"line_no": pa.array(number, pa.int32()), "id": pa.array(ids, pa.int64()), "check": pa.array(checks, pa.int64()), "new": pa.array(first), "bands": bands})


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, dealt by band hash: buckets of at least two different lines, named by a hash of their set, so that equal buckets are one."""
    got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if got is None or not got.num_rows:
        return
    band, ids = got.column("band").to_numpy(), got.column("id").to_numpy()
    order = np.argsort(band)
    band, ids = band[order], ids[order]
    same = band[1:] == band[:-1]
    shared = np.append(False, same) | np.append(same, False)
    band, ids = band[shared], ids[shared]  # few are; only these need their ids in order
    if not ids.size:
        return
    order = np.lexsort((ids, band))
    band, ids = band[order], ids[order]
    new = np.ones(band.size, bool)
    new[1:] = (band[1:] != band[:-1]) | (ids[1:] != ids[:-1])
    band, ids = band[new], ids[new]
    heads = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
    sizes = np.diff(np.append(heads, band.size))
    h = ids.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    name = np.add.reduceat(h, heads).view(np.int64)
    take = np.repeat(sizes > 1, sizes)
    bucket, size = np.repeat(name, sizes)[take], np.repeat(sizes, sizes)[take]
    ids = ids[take]
    for k in range(0, ids.size, 100_000):
        yield pa.RecordBatch.from_pydict({"bucket": bucket[k : k + 100_000], "size": size[k : k + 100_000], "id": ids[k : k + 100_000]})


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that a document stands for, once for each bucket and pair of blocks; of repeated documents one (MET others later: one more) gives them. What isn't the line asked for is another document's with the same key."""
    names = ("bucket", "two", "side", "id")
    given: set[tuple[int, int]] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS):
            some = batch.slice(at, DOCS)
            rows = list(zip(some.column("key").to_pylist(), map(_digest, some.column("text").to_pylist())))
            if not given.isdisjoint(rows) or len(set(rows)) < len(rows):  # repeated rows: the first gives the lines
                fresh = [x not in given and x not in rows[:k] for k, x in enumerate(rows)]
                some = some.filter(pa.array(fresh))
            given.update(rows)
            if len(given) > MET:
                given.clear()
            wanted = pc.list_flatten(some.column("wanted"))
            asked = iter(zip(wanted.field("line_no").to_pylist(), wanted.field("id").to_pylist()))
            lines: list[str | None] = []
            for text, n in zip(some.column("text").to_pylist(), pc.list_value_length(some.column("wanted")).to_pylist()):
                parts = text.split("\n")
                found: dict[int, str | None] = {}
                for k, id_ in islice(asked, n):
                    if k not in found:
                        line = normal(parts[k]) if k < len(parts) else ""
                        found[k] = line if identity(line)[0] == id_ else None
                    lines.append(found[k])
            out = pa.RecordBatch.from_arrays([*(wanted.field(n) for n in names), pa.array(lines, pa.string())], [*names, "line"])
            yield out.filter(pc.is_valid(out.column("line"))) if None in lines else out


def similar(lines: list[str], ends: np.ndarray | None = None, sides: np.ndarray | None = None, least: float = SIMILAR) -> Forest:
    """Joins lines whose shingle sets have a Jaccard similarity of at least `least`, unless they are joined already.

    ends: where each of several buckets ends; only lines of a bucket are compared. sides: where a bucket has two, compare across them only.
    All buckets go on at once: in round k the k-th line of each meets those after it; a bucket is done when these are in one tree.
    """
    forest, sets = Forest(len(lines)), Sets(lines)
    ends = np.array([len(lines)]) if ends is None else ends
    first = np.concatenate(([0], ends[:-1]))
    if sides is None:
        sides, two = np.zeros(len(lines), np.int8), np.zeros(ends.size, bool)
    else:
        two = np.maximum.reduceat(sides, first) != np.minimum.reduceat(sides, first)
    while True:
        go = ends - first > 1
        first, ends, two = first[go], ends[go], two[go]
        if not first.size:
            return forest
        n = ends - first - 1
        head = np.cumsum(n) - n
        mine = np.repeat(first, n)
        rest = mine + 1 + np.arange(n.sum()) - np.repeat(head, n)
        apart = forest.find(mine) != forest.find(rest)
        ask = np.flatnonzero(apart & (~np.repeat(two, n) | (sides[mine] != sides[rest])))
        ask = ask[sets.possible(mine[ask], rest[ask], least)]
        a, b = mine[ask], rest[ask]
        both = sets.common(a, b)
        near = both >= least * (sets.size[a] + sets.size[b] - both)
        forest.join(a[near], b[near])
        apart[ask] = ~near
        more = np.logical_or.reduceat(apart, head)
        first, ends, two = first[more] + 1, ends[more], two[more]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, dealt by bucket and blocks: edges that join what is similar."""
    got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if got is None or not got.num_rows:
        return
    got = got.sort_by([("bucket", "ascending"), ("two", "ascending"), ("id", "ascending")])
    bucket, two, ids = (got.column(n).to_numpy() for n in ("bucket", "two", "id"))
    again = (bucket[1:] == bucket[:-1]) & (two[1:] == two[:-1]) & (ids[1:] == ids[:-1])
    if again.any():  # a line fetched more than once
        got = got.filter(pa.array(np.append(True, ~again)))
        bucket, two = got.column("bucket").to_numpy(), got.column("two").to_numpy()
    ends = np.flatnonzero(np.append((bucket[1:] != bucket[:-1]) | (two[1:] != two[:-1]), True)) + 1
    sides, ids, lines = got.column("side").to_numpy(), got.column("id").to_numpy(), got.column("line")
    long = np.cumsum(pc.utf8_length(lines).to_numpy())
    begin, k = 0, 0
    while k < ends.size:  # some buckets at once, and one at least
        upto = int(np.searchsorted(long[ends - 1], (long[begin - 1] if begin else 0) + PAIR_HASHES, "right"))
        upto = max(upto, k + 1)
        end = int(ends[upto - 1])
        a, b = similar(lines.slice(begin, end - begin).to_pylist(), ends[k:upto] - begin, sides[begin:end]).edges()
        yield pa.RecordBatch.from_pydict({"a": ids[begin:end][a], "b": ids[begin:end][b]})
        begin, k = end, upto


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line that isn't blank: <id_col>, line_no (from 0), component_doc_id, component_line_no (of the line that stays), kept.

    Lines are cut at line feeds, lower-cased, and their white space becomes one space. Lines whose sets of five-character shingles
    have a Jaccard similarity of 0.8 or more link (found by MinHash banding, each verified on the sets); equal lines are one. Of a
    component the first line by id (null last), row and number stays. Blank lines have no row: keep them as they are. Null texts have
    none; repeated rows are documents of their own; an empty table gives no rows. The order and partitioning of docs don't matter.

    Rows are numbered and cut into lines once, and all later steps read that table. Only hashes of lines are shuffled to find buckets, once
    for each task that meets a line. Texts of lines that share a bucket are fetched from the documents by a hash of id and text, and must
    have the line's hash. Equal buckets of several bands are compared once, and inside a bucket only lines that aren't joined yet. Buckets
    beyond BLOCK lines are compared in pairs of blocks. Tasks return forests, never pairs. Lines are the same if both halves of a 128-bit
    hash are; where only the first is, the line with the larger second half stays as it is.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("text")).withColumn("key", F.xxhash64("_id", "text"))
    kind = dict(own.dtypes)["_id"]
    rows = own.select(F.monotonically_increasing_id().alias("row"), "_id", "key", "text").mapInArrow(_lines, f"row long, _id {kind}, key long, line_no int, id long, check long, new boolean, bands array<long>")
    banded = frozen(rows, "banded")
    parts = max(shuffle_partitions(spark), -(-banded.filter("new").count() * BANDS // TASK_ROWS))
    bands = banded.filter("new").select("id", F.explode("bands").alias("band"))
    # Many tasks may have met a line; its bands are equal, and so are those rows.
    buckets = frozen(bands.repartition(parts, "band").mapInArrow(_buckets, "bucket long, size long, id long").distinct(), "buckets")
    lines = frozen(banded.drop("bands", "new"), "lines")
    released(banded)
    place = F.min(F.struct(F.isnull("_id").alias("none"), F.col("_id").alias("id"), "row", "line_no", "key")).alias("at")
    distinct = frozen(lines.groupBy("id").agg(place, F.min("check").alias("least")), "distinct")
    ways = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("ways")).cast("int")
    dealt = buckets.withColumn("ways", ways).withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    dealt = dealt.select("bucket", "id", (F.least("own", "other") * F.col("ways") + F.greatest("own", "other")).alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    wanted = dealt.join(distinct.select("id", "at.key", "at.line_no").hint("shuffle_hash"), "id").groupBy("key").agg(F.collect_list(F.struct("bucket", "two", "side", "id", "line_no")).alias("wanted"))
    asked = own.select("key", "text").join(wanted.hint("shuffle_hash"), "key").select("key", "text", "wanted")
    fetched = asked.mapInArrow(_fetch, "bucket long, two int, side int, id long, line string")
    edges = frozen(fetched.repartition(parts, "bucket", "two").mapInArrow(_verify, "a long, b long"), "similar")
    released(buckets)
    joined = frozen(components(edges).join(distinct, F.col("node") == F.col("id")).select("id", "label", "at"), "joined")
    heads = frozen(joined.groupBy("label").agg(F.min("at").alias("first")), "heads")
    moved = joined.join(heads, "label").select(F.col("id").alias("_moved"), "first")
    first = frozen(distinct.join(moved, F.col("id") == F.col("_moved"), "left").select("id", "least", F.coalesce("first", "at").alias("first")), "first")
    released(joined, heads, distinct)
    same = F.col("check") == F.col("least")
    pick = lambda there, here: F.when(same, F.col(f"first.{there}")).otherwise(F.col(here))
    out = lines.join(first.hint("shuffle_hash"), "id")  # lines, the many, needn't be sorted
    kept = ~same | (F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select(F.col("_id").alias(id_col), "line_no", pick("id", "_id").alias("component_doc_id"), pick("line_no", "line_no").alias("component_line_no"), kept.alias("kept"))


def op3_line_dedup(spark, sf_dir):
    return line_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
