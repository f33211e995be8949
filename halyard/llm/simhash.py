"""SimHash near-dedup by tiled exact comparison of fingerprints; near copies by exact similarity of shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import batch_bytes, frozen, give_back, giving_back, keep_rows, released, shuffle_partitions, text_of
from halyard.llm.components import Forest, components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile, of a part of a population count, and of a packed block; comparisons of one task, about.
TILE, PART, BLOCK, TASK_PAIRS = 512, 1 << 16, 4096, 1 << 32
#: Shingles of one text whose bits are counted at once.
SLICE = 1 << 16
#: Near copies of drop_near_copies(): words of a shingle, similarity of the sets.
COPY_WORDS, SIMILAR = 5, 0.8
#: Sketches have 256 bits. At that similarity 39 of them differ, give or take 6, and 10 of the first 64, give or take 3; of texts that share
#: nothing 128 and 32. Pairs up to FIRST and REACH are verified; up to SURE they are taken to be near while deciding which pairs to verify.
FIRST, REACH, SURE = 20, 62, 32
#: The order of shingles: documents of the sample that it is taken from, about, and shingles that it knows to be common.
SAMPLE, COMMON = 20_000, 400_000
#: Words of the bit map that is dealt with a prefix at most.
MAP = 32
#: Shingles of one part of the prefixes, about; documents dealt and pairs looked at at once; bytes of a batch of texts or sets.
SHARE, DEAL, LOOK, BATCH = 1 << 18, 1 << 12, 1 << 18, 4 << 20
MIXERS = np.array([0, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits: a bit is 1 if it is set in over half the hashes of the text's shingles. No words: 0.

    bytes.lower() and bytes.split() know just A-Z and the six white-space characters, as the rule has it.
    """
    return int(majority(shingle_hashes(text, words, seed)))


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the text's shingles, repeats included; fewer words are one shingle, none give none."""
    parts = text.lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if parts else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: -words])).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), "<u8", len(ends))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, SLICE):
        ones += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > hashes.size, bitorder="little").view("<u8")[0]


def sketch(hashes: np.ndarray) -> list[np.uint64]:
    """256 bits of a set: its majority bits, and those of three other hashes of each entry."""
    out = [majority(hashes)]
    for by in MIXERS[1:]:
        x = (hashes ^ (hashes >> np.uint64(31))) * by
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(majority(x ^ (x >> np.uint64(32))))
    return out


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a set's sorted hashes, common ones (sorted, with their counts) last: as many as have one in common with any similar set's."""
    if common.size:
        at = np.minimum(np.searchsorted(common, hashes), common.size - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: hashes.size // 5 + 1]


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit map of two to four bits an entry: a bit is 1 if an odd number of entries fall on it, by their lowest bits."""
    bits = max(64, 1 << int(2 * hashes.size - 1).bit_length()) if hashes.size else 64
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view("<u8")


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """At least so many entries are in just one of the two sets with these parities. The larger map is folded to the size of the smaller."""
    if x.size < y.size:
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, y.size), axis=0) ^ y).sum())


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A parity map, or rows of them, in so many words at most: entries of both halves fall together as by one bit less of their hashes."""
    return x if x.shape[-1] <= words else np.bitwise_xor.reduce(x.reshape(*x.shape[:-1], -1, words), axis=-2)


def map_words(size: int) -> int:
    """Words of the map that goes with a prefix: one or two bits an entry, half as many as the whole map has, up to MAP."""
    return min(MAP, max(1, (1 << int(size - 1).bit_length()) // 64 if size > 1 else 1))


@giving_back
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that may be similar: similar sets of m and n entries have (m + n) / 9 at most that just one of them has."""
    for batch in batches:
        sizes = (batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()).tolist()
        maps = zip(*([np.frombuffer(z.as_buffer(), "<u8") for z in batch.column(n)] for n in "xy"))
        yield batch.select(["a", "b"]).filter(pa.array([9 * least_apart(x, y) <= size for (x, y), size in zip(maps, sizes)], pa.bool_()))


def _sketches(common: np.ndarray, counts: np.ndarray):
    @giving_back
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                rows, sizes, prefixes, parities = [], [], [], []
                for cell in batch.column("_text"):
                    hashes = np.unique(shingle_hashes(cell.as_py(), COPY_WORDS))
                    both = xxhash.xxh3_128_intdigest(hashes.tobytes())
                    rows.append((both & 0xFFFFFFFFFFFFFFFF, both >> 64, *sketch(hashes)))
                    sizes.append(hashes.size)
                    prefixes.append(prefix(hashes, common, counts).tobytes())
                    parities.append(parity(hashes).tobytes())
                found = np.array(rows, np.uint64).reshape(-1, 6).view(np.int64)
                names = [n for n in batch.schema.names if n != "_text"]
                columns = [*(batch.column(n) for n in names), *(pa.array(found[:, k]) for k in range(6)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(parities, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "node", "check", "fp", "f1", "f2", "f3", "size", "prefix", "parity"])

    return sketches


@giving_back
def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column("_text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(cell.as_py(), COPY_WORDS)).view(np.int64))], ["entry"])


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample have, sorted, and in how many. They only decide the order of shingles, not what is found."""
    every = -(-rows.count() // SAMPLE)
    some = rows.filter(F.pmod(F.xxhash64("_key"), F.lit(max(1, every))) == 0).select("_text")
    often = some.mapInArrow(_entries, "entry long").groupBy("entry").count().filter("count > 1").orderBy(F.desc("count"), "entry").limit(COMMON).toArrow()
    entries, counts = often.column("entry").to_numpy().view(np.uint64), often.column("count").to_numpy()
    order = np.argsort(entries)
    return entries[order], counts[order]


#: A block's entries, with their places and the number of their document in the block; its documents, with the words of their maps end to end.
_PACKED = {"entries": "<u8", "places": "<i4", "docs": "<i4", "nodes": "<i8", "labels": "<i8", "sizes": "<i4", "maps": "<u8"}


def _dealt(ways: int):
    """Prefixes (node, label, size, prefix, parity) to packed blocks of their entries, by part; a block has each of its documents once, with its bit map."""
    @giving_back
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, DEAL) for at in range(0, whole.num_rows, DEAL)):
                prefixes = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("prefix")]
                sizes = batch.column("size").to_numpy()
                maps = [folded(np.frombuffer(x.as_buffer(), "<u8"), map_words(n)) for x, n in zip(batch.column("parity"), sizes.tolist())]
                lengths = np.array([x.size for x in prefixes])
                entries = np.concatenate(prefixes)
                parts = (entries % np.uint64(ways)).astype(np.int64)
                order = np.argsort(parts, kind="stable")
                doc = np.repeat(np.arange(lengths.size), lengths)[order]
                place = (np.arange(entries.size) - np.repeat(np.cumsum(lengths) - lengths, lengths))[order]
                entries = entries[order]
                of = {f"{n}s": batch.column(n).to_numpy() for n in ("node", "label", "size")}
                which, starts = np.unique(parts[order], return_index=True)
                rows: list[list[bytes]] = []
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), entries.size]):
                    mine, number = np.unique(doc[a:b], return_inverse=True)
                    got = {"entries": entries[a:b], "places": place[a:b], "docs": number, **{n: x[mine] for n, x in of.items()}, "maps": np.concatenate([maps[k] for k in mine.tolist()])}
                    rows.append([got[n].astype(kind).tobytes() for n, kind in _PACKED.items()])
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["part", *_PACKED])

    return deal


class _Maps:
    """The bit maps of all documents of a task, by their width."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        widths = np.array([map_words(n) for n in range(int(sizes.max()) + 1)] if sizes.max() < 1 << 16 else [0])
        self.width = widths[sizes] if widths.size > 1 else np.array([map_words(n) for n in sizes.tolist()])
        self.size = sizes
        starts = np.cumsum(self.width) - self.width
        self.row = np.zeros(sizes.size, np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            some = np.flatnonzero(self.width == w)
            self.row[some] = np.arange(some.size)
            self.of[w] = flat[starts[some][:, None] + np.arange(w)]

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where the documents a[k] and b[k] can't be similar by their maps."""
        out = np.ones(a.size, bool)
        both = self.width[a] * (MAP + 1) + self.width[b]
        for pair in np.unique(both).tolist():
            some = np.flatnonzero(both == pair)
            v, w = divmod(pair, MAP + 1)
            x, y = folded(self.of[v][self.row[a[some]]], min(v, w)), folded(self.of[w][self.row[b[some]]], min(v, w))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            out[some] = 9 * apart <= self.size[a[some]] + self.size[b[some]]
        return out


@giving_back
def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs a < b of nodes of different labels whose prefixes share an entry at places that leave enough entries to be similar, and whose bit maps don't rule it out.

    Sets of m and n entries are similar if they share (m + n) * 4 / 9 or more. Of their common entries the first in order has all others behind it
    in both, so its place is at most the size less that number in either set. What meets in many places is looked at here, and only what may be
    similar leaves the task.
    """
    blocks = [batch for batch in batches if batch.num_rows]
    if not blocks:
        return
    read = lambda n: [np.frombuffer(x.as_buffer(), _PACKED[n]) for batch in blocks for x in batch.column(n)]
    before = np.cumsum([0, *(x.size for x in read("nodes"))])
    docs = np.concatenate([x + n for x, n in zip(read("docs"), before.tolist())])
    entries, places, nodes, labels, sizes, maps = (np.concatenate(read(n)) for n in ("entries", "places", "nodes", "labels", "sizes", "maps"))
    del blocks
    order = np.lexsort((labels[docs], entries))
    entries, places, docs = entries[order], places[order], docs[order]
    sizes, label = sizes.astype(np.int64), labels[docs]
    known = _Maps(sizes, maps)

    def ends(new: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(new)
        return np.repeat(np.append(starts[1:], new.size), np.diff(np.append(starts, new.size)))

    group = np.append(True, entries[1:] != entries[:-1])
    after = ends(group | np.append(True, label[1:] != label[:-1]))
    others = ends(group) - after
    del entries, label, order
    rows = np.flatnonzero(others)
    upto = np.cumsum(others[rows])
    at = 0
    while at < rows.size:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOOK, "right")))
        some = rows[at:to]
        a = np.repeat(some, others[some])
        b = np.arange(a.size) - np.repeat(np.cumsum(others[some]) - others[some], others[some]) + after[a]
        x, y = docs[a], docs[b]
        share = -(-4 * (sizes[x] + sizes[y]) // 9)
        near = (places[a] <= sizes[x] - share) & (places[b] <= sizes[y] - share)
        x, y = x[near], y[near]
        near = known.possible(x, y)
        x, y = nodes[x[near]], nodes[y[near]]
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        at = to


@giving_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            sets = [np.unique(shingle_hashes(x.as_py(), COPY_WORDS)).tobytes() for x in some.column("_text")]
            yield pa.RecordBatch.from_arrays([some.column("node"), pa.array(sets, pa.binary())], ["node", "entries"])


@giving_back
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets have the similarity."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
            both = np.intersect1d(x, y, assume_unique=True).size
            keep.append(both >= SIMILAR * (x.size + y.size - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column("_text")), np.uint64, batch.num_rows)
        names = [n for n in batch.schema.names if n != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found.view(np.int64))], [*names, "fp"])


def _near(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int) -> Forest:
    """Joins every two fingerprints of left and right (None: of left alone) within radius; left's come first.

    Both are sorted by the population counts of their halves and quarters. Two tiles are skipped if the ranges of these counts alone
    already differ by more than radius; others are compared whole, by exclusive or and bit counts.
    """
    def tiles(x: np.ndarray, base: int):
        counts = np.bitwise_count(x[:, None].view(np.uint16).reshape(-1, 4)).astype(np.int16)
        order = np.lexsort((counts[:, 2], counts[:, 0], counts[:, 0] + counts[:, 1]))
        x, counts = x[order], counts[order]
        return [(x[i : i + tile], base + order[i : i + tile], counts[i : i + tile].min(0), counts[i : i + tile].max(0), *(lambda h: (h.min(), h.max()))(counts[i : i + tile, :2].sum(1)), *(lambda h: (h.min(), h.max()))(counts[i : i + tile, 2:].sum(1))) for i in range(0, x.size, tile)]

    one = tiles(left, 0)
    two = one if right is None else tiles(right, left.size)
    forest = Forest(left.size + (0 if right is None else right.size))
    low, high = np.array([t[2] for t in two]), np.array([t[3] for t in two])
    half = np.array([t[4:] for t in two])
    for k, (x, ids, least, most, l0, l1, r0, r1) in enumerate(one):
        quarters = np.maximum(0, np.maximum(low - most, least - high)).sum(1)
        halves = np.maximum(0, np.maximum(half[:, 0] - l1, l0 - half[:, 1])) + np.maximum(0, np.maximum(half[:, 2] - r1, r0 - half[:, 3]))
        for j in np.flatnonzero(np.maximum(quarters, halves) <= radius).tolist():
            if right is None and j < k:
                continue
            a, b = np.nonzero(np.bitwise_count(x[:, None] ^ two[j][0][None, :]) <= radius)
            if a.size > (x.size if right is None and j == k else 0):  # a tile always meets itself
                forest.join(ids[a], two[j][1][b])
    return forest


def _compare(radius: int, tile: int):
    def pair(table: pa.Table) -> pa.Table:
        """Both groups of one pair of population counts; edges that join what is near."""
        side = np.repeat(table.column("side").to_numpy(), pc.list_value_length(table.column("fps")).to_numpy())
        fps = pc.list_flatten(table.column("fps")).to_numpy().view(np.uint64)
        left, right = fps[side == 0], fps[side == 1]
        forest = _near(left, right if table.column("two")[0].as_py() else None, radius, tile)
        a, b = forest.edges()
        every = np.concatenate((left, right)).view(np.int64)
        return pa.table({"a": every[a], "b": every[b]})

    return pair


def _pairs(left: np.ndarray, right: np.ndarray | None, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sketches (rows: a number and four words), pairs to verify: places in left and right, left's first.

    Tiles, sorted by population count, are skipped if their counts differ by more than FIRST; others are compared whole by their first words, and
    what is within FIRST by all. Pairs up to SURE are taken to be near, so of these as many are kept as join what they join; of the
    others up to REACH as many as join the rest. Closer pairs come first. So no group, however large, gives more pairs than twice its members.
    """
    def tiles(x: np.ndarray, base: int):
        p = np.bitwise_count(x[:, 1])
        order = np.argsort(p, kind="stable")
        return [(x[some, 1:], base + some, int(p[some[0]]), int(p[some[-1]])) for some in (order[i : i + tile] for i in range(0, order.size, tile))]

    one = tiles(left, 0)
    two = one if right is None else tiles(right, left.shape[0])
    n = left.shape[0] + (0 if right is None else right.shape[0])
    near, reached = Forest(n), Forest(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (x, ids, least, most) in enumerate(one):
        for j in range(k if right is None else 0, len(two)):
            y, others, low, high = two[j]
            if max(low - most, least - high) > FIRST:
                continue
            d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            a, b = np.nonzero(d <= FIRST)
            if right is None and j == k:
                a, b = a[a < b], b[a < b]
            if not a.size:
                continue
            far = d[a, b].astype(np.int64)
            for w in range(1, 4):
                far += np.bitwise_count(x[a, w] ^ y[b, w])
            order = np.argsort(far, kind="stable")
            order = order[: np.searchsorted(far[order], REACH, "right")]
            a, b, sure = ids[a[order]], others[b[order]], int(np.searchsorted(far[order], SURE, "right"))
            used = near.spanning(a[:sure], b[:sure])
            out.append((a[used], b[used]))
            reached.join(a[:sure], b[:sure])
            used = sure + reached.spanning(a[sure:], b[sure:])
            out.append((a[used], b[used]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = map(np.concatenate, zip(*out))
    return a, b


def _compare_sketches(tile: int):
    def pair(table: pa.Table) -> pa.Table:
        side = np.repeat(table.column("side").to_numpy(), pc.list_value_length(table.column("fps")).to_numpy())
        flat = pc.list_flatten(table.column("fps")).combine_chunks()
        rows = np.stack([flat.field(n).to_numpy().view(np.uint64) for n in ("node", "fp", "f1", "f2", "f3")], 1)
        left, right = rows[side == 0], rows[side == 1]
        a, b = _pairs(left, right if table.column("two")[0].as_py() else None, tile)
        every = np.concatenate((left[:, 0], right[:, 0])).view(np.int64)
        give_back()
        return pa.table({"a": every[a], "b": every[b]})

    return pair


def near_edges(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, part: int = PART, compare=None) -> DataFrame:
    """distinct: fp (long, all different). Edges a, b between fingerprints, with the same components as all pairs within radius.
    compare: what is done with two parts instead; it gets all columns of distinct.

    The fingerprints of a population count form a group, cut by hash into parts of about `part`, and only parts whose counts differ by
    radius at most meet, each two in a task that holds both (1 MB), as packed blocks. Which parts meet is a join of the table of parts
    with itself on the population count. A task returns a forest, not its pairs.
    """
    spark = distinct.sparkSession
    counted = distinct.select("*", F.bit_count("fp").alias("p"))
    item = F.col("fp") if compare is None else F.struct(*distinct.columns)
    sizes = dict(counted.groupBy("p").count().collect())  # 65 rows at most
    if not sizes:
        return spark.createDataFrame([], "a long, b long")
    ways = [max(1, -(-sizes.get(p, 0) // part)) for p in range(65)]
    blocks_of = [max(1, -(-sizes.get(p, 0) // ways[p] // BLOCK)) for p in range(65)]
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("p") + 1)
    own = F.xxhash64(*distinct.columns), F.xxhash64(*distinct.columns, F.lit(1))
    dealt = counted.select(item.alias("_x"), "p", F.pmod(own[0], of(ways)).cast("int").alias("c"), F.pmod(own[1], of(blocks_of)).cast("int").alias("_b"))
    blocks = dealt.groupBy("p", "c", "_b").agg(F.collect_list("_x").alias("fps"))
    parts = spark.createDataFrame([(p, ways[p]) for p in sizes], "p int, n int").select("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    reach = parts.select("p", "c", F.explode(F.sequence("p", F.least(F.col("p") + radius, F.lit(64)))).alias("q"))
    meet = reach.join(parts.select(F.col("p").alias("q"), F.col("c").alias("d")), "q").filter("p < q or c <= d")
    two = ((F.col("p") < F.col("q")) | (F.col("c") < F.col("d"))).alias("two")
    left = blocks.join(meet, ["p", "c"]).select("p", "c", "q", "d", F.lit(0).alias("side"), two, "fps")
    others = blocks.select(F.col("p").alias("q"), F.col("c").alias("d"), "fps")
    right = others.join(meet.filter(two), ["q", "d"]).select("p", "c", "q", "d", F.lit(1).alias("side"), F.lit(True).alias("two"), "fps")
    work = sum(sizes[p] * sizes.get(q, 0) // (2 if p == q else 1) for p in sizes for q in range(p, p + radius + 1))
    tasks = max(shuffle_partitions(spark), -(-work // TASK_PAIRS))
    return left.union(right).repartition(tasks, "p", "c", "q", "d").groupBy("p", "c", "q", "d").applyInArrow(compare or _compare(radius, tile), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, extra: dict | None = None) -> DataFrame:
    """A row per row of docs: <id_col>, fingerprint (16 hex digits), component_id (smallest id reachable over links), and extra columns.

    Fingerprints within radius bits link. A null text is empty; empty texts have fingerprint 0, which links like any other. Nodes
    are fingerprints, so copies and repeated rows cost nothing; rows with a null id take part, and component_id is null where
    no row of the component has an id. An empty table gives no rows. Comparison is exact, so its time grows with the square of the
    distinct fingerprints, less the skipped tiles (see README).
    """
    rows = docs.select(docs[id_col].alias("id"), *[c.alias(k) for k, c in (extra or {}).items()], text_of(docs, text_col).cast("binary").alias("_text"))
    schema = "id " + dict(rows.dtypes)["id"] + "".join(f", {k} {kind}" for k, kind in rows.dtypes if k not in ("id", "_text")) + ", fp long"
    prints = frozen(rows.mapInArrow(_fingerprints, schema), "fingerprints")
    nodes = frozen(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = components(near_edges(nodes.select("fp"), radius))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("label", "fp").alias("root"), "least")
    rooted = frozen(rooted, "rooted")
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = frozen(rooted.join(roots, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(extra or {}))


def _linked(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs a, b of nodes whose sets have the similarity."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = frozen(nodes.join(asked, "node").select("node", F.col("_at").alias("_key")), "asked")
    # A key that two texts share gives a node two sets; the pair is then verified on either.
    sets = frozen(rows.select("_key", "_text").join(wanted, "_key").dropDuplicates(["node", "_key"]).mapInArrow(_sets, "node long, entries binary"), "sets")
    of = lambda name, side: sets.select(F.col("node").alias(side), F.col("entries").alias(name))
    checked = frozen(pairs.join(of("x", "a"), "a").join(of("y", "b"), "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long"), "verified")
    released(wanted, sets)
    return checked


def _meetings(prints: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs a, b of nodes that found (node, label) has not joined: all that are similar, and some that aren't.

    Pairs that share an entry of their prefixes are many and sets are long, so bit maps rule most out: small ones in the task where prefixes meet, so that of a
    group of many alike texts only what may be similar leaves it, then whole ones, a sixteenth to a thirty-second of the sets.
    """
    spark = prints.sparkSession
    sets = prints.filter("size > 0").select("node", "size", "prefix", "parity").dropDuplicates(["node"])
    total = prints.agg(F.sum(F.expr("size div 5 + 1"))).first()[0] or 0
    ways = max(shuffle_partitions(spark), -(-total // SHARE))
    labelled = sets.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "size", "prefix", "parity")
    dealt = labelled.mapInArrow(_dealt(ways), "part int, " + ", ".join(f"{n} binary" for n in _PACKED))
    pairs = frozen(dealt.repartition(ways, "part").mapInArrow(_meeting, "a long, b long").distinct(), "meetings")
    maps = prints.select("node", "size", "parity").dropDuplicates(["node"])
    of = lambda size, name, side: maps.select(F.col("node").alias(side), F.col("size").alias(size), F.col("parity").alias(name))
    possible = frozen(pairs.join(of("m", "x", "a"), "a").join(of("n", "y", "b"), "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_possible, "a long, b long"), "possible")
    released(pairs)
    return possible


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None, tile: int = TILE, part: int = PART) -> DataFrame:
    """A row per row of docs: <id_col>, label (equal for near copies), and extra columns.

    Documents are near copies if their sets of five-word shingles (words and case as for fingerprints) have a Jaccard similarity of 0.8 or
    more, directly or over others. First, sketches of 256 bits are compared in tiles like fingerprints, and pairs that this proposes are
    verified on the sets; that joins most, and large groups by few pairs, but misses some. Then sets that aren't in one class yet meet
    wherever they share one of the fifth of their shingles that comes first in an order of all shingles, rare ones first; sets that
    are similar always do. Of these pairs all are verified that bit maps of the sets don't rule out, so no link is missed, whatever the
    length of the texts. Documents with equal sets are one from the start. Texts without words are equal.
    """
    rows = docs.select(docs[id_col].alias("id"), *[c.alias(k) for k, c in (extra or {}).items()], text_of(docs, text_col).cast("binary").alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("id", "_text"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("id", *(extra or {}), "_key")) + ", node long, check long, fp long, f1 long, f2 long, f3 long, size int, prefix binary, parity binary"
    words = ("fp", "f1", "f2", "f3")
    with batch_bytes(docs.sparkSession, BATCH):
        prints = frozen(rows.mapInArrow(_sketches(*_common(rows)), schema), "sketches")
        nodes = frozen(prints.groupBy("node").agg(F.min("check").alias("least"), F.min("_key").alias("_at"), *[F.min(w).alias(w) for w in words]), "nodes")
        pairs = frozen(near_edges(nodes.select("node", *words), FIRST, tile, part, _compare_sketches(tile)).filter("a <> b").distinct(), "proposed")
        first = _linked(pairs, rows, nodes)
        released(pairs)
        rest = _meetings(prints, components(first))
        second = _linked(rest, rows, nodes)
        released(rest)
        found = components(first.union(second))
        released(first, second)
    classes = frozen(nodes.join(found, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "classes")
    # Where only half of a set's hash is another's, the document is a class of its own.
    label = F.when(F.col("check") == F.col("least"), F.col("label")).otherwise(F.xxhash64("node", "check"))
    return prints.join(classes, "node").select(F.col("id").alias(id_col), label.alias("label"), *(extra or {}))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of near_copies(), that with the smallest id (null last; then the smaller hash of the text); the same columns.

    Null texts are empty; of empty texts one stays, as of repeated rows. An empty table stays one.
    """
    text = text_of(docs, text_col)
    keys = {"_h": F.xxhash64(text), "_l": F.octet_length(text)}
    rows = frozen(near_copies(docs, id_col, text_col, keys), "near")
    first = F.min(F.struct(F.isnull(id_col).alias("no_id"), F.col(id_col).alias("id"), "_h", "_l")).alias("_first")
    kept = rows.groupBy("label").agg(first).select(F.col("_first.id").alias(id_col), "_first._h", "_first._l")
    repeated = not rows.groupBy(id_col, "_h", "_l").count().filter("count > 1").isEmpty()
    return keep_rows(docs, {id_col: docs[id_col], **keys}, kept, repeated)


def op4_simhash(spark, sf_dir):
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
