"""Removal of long repeated byte strings: anchors bring equal strings together, grouped suffix sorting tells them apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import frozen, ranked, released, shuffle_partitions, text_of
from halyard.llm.suffix_sort import suffix_array

#: Bytes of a string whose later occurrences go, and of the anchors looked for inside it.
LENGTH, ANCHOR = 100, 32
#: Window starts that are hashed at once (positions have POS_BITS bits), segments of one task, bytes sorted at once, segments under one key beyond which it is split.
SLICE, POS_BITS, TASK_ROWS, SORT_BYTES, HOT = 1 << 16, 17, 750_000, 1 << 14, 512
#: Windows of a hot segment whose common bytes become the new key, step by step.
SPANS = (23, 8, 3, 1)
#: The same for all other shared segments, inside a task.
NARROW = (23, 8)

_random = np.random.default_rng(20240229)
_TABLE = _random.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Primes, bases and tables of the polynomials that tell segments apart; they share nothing with the one that finds anchors.
_PRIMES = (2**31 - 1, 2**31 - 19)
_BASES = [int(_random.integers(2**20, q)) for q in _PRIMES]
_TABLES = [_random.integers(1, q, 256, np.uint64) for q in _PRIMES]
_RESIDUES: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _residues(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, the first n powers of its base and of the base's inverse."""
    if n not in _RESIDUES:
        _RESIDUES.clear()

        def powers(base: int, prime: int) -> np.ndarray:
            out = np.ones(n, np.uint64)
            have = 1
            while have < n:  # what is known, times the power that comes next
                more = min(have, n - have)
                out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
                have += more
            return out

        _RESIDUES[n] = [(powers(b, q), powers(pow(b, -1, q), q)) for b, q in zip(_BASES, _PRIMES)]
    return _RESIDUES[n]


def _fingerprints(data: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    """62 bits for each stretch of data from begin[k] to end[k]: polynomials modulo two primes. limit: data.size at most."""
    out = np.zeros(begin.size, np.uint64)
    for table, prime, (up, down) in zip(_TABLES, _PRIMES, _residues(limit)):
        q = np.uint64(prime)
        sums = np.zeros(data.size + 1, np.uint64)
        np.cumsum(table[data] * up[: data.size] % q, out=sums[1:])  # under 2**48
        out = (out << np.uint64(31)) | (sums[end] - sums[begin]) % q * down[begin] % q
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        _POWERS.clear()
        one = np.ones(n, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = _BASE, _INVERSE
        _POWERS[n] = np.cumprod(up), np.cumprod(down)
    return _POWERS[n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def segments(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Cuts the windows of `length` bytes of texts that lie end to end in data (starts: of each, and the end) into segments.

    A window's anchor is its string of `anchor` bytes with the smallest hash (the leftmost on ties); a segment is a run of windows of a text
    with one anchor. Equal windows have equal anchors at equal places, so they lie in segments of one key. Returns arrays: key (hash
    of the anchor), sid (hash of the segment's bytes and of the anchor's place), text (its index), first window, windows, anchor's
    place from the first window. The two hashes are polynomials over unrelated rings with unrelated tables.
    """
    width = length - anchor + 1
    out: list[tuple] = []
    total = int(starts[-1]) - length + 1
    for a in range(0, max(0, total), SLICE):
        b = min(a + SLICE, total)
        x = _TABLE[data[a : b + length - 1]]
        up, down = _powers(SLICE + length)
        sums = np.zeros(x.size + 1, np.uint64)
        np.cumsum(x * up[: x.size], out=sums[1:])
        h = _mixed((sums[anchor:] - sums[:-anchor]) * down[: x.size - anchor + 1])
        low = np.uint64((1 << POS_BITS) - 1)
        least = (h & ~low) | np.arange(h.size, dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: step - width], least[width - step :])
        at = (least & low).astype(np.int64)
        valid = np.ones(b - a, bool)
        k = np.searchsorted(starts, a, "right")
        for e in starts[k : np.searchsorted(starts, b + length, "right")].tolist():
            valid[max(0, e - length + 1 - a) : max(0, e - a)] = False
        good = np.flatnonzero(valid)
        if not good.size:
            continue
        new = np.ones(good.size, bool)
        new[1:] = (np.diff(good) != 1) | (at[good[1:]] != at[good[:-1]])
        heads = np.flatnonzero(new)
        first, count = good[heads], np.diff(np.append(heads, good.size))
        place = at[first]
        body = _fingerprints(data[a : b + length - 1], first, first + count + length - 1, SLICE + length)
        sid = _mixed(body + np.uint64(0x51ED27) * (count.astype(np.uint64) * np.uint64(256) + (place - first).astype(np.uint64)))
        text = np.searchsorted(starts, first + a, "right") - 1
        out.append((h[place], sid, text, first + a - starts[text], count, place - first))
    if not out:
        return tuple(np.zeros(0, np.uint64 if k < 2 else np.int64) for k in range(6))
    return tuple(map(np.concatenate, zip(*out)))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each begins, and the end."""
    wide = column.cast(pa.large_binary())
    starts = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None and wide.buffers()[2].size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def _packed(first, count, place):
    return (first << 14) | (count << 7) | place


def _unpacked(at):
    return at >> 14, at >> 7 & 127, at & 127


ROW = "key long, sid long, rid long, at long, bucket long, status int"
#: Of a row that goes on: to be compared; known to be a repeat; one of several different segments with its key.
OPEN, REPEAT, MANY = 0, 1, 2


def _batch(columns, more: dict | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("key", "sid", "rid", "at", "bucket", "status"), columns)) | (more or {}))


def _first_of_each(key, sid, rid, at) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, sid, rid and place; in it, which rows repeat the key and sid of an earlier one at another place."""
    order = np.lexsort((at, rid, sid, key))
    same = np.zeros(order.size, bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (sid[order[1:]] == sid[order[:-1]])
    return order, same


def _emit(key, sid, rid, at, bytes_=None) -> pa.RecordBatch:
    """One task's segments, of which those that repeat another of the same task are already known as repeats and dealt by document, not key."""
    order, same = _first_of_each(key, sid, rid, at)
    key, sid, rid, at = key[order], sid[order], rid[order], at[order]
    status = np.where(same, REPEAT, OPEN).astype(np.int32)
    bucket = np.where(same, _mixed(rid.astype(np.uint64) ^ at.astype(np.uint64)).view(np.int64), key)
    more = {} if bytes_ is None else {"seg": pa.array([None if s else bytes_[i] for i, s in zip(order.tolist(), same.tolist())], pa.binary())}
    return _batch((key, sid, rid, at, bucket, status), more)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts = _bytes_of(batch.column("text"))
        key, sid, text, first, count, place = segments(data, starts)
        if key.size:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)[text]
            yield _emit(key.view(np.int64), sid.view(np.int64), rid, _packed(first, count, place))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, dealt by bucket. Unique keys go; repeats of an equal segment are known; different segments with one key stay MANY."""
    got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if got is None or not got.num_rows:
        return
    key, sid, rid, at, _, status = (got.column(k).to_numpy() for k in range(6))
    known = np.flatnonzero(status == REPEAT)
    rows = np.flatnonzero(status == OPEN)
    order, same = _first_of_each(key[rows], sid[rows], rid[rows], at[rows])
    order = rows[order]
    firsts = order[~same]
    again = order[same]
    if again.size:  # a row that occurs twice doesn't repeat itself
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(order.size)))][same]
        again = again[(rid[again] != rid[lead]) | (at[again] != at[lead])]
    shared = np.zeros(firsts.size, bool)
    if firsts.size > 1:
        equal = key[firsts[1:]] == key[firsts[:-1]]
        shared[1:] |= equal
        shared[:-1] |= equal
    many = firsts[shared]
    take = np.concatenate((known, again, many))
    status = np.concatenate((np.full(known.size + again.size, REPEAT), np.full(many.size, MANY))).astype(np.int32)
    more = {"seg": got.column("seg").take(pa.array(take)).combine_chunks()} if "seg" in got.column_names else {}
    for k in range(0, take.size, 50_000):
        part = take[k : k + 50_000]
        yield _batch((key[part], sid[part], rid[part], at[part], key[part], status[k : k + 50_000]), {n: c.slice(k, 50_000) for n, c in more.items()})


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of a document's MANY segments."""
    for batch in batches:
        keys, rids, ats, segs = [], [], [], []
        for rid, text, wanted in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist()):
            text = text.as_py()
            for w in wanted:
                first, count, _ = _unpacked(w["at"])
                keys.append(w["key"])
                rids.append(rid)
                ats.append(w["at"])
                segs.append(text[first : first + count + LENGTH - 1])
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "rid": pa.array(rids, pa.int64()), "at": pa.array(ats, pa.int64()), "seg": pa.array(segs, pa.binary())})


def repeats(rids: list[int], firsts: list[int], segs: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """(rid, start) of the windows of segs that also begin at a smaller (rid, start) in segs, by one suffix array over all of them."""
    joined, where = [], []
    for k, seg in enumerate(segs):
        where += [k] * (len(seg) + 1)
        joined += [b + 2 for b in seg]
        joined.append(1)
    joined.append(0)
    begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in segs])))
    order = np.array(suffix_array(joined)[1:])
    owner = np.array(where)[order]
    offset = order - begin[owner]
    fits = offset <= np.array([len(x) for x in segs])[owner] - length
    order, owner, offset = order[fits], owner[fits], offset[fits]
    flat = np.array(joined, np.int16)
    equal = np.zeros(order.size, bool)
    for k in range(1, order.size, 4096):
        a, b = order[k - 1 : k + 4095], order[k : k + 4096]
        span = np.arange(length)
        equal[k : k + 4096] = (flat[a[: b.size, None] + span] == flat[b[:, None] + span]).all(1)
    run = np.cumsum(~equal)
    rid, start = np.array(rids)[owner], np.array(firsts)[owner] + offset
    by = np.lexsort((start, rid, run))
    later = np.zeros(by.size, bool)
    later[1:] = run[by[1:]] == run[by[:-1]]
    lead = by[np.maximum.accumulate(np.where(later, 0, np.arange(by.size)))] if by.size else by
    later &= (rid[by] != rid[lead]) | (start[by] != start[lead])
    return list(zip(rid[by][later].tolist(), start[by][later].tolist()))


def _classes(seg: bytes, count: int, place: int, span: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Runs of a segment's windows whose anchor's place is in one class of span places: kind, first window, windows, the bytes that all windows of the class hold."""
    k = 0
    while k < count:
        kind = (place - k) // span
        n = min(count - k, place - k - kind * span + 1)
        yield kind, k, n, seg[max(0, place - kind * span) : place + LENGTH - (kind + 1) * span + 1]
        k += n


def _narrowed(rows: list[tuple[int, int, int, int, bytes]], span: int) -> tuple[list[list], list[tuple[int, int, int]]]:
    """rows (rid, first, windows, anchor's place, bytes) of one key: what must still be compared, in groups that share the bytes of a class; and
    the repeats (rid, first, windows) known on the way, runs of windows whose bytes equal an earlier run's."""
    groups: dict[tuple[int, bytes], dict] = {}
    known = []
    for rid, first, count, place, seg in rows:
        for kind, k, n, common in _classes(seg, count, place, span):
            own = (place - k, seg[k : k + n + LENGTH - 1])
            group = groups.setdefault((kind, common), {})
            old = group.get(own)
            if old is None:
                group[own] = (rid, first + k, n)
            elif old[:2] != (rid, first + k):
                new = (rid, first + k, n)
                known.append(max(old, new))
                group[own] = min(old, new)
    return [[(rid, first, n, place, seg) for (place, seg), (rid, first, n) in g.items()] for g in groups.values() if len(g) > 1], known


def _found(rid: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    new = np.ones(rid.size, bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, rid.size))
    if count.max(initial=0) > 127:  # counts have 7 bits
        heads, count = np.arange(rid.size), np.ones(rid.size, np.int64)
    return pa.RecordBatch.from_pydict({"rid": rid[heads], "at": _packed(start[heads], count, 0 * count)})


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition, dealt by key. Of each key, classes of windows that share no bytes with others go; the rest is sorted, SORT_BYTES at a time."""
    got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if got is None or not got.num_rows:
        return
    got = got.sort_by("key")
    key = got.column("key").to_numpy()
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, key.size)
    waiting, size, begin = [], 0, 0
    for end in ends.tolist():
        part = got.slice(begin, end - begin)
        rows = [(rid, *_unpacked(at), seg) for rid, at, seg in zip(*(part.column(n).to_pylist() for n in ("rid", "at", "seg")))]
        begin = end
        groups, known = [rows], []
        for span in NARROW:
            narrowed = [_narrowed(g, span) for g in groups]
            groups = [g for more, _ in narrowed for g in more]
            known += [x for _, more in narrowed for x in more]
        if known:
            rid, first, n = map(np.array, zip(*known))
            yield pa.RecordBatch.from_pydict({"rid": rid, "at": _packed(first, n, 0 * n)})
        for g in groups:
            waiting += g
            size += sum(len(x[4]) for x in g)
        if waiting and (size >= SORT_BYTES or end == key.size):
            if found := repeats([x[0] for x in waiting], [x[1] for x in waiting], [x[4] for x in waiting]):
                yield _found(*map(np.array, zip(*found)))
            waiting, size = [], 0


def _split(span: int):
    """Hot segments cut into runs of windows whose anchor's place is in one class; the bytes that a class has in common are the new key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sids, rids, ats, segs = [], [], [], [], []
            for key, rid, at, seg in zip(*(batch.column(n).to_pylist() for n in ("key", "rid", "at", "seg"))):
                first, count, place = _unpacked(at)
                for kind, k, n, common in _classes(seg, count, place, span):
                    own = seg[k : k + n + LENGTH - 1]
                    keys.append(_hash(b"%d:%d:" % (key, kind) + common))
                    sids.append(_hash(b"%d:" % (place - k) + own))
                    rids.append(rid)
                    ats.append(int(_packed(first + k, n, place - k)))
                    segs.append(own)
            if keys:
                yield _emit(*(np.array(x, np.int64) for x in (keys, sids, rids, ats)), segs)

    return run


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
            text = text.as_py()
            spans: list[list[int]] = []
            for at in sorted(found or ()):
                a, count, _ = _unpacked(at)
                b = a + count + LENGTH - 1
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, p = [], 0
            for a, b in spans:
                kept.append(text[p:a])
                p = b
            kept.append(text[p:])
            kept = b"".join(kept)
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out)) if out else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        own = [n for n in batch.schema.names if n not in ("text", "found")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in own), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*own, *names])


def repeated_windows(texts: DataFrame) -> DataFrame:
    """texts: rid (long, unique), text (binary). Rows rid, at (packed first window and number of windows) that together are all windows of
    LENGTH bytes whose bytes also begin earlier: in a smaller rid, or before in the same text.
    cut_repeats() makes null texts empty before; texts shorter than LENGTH have no windows and no rows; of equal texts all but that of the smallest rid are found whole;
    an empty table gives no rows.
    """
    spark = texts.sparkSession
    n = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-n // 35 // TASK_ROWS))
    rows = texts.mapInArrow(_anchored, ROW).repartition(parts, "bucket").mapInArrow(_compared, ROW)
    status = frozen(rows.select("key", "rid", "at", "status"), "segments")
    wanted = status.filter(f"status = {MANY}").groupBy("rid").agg(F.collect_list(F.struct("key", "at")).alias("wanted"))
    asked = texts.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "wanted")
    many = frozen(asked.mapInArrow(_fetched, "key long, rid long, at long, seg binary"), "different")
    found = status.filter(f"status = {REPEAT}").select("rid", "at")
    for span in SPANS:
        hot = frozen(many.groupBy("key").count().filter(f"count > {HOT}").select(F.col("key").alias("hot")), "hot")
        if hot.isEmpty():
            break
        # A key under which thousands of different segments lie is split by more of their bytes, until windows are equal or apart.
        split = many.join(hot, many["key"] == hot["hot"], "left_semi").mapInArrow(_split(span), ROW + ", seg binary").repartition(parts, "bucket").mapInArrow(_compared, ROW + ", seg binary")
        split = frozen(split, "split")
        found = found.union(split.filter(f"status = {REPEAT}").select("rid", "at"))
        old = many
        many = frozen(many.join(hot, many["key"] == hot["hot"], "left_anti").union(split.filter(f"status = {MANY}").select("key", "rid", "at", "seg")), "different")
        released(old, hot)
    return found.union(many.repartition(parts, "key").mapInArrow(_sorted, "rid long, at long"))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: <id_col>, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay; UTF-8 may be cut).

    A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document with a smaller id (null last; of documents
    with one id, the smaller text hash first) or before in the same. All are judged on the input. Rows with equal id and text are one
    document and get the same result. Null texts are empty; an empty table gives no rows.

    One shuffle brings segments with the same anchor together (32 bytes a segment of about 35 bytes of text; repeats inside a task
    are settled for each Arrow batch, so a passage in a third of all documents brings a row per 10,000 of them). Only segments whose key others share are
    compared by their bytes. A key with more than HOT different segments is split by further bytes. Texts are shuffled twice, to
    fetch those segments and to cut.
    """
    own = docs.select(F.monotonically_increasing_id().alias("_row"), docs[id_col].alias("_id"), text_of(docs, text_col).cast("binary").alias("text"))
    plain = dict(own.dtypes)["_id"] in ("tinyint", "smallint", "int", "bigint")
    every, known, different = docs.agg(F.count(F.lit(1)), F.count(id_col), F.count_distinct(id_col)).first()
    if plain and every == known == different:
        texts = own.select(F.col("_id").cast("long").alias("rid"), "text")
    else:  # ids aren't numbers, or are null or repeated: documents get numbers in their order
        name = ["_id", "_h", "_l"]
        own = own.select("_id", "text", F.xxhash64("text").alias("_h"), F.octet_length("text").alias("_l"))
        numbers = ranked(own.select(*name).distinct(), name, "rid").select(*[F.col(n).alias(f"_of{n}") for n in name], "rid")
        numbers = frozen(numbers, "numbers")
        own = own.join(numbers, [own[n].eqNullSafe(numbers[f"_of{n}"]) for n in name]).select("_id", "rid", "text")
        texts = own.select("rid", "text").dropDuplicates(["rid"])
    found = repeated_windows(texts).groupBy("rid").agg(F.collect_list("at").alias("found"))
    rows = own if "rid" in own.columns else own.select("_id", F.col("_id").cast("long").alias("rid"), "text")
    joined = rows.join(found.hint("shuffle_hash"), "rid", "left").select("_id", "text", "found")
    kind = dict(joined.dtypes)["_id"]
    return joined.mapInArrow(_cut, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("_id", id_col)


def op5_suffix_dedup(spark, sf_dir):
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
