"""Packing tokens into sequences by order-preserving dynamic programming."""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import batch_bytes, frozen, give_back, text_of

SIZE, END_ID = 2048, 1
#: Costs in tokens of padding: a cut at a sentence's end, any other cut inside a document.
AT_SENTENCE, ANYWHERE = 16, 96
#: Stretches without a boundary get a cut point after so many ids.
STEP = 128
#: Ids that are planned at once; words that a task remembers (about 150 bytes each), bytes of text that are tokenised at once and that Spark sends at once.
SEGMENT, MEMO_ENTRIES, TEXT_BYTES, BATCH = 1 << 19, 1 << 19, 1 << 20, 4 << 20
PUNCTUATION = ".,;:!?%#$&*"
#: The parts of a tokenizer by which a word of letters is one pre-token, made letter by letter, and nothing is added around it.
PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class _Pieces(dict):
    """What a pre-token has for each letter, by code point, for str.translate(); None where it isn't one piece."""

    def __init__(self, tokenizer) -> None:
        super().__init__({32: " "})
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> str | None:
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(chr(code)) if normalizer else chr(code)
        got = [x for x, _ in cutter.pre_tokenize_str(text)] if cutter else [text]
        self[code] = got[0] if len(got) == 1 else None
        return self[code]


class Encoder:
    """Ids of whole texts. Of the chunks between spaces or line feeds, each distinct word is tokenised once and remembered.

    That is exact for vocabularies whose pre-tokens hold no white space and whose normaliser acts inside a chunk only, like the
    ones this is used with; others take split=False.
    """

    def __init__(self, path: str, split: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores are its tasks' cores
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_file(path), split
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        known = all(parts.get(k) == v for k, v in PARTS.items()) and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
        self.model, self.pieces = self.tokenizer.model, _Pieces(self.tokenizer) if known else None
        self.normalizer, self.cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.apart: dict[str, bool] = {}
        self.forget()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max([*vocabulary.values(), END_ID]) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.removesuffix("</w>").endswith((".", "!", "?"))

    def forget(self) -> None:
        self.cores: dict[str, int] = {"": 0}
        self.starts, self.sizes, self.data = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, "<u4")]
        self.count, self.ids = 1, 0

    def _add(self, texts: list[str], joint: bool) -> None:
        """Tokenises new cores. Joint ones share a call; places in the joined text tell their ids apart."""
        for x in range(0, len(texts), 256 if joint else 1):
            some = texts[x : x + (256 if joint else 1)]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.asarray(got.ids, "<u4")
            if joint:
                begins = np.fromiter((a for a, _ in got.offsets), np.int64, ids.size)
                ends = np.searchsorted(begins, np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1))
            else:
                ends = np.array([ids.size])
            self._keep(some, ids, np.diff(ends, prepend=0))

    def _keep(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of cores, so many of each."""
        if len(texts) != sizes.size:
            raise ValueError(f"{len(texts)} texts, but sizes of {sizes.size}")
        self.starts.append(np.cumsum(sizes) - sizes + self.ids)
        self.sizes.append(sizes)
        self.data.append(ids)
        self.cores.update(zip(texts, range(self.count, self.count + len(texts))))
        self.count, self.ids = self.count + len(texts), self.ids + ids.size

    def _add_words(self, texts: list[str]) -> None:
        """New cores of letters alone. With the parts of PARTS each is one pre-token, made letter by letter, so the model gets it as it is; where a
        letter is no single piece, or with other parts, they go the long way."""
        if self.pieces is None or not texts:
            return self._add(texts, True)
        ids: list[int] = []
        sizes: list[int] = []
        letters = set("".join(texts))
        if any(self.pieces[ord(c)] is None for c in letters):
            odd = {c for c in letters if self.pieces[ord(c)] is None}
            self._add([x for x in texts if not odd.isdisjoint(x)], True)
            texts = [x for x in texts if odd.isdisjoint(x)]
        if texts:
            for piece in " ".join(texts).translate(self.pieces).split(" "):
                found = self.model.tokenize(piece)
                ids += [x.id for x in found]
                sizes.append(len(found))
        self._keep(texts, np.array(ids, "<u4"), np.array(sizes, np.int64))

    def _stands_apart(self, last: str) -> bool:
        """Whether plain punctuation behind this sign is a pre-token of its own, as the tokenizer's parts cut it after normalising: a letter that is
        taken apart there may end with a mark, which goes with the punctuation."""
        if last not in self.apart:
            text = self.normalizer.normalize_str(last + ".") if self.normalizer else last + "."
            got = [x for x, _ in self.cutter.pre_tokenize_str(text)] if self.cutter else [text]
            self.apart[last] = len(got) > 1 and got[-1] == "."
        return self.apart[last]

    def _codes(self, chunks: pa.Array) -> np.ndarray:
        """Of each chunk, the numbers of its core and its tail, a run of plain punctuation behind a letter or digit: a pre-token of its own. Case is lost."""
        cores, new, alone = self.cores, {}, {}
        core = pc.utf8_rtrim(chunks, characters=PUNCTUATION)
        plain = pc.string_is_ascii(core)
        cut = pc.not_equal(core, chunks)
        # A core that ends with other signs would be one pre-token with these.
        signs = pc.and_(cut, pc.match_substring_regex(core, "[^0-9A-Za-z]$"))
        core, cut = pc.if_else(pc.and_(plain, signs), chunks, core), pc.and_not(cut, pc.and_(plain, signs))
        keys = pc.if_else(pc.match_substring(core, "<|"), core, pc.ascii_lower(core)).to_numpy(zero_copy_only=False)
        wholes, tails = np.flatnonzero(~plain.to_numpy(zero_copy_only=False)), cut.to_numpy(zero_copy_only=False)
        odd = chunks.take(pa.array(wholes)).to_numpy(zero_copy_only=False).tolist()
        for k, c in zip(wholes.tolist(), odd):
            key = c.rstrip(PUNCTUATION)
            if not key[-1:].isalnum() or len(key.lower()) != len(key) or not self._stands_apart(key[-1]):
                key, tails[k] = c, False
            keys[k] = key
            # Where case or composition changes lengths, places in a joined text mean nothing.
            if key not in cores and not (key.isalpha() and len(key.lower()) == len(key) and is_normalized("NFC", key)):
                alone[key] = 1
        keys = keys.tolist()
        tailed = np.flatnonzero(tails)
        lengths = pc.utf8_length(core).to_numpy()[tailed].tolist()
        ends = [c[n:] for c, n in zip(chunks.take(pa.array(tailed)).to_numpy(zero_copy_only=False).tolist(), lengths)]
        new = dict.fromkeys(x for y in (keys, ends) for x in y if x not in cores and x not in alone)
        words = [x for x in new if x.isalpha() and "\u03a3" not in x]  # a capital sigma's small letter depends on its place
        self._add_words(words)
        self._add([x for x in new if x not in cores], True)
        self._add(list(alone), False)
        out = np.zeros((len(keys), 2), np.int64)
        out[:, 0] = np.fromiter(map(cores.__getitem__, keys), np.int64, len(keys))
        out[tailed, 1] = np.fromiter(map(cores.__getitem__, ends), np.int64, len(ends))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's end."""
        if not self.split:
            each = [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*each, np.zeros(0, "<u4")]), np.cumsum([x.size for x in each], dtype=np.int64)
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        at = chunks.indices.to_numpy()
        if len(self.cores) > MEMO_ENTRIES:
            self.forget()
        both = self._codes(chunks.dictionary)
        starts, sizes, data = (np.concatenate(x) for x in (self.starts, self.sizes, self.data))
        self.starts, self.sizes, self.data = [starts], [sizes], [data]
        flat = data[_spread(starts[both.ravel()], sizes[both.ravel()])]
        size = sizes[both].sum(1)
        count = size[at]
        ids = flat[_spread((np.cumsum(size) - size)[at], count)]
        last = np.cumsum(pc.list_value_length(split).to_numpy())  # every text has a chunk, an empty one at least
        return ids, np.cumsum(count)[last - 1]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] numbers, then those of the next."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - (ends - counts), counts)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, split: bool) -> Encoder:
    """One for all tasks of a Python worker."""
    if (path, split) not in _encoders:
        _encoders[path, split] = Encoder(path, split)
    return _encoders[path, split]


def cut_points(ids: np.ndarray, bounds: np.ndarray, ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end, from 0 to ids.size, and what a cut there costs. bounds: ends of documents."""
    sentences = np.flatnonzero(ends[ids]) + 1
    at = np.unique(np.concatenate(([0], sentences, bounds)))
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > step)
    if wide.size:
        at = np.unique(np.concatenate([at, *(np.arange(at[k] + step, at[k + 1], step) for k in wide.tolist())]))
    cost = np.full(at.size, ANYWHERE)
    cost[np.isin(at, sentences, assume_unique=False)] = AT_SENTENCE
    cost[np.isin(at, bounds)] = 0
    cost[0] = 0
    return at, cost


def _tails(size: int) -> list[tuple[int, int]]:
    """By the number of ids left at the very end: the least cost, and the length of its first sequence. Powers of two aren't padded."""
    best = [(0, 0)]
    for n in range(1, size + 1):
        power = 1 << (n.bit_length() - 1)
        whole = 0 if n == power else size - n
        split = best[n - power][0] + ANYWHERE if n != power else whole
        best.append((whole, n) if whole <= split else (split, power))
    return best


def windows(at: np.ndarray, cost: np.ndarray, last: bool, size: int = SIZE) -> list[int]:
    """Ends of the windows of a plan with the least padding plus cut costs, in order.

    A window covers the ids between two cut points, size at most; ended at j it pays size - (at[j] - at[i]) and cost[j], so the best i has
    the least total[i] + at[i] among the points in reach. A queue of points with rising values gives it in constant time. If last is
    false, the ids behind the last end stay for the next segment; else they form the tail, which may be split at powers of two.
    """
    where, price = at.tolist(), cost.tolist()
    total, value, back, queue = [0] * len(where), [0] * len(where), [0] * len(where), deque([0])
    for j in range(1, len(where)):
        p = where[j]
        while where[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        back[j], total[j] = i, size - p + price[j] + value[i]
        value[j] = v = total[j] + p
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    reach = range(int(np.searchsorted(at, where[-1] - size)), len(where))
    tails = _tails(size) if last else None
    j = min(reach, key=lambda i: (total[i] + (tails[where[-1] - where[i]][0] if last else 0), -i if last else i))
    out, k = [], j
    while k:
        out.append(where[k])
        k = back[k]
    out.reverse()
    if last:
        p = where[j]
        while p < where[-1]:
            p += tails[where[-1] - p][1]
            out.append(p)
    return out


def _packer(path: str, size: int, split: bool, id_type: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(path, split)
        try:
            yield from packed(batches, own_encoder, TaskContext.get().partitionId() << 33)
        finally:  # the encoder waits for the next task, its words don't: this worker may get other work first
            own_encoder.forget()
            give_back()

    def packed(batches: Iterator[pa.RecordBatch], own_encoder: Encoder, part: int) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, int, int, np.ndarray]] = []  # id, ids before, all its ids, ids
        held_ids, number = 0, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, held_ids, number
            ids = np.concatenate([x[3] for x in held])
            bounds = np.cumsum([x[3].size for x in held])
            out: list[tuple] = []
            k = begin = 0
            for end in windows(*cut_points(ids, bounds, own_encoder.ends), last, size):
                p = begin
                while p < end:
                    id_, before, all_, own = held[k]
                    first = int(bounds[k]) - own.size
                    q = min(end, int(bounds[k]))
                    out.append((id_, before + p - first, q - p, zlib.crc32(ids[p:q].tobytes()), all_, part + number, p - begin))
                    p = q
                    k += p == bounds[k]
                begin, number = end, number + 1
            rest = []
            if begin < ids.size:
                id_, before, all_, own = held[k]
                skip = begin - (int(bounds[k]) - own.size)
                rest = [(id_, before + skip, all_, own[skip:]), *held[k + 1 :]]
            held, held_ids = rest, int(ids.size - begin)
            columns = list(zip(*out)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], NAMES)

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            at = 0
            while at < batch.num_rows:  # as many texts as TEXT_BYTES hold, one at least
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXT_BYTES, "right")))
                some = batch.slice(at, to - at)
                every, ends = own_encoder.encode(some.column(1))
                give_back()  # what the cut-up texts took, before the next ones
                begin = 0
                for id_, end in zip(some.column(0).to_pylist(), ends.tolist()):
                    ids = np.append(every[begin:end], np.uint32(END_ID)).astype("<u4", copy=False)
                    begin = end
                    held.append((id_, 0, ids.size, ids))
                    held_ids += ids.size
                    if held_ids >= SEGMENT:
                        yield flush(False)
                at = to
        if held:
            yield flush(True)

    return pack


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, split: bool = True) -> DataFrame:
    """A row per piece: <id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and then END_ID; null texts are empty, so every row has a piece. Documents stay in
    the order of their partition; nothing is shuffled. A partition's ids are planned in segments of about SEGMENT ids, whose last
    window stays open for the next, so memory is bounded by a segment or one document. Windows are cut at ends of documents (free), of
    sentences or elsewhere (at a cost); only the end of a partition is padded by more than a few ids, or split into powers of two.
    sequence_id is the partition's number, shifted by 33, plus the sequence's. Null and repeated ids are packed like any others;
    an empty table gives no rows.

    The pieces, seven numbers each, are written to the shared folder at once, as only then the size of what goes to Python is set.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("_text"))
    kind = dict(rows.dtypes)["id"]
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(rows.schema["id"].dataType)
    out = rows.mapInArrow(_packer(tokenizer, size, split, id_type), f"id {kind}, " + ", ".join(f"{n} long" for n in NAMES[1:]))
    with batch_bytes(docs.sparkSession, BATCH):
        return frozen(out.withColumnRenamed("id", id_col), "pieces")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_pack(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_tokenizer())
