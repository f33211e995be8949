"""Media columns: interleaved sequences of text and media references, and lossless 8-bit images that hold payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import frozen, text_of
from halyard.llm.html_text import BLOCKS
from halyard.llm.markup import attributes, tokens

#: Bytes of a row of samples.
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FIELDS = "pos int, kind string, text string, ref string, caption string"
#: Elements whose raw content is text for a reader.
_SKIPPED = frozenset("script style title noscript iframe template".split())


def padded(data: bytes) -> bytes:
    """data and zeros up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(data: bytes) -> bytes:
    """An 8-bit greyscale PNG, WIDTH samples wide, whose samples are the padded data; a text chunk says how many bytes data has."""
    payload = padded(data)
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """The samples of what encode_image() made, and how many of them are data. A broken file raises ValueError."""
    if not media.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, width, height, size, packed = 8, 0, 0, None, []
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[:8])
        elif kind == b"tEXt" and data.startswith(b"Bytes\0"):
            size = int(data[6:])
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row has a filter")
    samples = rows[:, 1:].tobytes()
    return samples, len(samples) if size is None else size


def image_feature(samples: bytes) -> str:
    """mean:deviation:entropy:hash of the samples; the hash has a bit for each of 8 x 8 areas that is lighter than the mean."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / x.size
    mean = float(share @ np.arange(256))
    spread = float(np.sqrt(max(0.0, share @ np.square(np.arange(256)) - mean * mean)))
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    grid = x.reshape(-1, WIDTH)
    bands = [grid[a : max(b, a + 1)].reshape(-1, 8, 8).mean(axis=(0, 2)) for a, b in zip(*(lambda e: (np.minimum(e[:-1], len(grid) - 1), e[1:]))(np.linspace(0, len(grid), 9).astype(int)))]
    lighter = np.packbits(np.concatenate(bands) > mean).tobytes().hex()
    return f"{mean:.6f}:{spread:.6f}:{entropy:.6f}:{lighter}"


def parse_interleaved(html: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(pos, kind, text, ref, caption) in page order. kind is text (one block each) or media (img, video, audio, source, embed or object).

    A reference's caption is its figure's figcaption, else its alt or title; captions aren't text items.
    """
    items: list[list] = []
    line: list[str] = []
    figures: list[list] = []  # of open figures: the items at which they began, and the caption's parts or None
    in_caption = 0

    def end() -> None:
        if text := " ".join("".join(line).split()):
            items.append(["text", text, None, None])
        line.clear()

    def close_figure() -> None:
        first, parts = figures.pop()
        caption = " ".join("".join(parts).split())
        if caption:
            for item in items[first:]:
                if item[0] == "media":
                    item[3] = caption

    for kind, name, rest in tokens(html):
        if kind == "text":
            (figures[-1][1] if in_caption and figures else line).append(name)
        elif kind == "raw":
            if rest not in _SKIPPED:
                line.append(name)
        elif kind == "open":
            if name == "br":
                line.append(" ")
            elif name in BLOCKS:
                end()
            if name == "figure":
                figures.append([len(items), []])
            elif name == "figcaption":
                in_caption += 1
            elif name in ("img", "video", "audio", "source", "embed", "object"):
                got = attributes(rest)
                if ref := got.get("src") or got.get("data"):
                    end()
                    items.append(["media", None, ref, got.get("alt") or got.get("title") or None])
        elif kind == "close":
            if name == "figcaption":
                in_caption = max(0, in_caption - 1)
            elif name == "figure" and figures:
                end()
                close_figure()
            elif name in BLOCKS:
                end()
    end()
    while figures:
        close_figure()
    return [(k, *item) for k, item in enumerate(items)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    keys = ("pos", "kind", "text", "ref", "caption")
    for batch in batches:
        found = [[dict(zip(keys, x)) for x in parse_interleaved(html.as_py())] for html in batch.column("_html")]
        names = [n for n in batch.schema.names if n != "_html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, item)], [*names, "items"])


def interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per row of pages: <id_col>, items, an array of structs in page order. Null html has no items; repeated rows stay."""
    rows = pages.select(pages[id_col].alias("id"), text_of(pages, html_col).alias("_html"))
    return rows.mapInArrow(_parse, f"id {dict(rows.dtypes)['id']}, items array<struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>>").withColumnRenamed("id", id_col)


def resolve(sequences: DataFrame, media: DataFrame, id_col: str = "page_id", prefix: str = "sha256:") -> DataFrame:
    """sequences (of interleaved()) as rows: <id_col>, row, pos, of (how many items the sequence has), kind, text, ref, caption and media's columns but digest.

    media has one row per digest; a column with the name of one of the others is called media_<name>. A reference is prefix and a digest;
    others, and digests that media lacks, get nulls and keep their place, as do texts, which take no part in the join. Both sides of the join
    are plain tables, so Spark splits a digest that many documents share. Sort by row and pos to have a sequence again, or call aligned().
    """
    numbered = sequences.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("_id"), F.size("items").alias("of"), "items")
    numbered = numbered.select("row", "_id", "of", F.explode_outer("items").alias("i"))
    at = frozen(numbered.select("row", "_id", "of", "i.*", F.when(F.startswith("i.ref", F.lit(prefix)), F.substring("i.ref", len(prefix) + 1, 64)).alias("_digest")), "items")
    first = [F.col("_id").alias(id_col), *map(F.col, ("row", "pos", "of", "kind", "text", "ref", "caption"))]
    taken = {id_col, "row", "pos", "of", "kind", "text", "ref", "caption"}
    named = {c: f"media_{c}" if c in taken else c for c in media.columns if c != "digest"}
    found = media.select(F.col("digest").alias("_found"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]).alias("_media"))
    joined = at.filter("_digest is not null").join(found, F.col("_digest") == F.col("_found"), "left")
    rest = at.filter("_digest is null").withColumn("_media", F.lit(None).cast(found.schema["_media"].dataType))
    pick = [F.col(f"_media.`{n}`").alias(n) for n in named.values()]
    return joined.select(*first, *pick).union(rest.select(*first, *pick))


def aligned(resolved: DataFrame, id_col: str = "page_id") -> DataFrame:
    """What resolve() returns, as one array of structs per document again, by position. A document is one group, whatever it shares.

    A document without items has an empty array; an unresolved reference stays, its payload null. Documents with null or equal ids stay apart,
    as `row` tells them; an empty table gives no rows.
    """
    item = F.struct("pos", *[c for c in resolved.columns if c not in (id_col, "row", "pos", "of")])
    return resolved.groupBy("row", id_col).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), item))).alias("items")).drop("row")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            texts = [x.as_py() for x in some.column("_text")]
            digests = [hashlib.sha256(padded(x)).hexdigest() for x in texts]
            pages = [f'<h1>{x.count(b"\n") + 1} lines</h1><figure><img src="sha256:{d}"><figcaption>{len(x)} bytes</figcaption></figure><p>{len(x.split())} words' for d, x in zip(digests, texts)]
            yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(pages), pa.array(list(map(encode_image, texts)), pa.binary())], ["id", "html", "media"])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cell in batch.column("media"):
            media = cell.as_py()
            samples, size = decode_image(media)
            out.append((hashlib.sha256(samples).hexdigest(), size, len(samples), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(samples)))
        columns = list(zip(*out)) if out else [()] * 7
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], MEDIA)


MEDIA = ["digest", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a table in the shared folder: id, html (a heading, a figure that refers to the document's payload by digest, and a paragraph), media (the image that holds it).

    A row per row of docs: a null text is empty and stored as 64 zero bytes; null ids and repeated rows are kept; an empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).cast("binary").alias("_text"))
    return frozen(rows.mapInArrow(_store, f"id {dict(rows.dtypes)['id']}, html string, media binary"), "media", codec="none")


def media_features(stored: DataFrame) -> DataFrame:
    """stored: media, images. Reads them back; a row per digest of the samples (an extra field, n_bytes, sets padded texts apart) with what MEDIA names.

    Equal images give one row; an empty table gives none.
    """
    seen = stored.select("media").mapInArrow(_read_back, "digest string, n_bytes long, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return seen.distinct()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: <id_col>, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, caption, pos, items.

    Each text (null: empty) is stored as an image and referred to by the figure of a page, between a heading and a paragraph; pages are
    parsed, and digests of what is read back resolve the references. pos is the figure's place among the page's items. Images stay where they were written: only digests and features are shuffled. Texts that differ in
    trailing zero bytes alone share a payload, so size takes part in the join. Equal texts and repeated rows have equal values; null
    ids are kept; an empty table gives no rows.
    """
    stored = store_texts(docs, id_col, text_col)
    known = frozen(media_features(stored), "features")
    found = resolve_sized(interleaved(stored.withColumnRenamed("id", id_col), id_col, "html"), known, id_col)
    return found


def resolve_sized(sequences: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """resolve() where payloads may only differ in how many of their bytes are data; the caption says how many."""
    by_digest = known.groupBy("digest").agg(F.collect_list(F.struct(*MEDIA[1:])).alias("_same"))  # as many as one payload has unpadded sizes: 64 at most
    rows = resolve(sequences, frozen(by_digest, "digests"), id_col).filter("kind = 'media'")
    size = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    rows = rows.withColumn("_m", F.element_at(F.filter("_same", lambda m: m["n_bytes"] == size), 1))
    return rows.select(F.col(id_col), "_m.n_bytes", "_m.payload_bytes", F.substring("ref", 8, 64).alias("payload_sha256"), "_m.tail_crc32", "_m.media_bytes", "_m.media_sha256", "_m.feature", "caption", "pos", F.col("of").alias("items"))


def op2_media_columns(spark, sf_dir):
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
