"""The corpus operators against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from halyard.llm import chat, common, exact_dedup, filter_audit, html_text, line_dedup, manifest, media, mixing, packing, pii, simhash, suffix_dedup, suffix_sort, toxicity
from halyard.llm.components import Forest, components
from halyard.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [
    (1, "Hello  world, this is a text of some words", "b", 1),
    (2, "Hello world,\tthis is a text of some words", "b", 2),
    (3, None, "a", 3),
    (4, "", "a", 4),
    (5, " \n\x0b ", None, 5),
    (6, "x " * 40_000, "a", 6),
    (7, "ünïcode £ 漢字 😀 é́", "ß", 7),
    (7, "ünïcode £ 漢字 😀 é́", "ß", 7),
    (None, "no id", None, None),
    (None, "Hello world, this is a text of some words", "b", 8),
]
SCHEMA = "doc_id long, text string, source string, row int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = [(1, 1), (2, 0), (None, 1), (3, None), (4, 1), (4, 0)]


def labels(spark):
    """Labels with the operators' own names, an id that is null, and one that is labelled both ways."""
    return spark.createDataFrame(LABELS, "doc_id long, toxic int").withColumn("_id", F.lit("x")).withColumn("_text", F.lit(0)).withColumn("_toxic", F.lit("y"))


#: Rows that come out: as many as documents, some of them, pieces, or lines.
OPERATORS = {
    "mix_report": ("all", lambda s, d: mixing.mix_report(d)),
    "media": ("all", lambda s, d: media.media_columns(d)),
    "simhash": ("all", lambda s, d: simhash.simhash_components(d)),
    "suffix": ("all", lambda s, d: suffix_dedup.cut_repeats(d)),
    "pii": ("all", lambda s, d: pii.find_pii(d)),
    "toxicity": ("all", lambda s, d: toxicity.severities(d, labels(s))),
    "exact": ("all", lambda s, d: exact_dedup.exact_dedup(d)),
    "html": ("all", lambda s, d: html_text.extract_text(d, "doc_id", "source", "text")),
    "interleaved": ("all", lambda s, d: media.interleaved(d, "doc_id", "text")),
    "resolve": ("items", lambda s, d: media.resolve(media.interleaved(d, "doc_id", "text"), d.select(F.lit("aa").alias("digest"), "row", "kind", "pos").limit(1), "doc_id")),
    "pack": ("pieces", lambda s, d: packing.pack(d, packing.word_tokenizer())),
    "lines": ("lines", lambda s, d: line_dedup.line_components(d)),
    "chat": ("all", lambda s, d: chat.formatted(d, *chat.byte_tokenizer(), "doc_id", "row", "source")),
    "manifest": ("all", lambda s, d: manifest.manifest(d, group_col="source", fields=("doc_id", "source", "text", "row"), later=lambda c: F.lower(d["text"]) if c == "text" else None)),
    "mix": ("some", lambda s, d: mixing.mix(d)),
    "drop_exact_copies": ("some", lambda s, d: exact_dedup.drop_exact_copies(d)),
    "drop_near_copies": ("some", lambda s, d: simhash.drop_near_copies(d)),
    "drop_toxic": ("some", lambda s, d: toxicity.drop_toxic(d, labels(s))),
}
#: Names that operators use inside.
CLASHES = "id _id _text _html rid size row key line_no check new bands at kind pos of ref caption items html media digest fp least label root component_id fingerprint toxic _toxic _key _h _l _s _c _doc _own_0 _kept_0 _nth _size _class _cell _hash _copies _rank source_size target taken copies _digest _bytes _check _row _run _block _norm _first _members kept severity grade p_toxic rejected spans n_bytes found text_sha256 start length sequence_id offset url n_chars part mask bytes n good first leads salt cells g idx hash group leaf later parent run path upper inside before conv turn tie place ids loss_mask n_ids role".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, odd, name):
    gives, run = OPERATORS[name]
    clash = odd.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)], F.lit("d").alias("a.b"))
    out = run(spark, clash)
    got = Counter(r["doc_id"] for r in out.collect())
    want = Counter(r[0] for r in ODD)
    if gives == "lines":
        want = Counter(r[0] for r in ODD for line in (r[1] or "").split("\n") if line.split())
    if gives in ("all", "lines"):
        assert got == want
    elif gives in ("pieces", "items"):
        assert got.keys() == want.keys()
    else:
        assert got.keys() <= want.keys() and out.columns == clash.columns
    none = run(spark, clash.filter("false"))
    assert none.collect() == [] and none.columns == out.columns


def test_exact_dedup(spark, odd):
    rows = exact_dedup.exact_dedup(odd, fan_in=2, leaf_rows=1).collect()
    kept = [r for r in rows if r["kept"]]
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 3, 5, 6, 7]
    group = [r for r in rows if r["keep_id"] == 1]
    assert len(group) == 3 and {r["group_size"] for r in group} == {3} and sum(r["kept"] for r in group) == 1
    assert sum(r["kept"] for r in rows if r["doc_id"] == 7) == 1
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and left.count() == len(kept)


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, FOLDER).select(*want.columns).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_mixing(spark):
    random.seed(3)
    rows = [(k, "w " * int(random.lognormvariate(3, 1)), "abcdef"[min(5, int(random.expovariate(0.8)))]) for k in range(3000)] + [(9000 + k, "w " * k, None) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_report(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(df.repartition(2)).collect()))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = left / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in sizes if s not in capped and weight[s] * share > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3.0 * sizes[s] if s in capped else weight[s] * share for s in sizes}
    taken, source_of, size_of = Counter(), {k: s for k, _, s in rows}, {k: len(t.split()) for k, t, _ in rows}
    for r in got:
        assert r["target"] == pytest.approx(target[source_of[r["doc_id"]]]) and r["taken"] <= 3 * r["size"]
        assert r["size"] == size_of[r["doc_id"]]
        taken[source_of[r["doc_id"]]] += r["taken"]
    longest = max(len(t.split()) for _, t, _ in rows)
    for s in target:
        assert abs(taken[s] - target[s]) <= 3 * longest
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    prints = {k: brute_fingerprint(t) for k, t in docs.items()}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = brute_components(prints, linked)
    got = by_id(QUERIES["op4_simhash"](spark, FOLDER))
    assert {k: int(r["fingerprint"], 16) for k, r in got.items()} == prints
    assert {k: r["component_id"] for k, r in got.items()} == want


def copied(pick, words, rate):
    """The words with some replaced."""
    return [pick.choice("abcdefgh") * 5 if pick.random() < rate else w for w in words]


def test_near_copies(spark, docs):
    """Against all pairs of sets, for documents and for copies around the bound."""
    pick = random.Random(5)
    texts = dict(docs)
    for k in range(40):
        base = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 8))) for _ in range(pick.choice((6, 60, 300)))]
        for n in range(5):
            texts[10**6 + 10 * k + n] = " ".join(copied(pick, base, pick.choice((0, 0.01, 0.02, 0.04, 0.2))))
    texts |= {2 * 10**6: None, 2 * 10**6 + 1: "", 2 * 10**6 + 2: " \n"}
    sets = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[k] = frozenset(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([" ".join(words)] if words else [])
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(brute_components(ids, linked).values())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {r["doc_id"] for r in simhash.drop_near_copies(df).collect()} == want
    few = df.filter("doc_id >= 1000000")
    labels_ = {r["doc_id"]: r["label"] for r in simhash.near_copies(few, tile=8, part=16).collect()}
    assert len(set(labels_.values())) == len(set(brute_components(list(labels_), [x for x in linked if x[0] in labels_ and x[1] in labels_]).values()))


def test_near_copies_misses_no_link(spark):
    """Groups of alike texts around the bound, where a pair that joins others in the sketches is often not similar itself."""
    pick = random.Random(1)
    texts, linked = {}, []
    for words, changes in ((14, 1), (60, 1), (120, 2)):
        for _ in range(40):
            base = [f"w{pick.randrange(10**6)}" for _ in range(words)]
            alike = {}
            for _ in range(6):
                at = set(pick.sample(range(words), changes))
                alike[len(texts) + len(alike)] = [f"x{pick.randrange(10**6)}" if k in at else w for k, w in enumerate(base)]
            sets = {k: {tuple(t[i : i + 5]) for i in range(len(t) - 4)} for k, t in alike.items()}
            linked += [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            texts |= {k: " ".join(t) for k, t in alike.items()}
    want = brute_components(list(texts), linked)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["label"] for r in simhash.near_copies(df).collect()}
    assert sum(got[a] != got[b] for a, b in linked) == 0
    assert len(set(got.values())) == len(set(want.values()))


def test_maps_rule_out_no_similar_pair():
    """Maps of any width, folded to the smaller, against the sets themselves."""
    rng = np.random.default_rng(4)
    sets = []
    for size in (1, 2, 3, 60, 63, 64, 65, 130, 500, 1000, 1100, 3000, 5000):
        base = np.unique(rng.integers(0, 2**64, size, np.uint64))
        for changed in (0, 1, size // 12, size // 6, size):
            sets.append(np.unique(np.concatenate((base[changed:], rng.integers(0, 2**64, changed, np.uint64)))))
    sizes = np.array([x.size for x in sets])
    known = simhash._Maps(sizes, np.concatenate([simhash.folded(simhash.parity(x), simhash.map_words(x.size)) for x in sets]))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    got = known.possible(a, b)
    both = np.array([np.intersect1d(sets[i], sets[j]).size for i, j in zip(a, b)])
    similar = 5 * both >= 4 * (sizes[a] + sizes[b] - both)
    alike = (np.minimum(sizes[a], sizes[b]) >= 0.8 * np.maximum(sizes[a], sizes[b])) & (sizes[a] >= 60) & (sizes[a] <= 1100)
    assert got[similar].all() and got[~similar & alike & (both == 0)].mean() < 0.1


def test_alike_pages_leave_the_task_only_where_they_may_be_similar(spark):
    """Pages of five templates, 0.7 to 0.9 of whose words are the template's: what meets by a shared shingle is many times what may be similar."""
    pick = random.Random(7)
    frames = [[f"t{k}_{n}" for n in range(240)] for k in range(5)]
    texts = []
    for n in range(500):
        frame, own = frames[n % 5], [f"o{pick.randrange(10**6)}" for _ in range(pick.choice((20, 40, 80)))]
        texts.append((n, " ".join([*own[:10], *frame, *own[10:]])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = df.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("_text"), F.xxhash64("doc_id").alias("_key"))
    none = np.zeros(0, np.uint64)
    kinds = "id long, _key long, node long, check long, fp long, f1 long, f2 long, f3 long, size int, prefix binary, parity binary"
    prints = common.frozen(rows.mapInArrow(simhash._sketches(none, none), kinds), "prints")
    apart = spark.createDataFrame([], "node long, label long")
    seen = []
    frozen, simhash_frozen = common.frozen, simhash.frozen
    met = []

    def counted(frame, name, **how):
        seen.append((name, frozen(frame, name, **how)))
        met.append(seen[-1][1].count())
        return seen[-1][1]

    simhash.frozen = counted
    try:
        possible = simhash._meetings(prints, apart).count()
    finally:
        simhash.frozen = simhash_frozen
    size = {r["node"]: (r["size"], np.frombuffer(r["parity"], "<u8")) for r in prints.collect()}
    nodes = sorted(size)
    by_maps = sum(9 * simhash.least_apart(size[a][1], size[b][1]) <= size[a][0] + size[b][0] for i, a in enumerate(nodes) for b in nodes[i + 1 :])
    assert [n for n, _ in seen] == ["meetings", "possible"] and 0 < possible <= by_maps
    assert met[0] <= 2 * possible and met[0] < 0.5 * 5 * 100 * 99 / 2  # a class has 100 pages


def test_spanning_edges():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 300, (2, 400))
    f = Forest(300)
    used = f.spanning(a, b)
    g = Forest(300)
    g.join(a[used], b[used])
    assert np.array_equal(f.find(np.arange(300)), g.find(np.arange(300))) and used.size == 300 - np.unique(f.find(np.arange(300))).size


@pytest.mark.parametrize("tile,part", [(8, 1 << 20), (64, 16)])
def test_near_edges(spark, tile, part):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 40)
    noise = [int(b) ^ int(sum(1 << int(x) for x in rng.choice(63, 3, replace=False))) for b in base for _ in range(3)]
    prints = sorted({*map(int, base), *noise})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    linked = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = brute_components(prints, linked)
    edges = [(r["a"], r["b"]) for r in simhash.near_edges(df, 4, tile, part).collect()]
    assert brute_components(prints, edges) == want
    assert {r["node"]: r["label"] for r in components(simhash.near_edges(df, 4, tile, part)).collect()} == {k: v for k, v in want.items() if sum(x == v for x in want.values()) > 1}


def test_forest_and_chain(spark):
    f = Forest(50)
    f.join(np.arange(49), np.arange(1, 50))
    a, b = f.edges()
    assert len(a) == 49 and max(Counter([*a, *b]).values()) <= 17
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in components(chain).collect()} == {0}


def test_suffix_array():
    random.seed(2)
    for _ in range(2000):
        s = [random.randint(1, random.choice((1, 2, 4))) for _ in range(random.randint(0, 40))] + [0]
        assert suffix_sort.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_cut(docs):
    seen, out = set(), {}
    for k in sorted(docs):
        b = (docs[k] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[k] = (len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2048, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    random.seed(hot)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    docs = {k: " ".join(word() for _ in range(random.randint(0, 60))) + (" " + passage[random.randint(0, 100) :] if k % 3 else "") + " ".join(word() for _ in range(10)) for k in range(60)}
    docs |= {100: "a" * 500, 101: "ab" * 300, 102: docs[5], 103: None, 104: passage + passage}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.cut_repeats(df).collect()}
    assert got == brute_cut(docs)
    texty = df.withColumn("doc_id", F.format_string("%05d", "doc_id"))
    assert {int(r["doc_id"]): r["n_removed"] for r in suffix_dedup.cut_repeats(texty).collect()} == {k: v[1] for k, v in got.items()}


def test_suffix_dedup_of_the_table(spark, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op5_suffix_dedup"](spark, FOLDER).collect()}
    assert got == brute_cut(docs)


def test_segments_apart():
    """Equal bytes have equal fingerprints, wherever they lie; bytes that differ in one place don't."""
    rng = np.random.default_rng(3)
    body = rng.integers(0, 256, 150).astype(np.uint8)
    data = np.concatenate((rng.integers(0, 256, 777).astype(np.uint8), body, rng.integers(0, 256, 99).astype(np.uint8), body))
    spots = np.array([777, 777 + 150 + 99])
    one, two = suffix_dedup._fingerprints(data, spots, spots + 150, 4096)
    assert one == two
    seen = {int(one)}
    for k in range(150):
        other = data.copy()
        other[777 + k] ^= 1
        seen.add(int(suffix_dedup._fingerprints(other, spots[:1], spots[:1] + 150, 4096)[0]))
    assert len(seen) == 151


def by_hand_png(data):
    """An 8-bit grey PNG, 64 wide, written from the format's rules: size, a text chunk with the number of bytes, unfiltered rows."""
    payload = data + b"\0" * ((64 - len(data) % 64) % 64 or (0 if data else 64))
    rows = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
    parts = [(b"IHDR", (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])), (b"tEXt", b"Bytes\0" + str(len(data)).encode()), (b"IDAT", zlib.compress(rows, 6)), (b"IEND", b"")]
    return bytes.fromhex("89504e470d0a1a0a") + b"".join(len(x).to_bytes(4, "big") + k + x + zlib.crc32(k + x).to_bytes(4, "big") for k, x in parts), payload


def by_hand_feature(payload):
    n = len(payload)
    mean = sum(payload) / n
    spread = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
    entropy = -sum(c / n * np.log2(c / n) for c in Counter(payload).values())
    rows = [payload[k : k + 64] for k in range(0, n, 64)]
    edges = [int(k * len(rows) / 8) for k in range(9)]
    bits = ""
    for a, b in zip(edges, edges[1:]):
        band = rows[min(a, len(rows) - 1) : max(b, min(a, len(rows) - 1) + 1)]
        for c in range(8):
            area = [x for r in band for x in r[8 * c : 8 * c + 8]]
            bits += str(int(sum(area) / len(area) > mean))
    return mean, spread, entropy, f"{int(bits, 2):016x}"


def test_media(spark, docs):
    for r in QUERIES["op2_media_columns"](spark, FOLDER).collect():
        b = docs[r["doc_id"]].encode()
        image, p = by_hand_png(b)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(image), hashlib.sha256(image).hexdigest())
        mean, spread, entropy, areas = by_hand_feature(p)
        *numbers, seen = r["feature"].split(":")
        assert np.allclose([float(x) for x in numbers], (mean, spread, entropy), atol=2e-6) and bin(int(seen, 16) ^ int(areas, 16)).count("1") <= 1  # an area may be the mean but for rounding
        assert (r["pos"], r["items"], r["caption"]) == (1, 3, f"{len(b)} bytes")
    assert media.decode_image(media.encode_image(b"")) == (bytes(64), 0)
    with pytest.raises(ValueError):
        media.decode_image(media.encode_image(b"abc").replace(b"IDAT", b"IDAX"))


def test_interleaved(spark):
    html = '<p>One &amp; <b>two</b><img src="sha256:aa" alt="A"><figure><img src="b.png"><figcaption>Cap  tion</figcaption></figure>Last<script>var x="<p>"</script>'
    items = media.parse_interleaved(html)
    assert [i[1:] for i in items] == [("text", "One & two", None, None), ("media", None, "sha256:aa", "A"), ("media", None, "b.png", "Cap tion"), ("text", "Last", None, None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    known = spark.createDataFrame([("aa", 5)], "digest string, width int")
    rows = media.aligned(media.resolve(media.interleaved(pages), known)).collect()
    got = {r["page_id"]: r["items"] for r in rows}
    odd_names = spark.createDataFrame([("aa", 5, "k", 9)], "digest string, row int, kind string, pos int")
    again = media.resolve(media.interleaved(pages), odd_names).filter("ref = 'sha256:aa'").first()
    assert (again["media_row"], again["media_kind"], again["media_pos"], again["kind"], again["pos"], again["of"]) == (5, "k", 9, "media", 1, 4)
    assert [(i["pos"], i["width"]) for i in got[1]] == [(0, None), (1, 5), (2, None), (3, None)] and got[2] == got[3] == []


def test_interleaved_pages(spark):
    """Figures and pictures put into the table's pages: places, captions and payloads against a plain reading of the marks."""
    pick = random.Random(9)
    rows, want = [], {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect():
        parts, out, refs = r["html"].split("</p>"), [], []
        for k, part in enumerate(parts):
            out.append(part + ("</p>" if k + 1 < len(parts) else ""))
            if 0 < k + 1 < len(parts) and "<article>" in "".join(parts[: k + 1]) and "</article>" not in "".join(parts[: k + 1]):
                n = pick.randrange(4)
                if n == 1:
                    out.append(f'<figure><img src="sha256:{k}" alt="a"><figcaption>Cap <b>{k}</b>\n of it</figcaption></figure>')
                    refs.append((f"sha256:{k}", f"Cap {k} of it"))
                elif n == 2:
                    out.append(f'<img src="x{k}.png" alt="Alt {k}">')
                    refs.append((f"x{k}.png", f"Alt {k}"))
        rows.append((r["page_id"], "".join(out)))
        want[r["page_id"]] = refs
    pages = spark.createDataFrame(rows, "page_id long, html string")
    known = spark.createDataFrame([(str(k), 7 * k) for k in range(0, 40, 2)], "digest string, size int")
    got = {r["page_id"]: r["items"] for r in media.aligned(media.resolve(media.interleaved(pages), known)).collect()}
    assert got.keys() == want.keys() and sum(map(len, want.values())) > 50
    for (id_, html) in rows:
        items = got[id_]
        assert [i["pos"] for i in items] == list(range(len(items)))
        assert [(i["ref"], i["caption"]) for i in items if i["kind"] == "media"] == want[id_]
        for i in items:
            if i["kind"] == "media":
                digest = i["ref"].removeprefix("sha256:")
                assert i["size"] == (7 * int(digest) if digest.isdigit() and int(digest) % 2 == 0 and int(digest) < 40 else None)
        # texts and references lie in the order of the page
        places = [html.index(i["ref"]) if i["kind"] == "media" else None for i in items]
        assert [p for p in places if p is not None] == sorted(p for p in places if p is not None)
        for before, here, after in zip(items, items[1:], items[2:]):
            if here["kind"] == "media" and before["kind"] == after["kind"] == "text":
                at = html.index(here["ref"])
                last, first = before["text"].split()[-1], after["text"].split()[0]
                assert last[:3] in unescape(html[:at]) and first[:3] in unescape(html[at:])


def test_lines(spark, docs):
    got = line_dedup.line_components(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    where = {}
    for k, t in docs.items():
        for n, line in enumerate(t.split("\n")):
            if line := line_dedup.normal(line):
                where.setdefault(line, []).append((k, n))
    lines = list(where)
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    linked = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if len(sets[a]) * 0.8 <= len(sets[b]) <= len(sets[a]) / 0.8 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = brute_components(range(len(lines)), linked)
    first = {}
    for k, x in enumerate(lines):
        first[label[k]] = min(first.get(label[k], (10**9, 0)), min(where[x]))
    want = {o: first[label[k]] for k, x in enumerate(lines) for o in where[x]}
    have = {(r["doc_id"], r["line_no"]): (r["component_doc_id"], r["component_line_no"]) for r in got.collect()}
    assert have.keys() == want.keys()
    assert sum(have[k] != want[k] for k in want) <= 0.002 * len(want)


def test_lines_of_any_plan(spark):
    """Shuffled and joined documents give the rows of the plain table, however Spark coalesces partitions."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rows = lambda df: sorted(map(tuple, line_dedup.line_components(df).collect()))
    want = rows(docs)
    ids = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for size, adaptive in (("64KB", "true"), ("64MB", "true"), ("64MB", "false")):
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            assert rows(docs.repartition("doc_id") if adaptive == "true" else docs.join(ids, "doc_id").drop("lang")) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_lines_are_not_sorted_to_find_their_heads(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = line_dedup.line_components(spark.createDataFrame([(1, "one line\nanother"), (2, "one line")], "doc_id long, text string"))
        assert out.count() == 3 and "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fetched_lines_are_those_asked_for():
    import pyarrow as pa

    item = pa.list_(pa.struct([("bucket", pa.int64()), ("two", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("line_no", pa.int32())]))
    ask = lambda line, no: {"bucket": 1, "two": 0, "side": 0, "id": line_dedup.identity(line)[0], "line_no": no}
    wanted = pa.array([[ask("a", 0), ask("b b", 1)]] * 3, item)
    # two documents with one key, the first of them twice
    batch = pa.RecordBatch.from_pydict({"key": pa.array([5, 5, 5], pa.int64()), "text": pa.array(["a\nB  b", "a", "a\nB  b"]), "wanted": wanted})
    assert pa.Table.from_batches(line_dedup._fetch(iter([batch, batch]))).column("line").to_pylist() == ["a", "b b", "a"]


def test_repeated_rows_cost_lines_nothing(spark):
    """A row that comes 20,000 times, with a null id, against as many rows with ids of their own."""
    body = "\n".join(f"a line {k} that is much like others {k % 7} and some" for k in range(12))
    seconds = {}
    for name, id_ in (("warm", F.col("id")), ("own", F.col("id")), ("null", F.lit(None).cast("long"))):
        df = spark.range(2000 if name == "warm" else 20_000, numPartitions=4).select(id_.alias("doc_id"), F.lit(body).alias("text"))
        began = time.time()
        rows = line_dedup.line_components(df).groupBy("kept").count().collect()
        seconds[name] = time.time() - began
        assert sum(r["count"] for r in rows) == 12 * df.count()
    assert seconds["null"] < 1.5 * seconds["own"] + 1


def test_similar_lines_of_buckets():
    pick = random.Random(7)
    lines, ends, sides = [], [], []
    for size in (2, 1, 5, 30, 2, 9):
        base = [pick.choice("abcd efgh") for _ in range(pick.choice((3, 60, 400)))]
        for k in range(size):
            line = list(base)
            for _ in range(pick.randrange(4)):
                line[pick.randrange(len(line))] = pick.choice("xyz")
            lines.append("".join(line))
            sides.append(k % 2 if size == 9 else int(size == 30))
        ends.append(len(lines))
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    linked = [(a, b) for start, end in zip([0, *ends], ends) for a in range(start, end) for b in range(a + 1, end) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and (end - start != 9 or sides[a] != sides[b])]
    want = brute_components(range(len(lines)), linked)
    forest = line_dedup.similar(lines, np.array(ends), np.array(sides))
    assert len(set(want.values())) < len(lines)
    assert forest.find(np.arange(len(lines))).tolist() == [want[k] for k in range(len(lines))]


def test_lines_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 3)
    base = "the quick brown fox jumps over the lazy dog and runs into the dark green forest again"
    df = spark.createDataFrame([(k, base + f" {k}") for k in range(20)], "doc_id long, text string")
    assert {r["component_doc_id"] for r in line_dedup.line_components(df).collect()} == {0}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, docs):
    for k, r in by_id(QUERIES["op6_pii"](spark, FOLDER)).items():
        base = brute_base(docs[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    random.seed(1)
    for _ in range(3000):
        t = "".join(random.choice(("a", "b.c", "@", ".", "-", "@x.y", "1", "25", "+1", " ", "(", "4111 1111 1111 1111", "255.1.2.3", "999")) for _ in range(12))
        assert pii._joined(pii.base_spans(t)) == brute_base(t), t


def test_weak_supervision():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.4
    votes = np.stack([np.where(rng.random(2000) < q, truth, ~truth).astype(int) for q in (0.95, 0.8, 0.65)], 1)
    votes[rng.random(votes.shape) < 0.2] = -1
    p, true, _ = pii.weigh(votes)
    assert ((p > 0.5) == truth).mean() > 0.9 and true[0] > true[2]
    masked = "mail me: bob [at] mail.com or password=ab12cd34ef56 order 123-456-7890"
    assert [c[0] for c in pii.candidates(masked, [])] == ["email", "phone", "secret"]


def test_pii_trains_on_all_documents(spark, monkeypatch):
    seen, fitted = [], []
    by_kind, weigh, fit = pii.likelihoods_by_kind, pii.weigh, pii.fit
    monkeypatch.setattr(pii, "likelihoods_by_kind", lambda rows: seen.append(sum(n for _, _, n in rows)) or by_kind(rows))
    monkeypatch.setattr(pii, "fit", lambda x, p: fitted.append(len(x)) or fit(x, p))
    rows = [(None if k % 2 else k, f"mail a{k}@b.com or phone 234-555-{1000 + k}") for k in range(300)] + [(None, "mail x@y.org")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [pii.train(docs.repartition(n), sample=100) for n in (1, 5)]
    assert seen == [650, 650] and fitted == [100, 100]
    assert np.array_equal(*parts)
    pii.train(docs)
    assert fitted[-1] == 601
    table = np.array([[1, 0, -1, 1], [0, 1, 1, -1], [1, 1, 1, 1]])
    counts = np.array([3, 1, 5])
    assert np.allclose(weigh(table, counts=counts)[0], weigh(np.repeat(table, counts, 0))[0][[0, 3, 4]])
    table, counts = np.array([[1, -1, -1, 0], [1, -1, -1, 1], [1, -1, 1, 1], [1, 1, -1, 1]]), np.array([1, 2540, 778, 2465])
    assert np.allclose(pii.likelihoods(table, counts), pii.likelihoods(table, counts * 300), atol=1e-6) and pii.likelihoods(table, counts)[1:].min() > 0.99


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def planted(pick):
    """A text with one thing that is personal or only looks so, and its span if it is."""
    digits = lambda n, first="0123456789": pick.choice(first) + "".join(pick.choices("0123456789", k=n - 1))
    kind = pick.choice(("email", "card", "phone", "secret", "iban", "ssn"))
    true = pick.random() < 0.6
    if kind == "email":
        lead, span = pick.choice(("mail ", "contact ")), f"{pick.choice(('bob', 'eve.x'))} [at] host{digits(2)}.{pick.choice(('com', 'de', 'org')) if true else 'foo' + pick.choice('qxz')}"
        lead = lead if true else "page "
    elif kind == "card":
        span = next(x for x in iter(lambda: "37" + digits(13), None) if pii.luhn(x) == true)
        lead = "card " if true else "order "
    elif kind == "phone":
        lead, span = ("call ", f"({digits(1, '2345678')}{digits(1, '02345678')}{digits(1)}) {digits(3, '23456789')}-{digits(4)}") if true else ("invoice ", f"1{digits(2)}-0{digits(2)}-{digits(4)}")
    elif kind == "secret":
        lead, span = 'token = "', "".join(pick.choices("abcdefghkmpqrstuvw0123456789ABCDEFGH", k=24)) + "7a" if true else pick.choice(("changeme-please", "your-token-here", "undefined_value"))
    elif kind == "iban":
        body = digits(18)
        span = f"DE{98 - mod97('DE00' + body):02d}{body}" if true else f"DX{digits(20)}"
        lead = "account " if true else "version "
    else:
        lead, span = ("ssn ", f"{digits(3, '1234578')}-{digits(2, '123456789')}-{digits(4, '123456789')}") if true else ("ticket ", f"000-{digits(2)}-{digits(4)}")
    before = " ".join(pick.choices("lorem ipsum dolor sit amet".split(), k=pick.randint(3, 30))) + ", " + lead
    return before + span + pick.choice(('"', "")) * (kind == "secret") + " and so on", (kind, len(before), len(before) + len(span)) if true else None


def test_pii_added_spans_on_held_out_texts(spark):
    """Of spans beyond the fixed patterns, planted in texts that the model hasn't seen."""
    pick = random.Random(11)
    rows = [planted(pick) for _ in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows[:2000])], "doc_id long, text string")
    weights = pii.train(docs)
    found = missed = wrong = 0
    for text, span in rows[2000:]:
        base, every = pii.all_spans(text, weights)
        more = {(pii.KINDS[k], a, b) for k, a, b in every if (k, a, b) not in base}
        if span is not None and not base:
            found, missed = found + (span in more), missed + (span not in more)
        wrong += len(more - {span})
    print("added spans: recall", found / (found + missed), "precision", found / (found + wrong))
    assert found / (found + missed) > 0.9 and found / (found + wrong) > 0.9


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    got = toxicity.severities(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    assert sum(r["rejected"] == bool(r["toxic"]) for r in got) / len(got) > 0.93
    assert not [r for r in got if r["rejected"] and not r["toxic"]]
    few = spark.range(1).select(toxicity._part(F.lit(5), 2e4 / 1e15), toxicity._part(F.lit(-(2**62) + 2**61), 2e4 / 1e15), toxicity._part(F.lit(-1), 1.0)).first()
    assert tuple(few) == (True, False, True)  # a sample of 20,000 of 10^15 isn't empty
    assert abs(spark.range(100_000).filter(toxicity._part(F.xxhash64("id"), 0.02)).count() - 2000) < 200
    rng = np.random.default_rng(4)
    x = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(1500)]
    score = np.array([2.0 * (0 in r) + 1.5 * (1 in r) for r in x]) + rng.logistic(size=1500)
    grades = (score > 1).astype(int) + (score > 3)
    w, cuts = toxicity.fit_ordinal(x, grades, 6)
    assert cuts[0] < cuts[1] and w[0] > w[1] > max(abs(w[2:])) and abs(w[0] - 2) < 0.6


PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><div class='content'><h1>T</h1><p>First, one &amp; two.<p>Second\n  line<br>goes on</div><aside><p>Side, bar, text</p></aside><div id='comments'><p>A reader, says, things</p></div><footer>F</footer>", "T\nFirst, one & two.\nSecond line goes on"),
    ("<article><header><h1>T</h1><div>by x</div></header><section><p>a, b</p></section><section><ul><li>x</li><li>y</ul></section><div class=ad><p>Buy</p></div><form>f</form><p hidden>no</p></article>", "T\na, b\nx\ny"),
    ("", ""),
    (None, ""),
    ("just text", "just text"),
    ("<script>var a='<p>x</p>';</script><p>y</p><style>p{}</style>", "y"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<p title=\"a>b\">t</p><p 'broken>u</p>", "t\nu"),
]


def test_html(spark):
    df = spark.createDataFrame([(k, f"u{k}", h) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    assert {k: r["text"] for k, r in got.items()} == {k: w for k, (_, w) in enumerate(PAGES)}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract_text(df.filter("false")).collect() == []


class Slow(HTMLParser):
    """The article's blocks by the standard library's parser: what lies in an article, outside of what is never main text."""

    ENDS = {"p": {"p", "h1", "h2", "h3", "ul", "ol", "li", "div", "section", "table", "pre", "blockquote", "article"}, "li": {"li"}, "td": {"td", "tr"}, "tr": {"tr"}}
    BLOCKS = set("p h1 h2 h3 h4 h5 h6 ul ol li div section table tr td th pre blockquote article main body html dl dt dd figure figcaption".split())
    OUT = set("nav footer aside form script style header".split())

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.line = [], [], []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.line).split()):
            self.blocks.append(text)
        self.line = []

    def inside(self):
        names = [n for n, _ in self.open]
        return "article" in names and not self.OUT & set(names) and not any(c in ("ad", "comments") for _, c in self.open)

    def handle_starttag(self, tag, attrs):
        if self.open and tag in self.ENDS.get(self.open[-1][0], ()):
            self.flush()
            self.open.pop()
        if tag in self.BLOCKS:
            self.flush()
        if tag == "br":
            self.line.append(" ")
        elif tag not in ("meta", "link", "img", "hr", "input"):
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        names = [n for n, _ in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if self.inside():
            self.line.append(data)


def test_html_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op9_html_extract"](spark, FOLDER).collect()}
    assert got.keys() == pages.keys()
    for k, html in pages.items():
        assert got[k]["text"] == "\n".join(Slow(html).blocks) and got[k]["n_chars"] == len(got[k]["text"]), k


def test_html_deep_nesting():
    began = time.process_time()
    assert html_text.main_text("<ul><li>" * 20_000) == ""
    assert html_text.main_text("<ul><li>x, y" * 20_000) == "\n".join(["x, y"] * 20_000)
    assert html_text.main_text("<div>" * 20_000 + "</b>" * 20_000 + "deep") == "deep"
    assert time.process_time() - began < 15


def test_html_keeps_inline_content():
    assert html_text.main_text("<p>E=<math><mi>m</mi><mi>c</mi></math>, <svg><text>label</text></svg></p><xmp>a <b> c</xmp>") == "E=mc, label\na <b> c"
    assert html_text.main_text("<article><p>a</p><div class=tags><p>Prose, of its own</p></div><div class=tags><a href=x>t</a></div></article>") == "a\nProse, of its own"


NESTED = [
    ("<div id=content><h1>T</h1><div class=sec><div class=in><p>a, b</p><p>c, d</p><p>e, f</p></div></div><div class=sec><div class=in><p>g, h</p><p>i, j</p></div></div></div>", "T\na, b\nc, d\ne, f\ng, h\ni, j"),
    ("<div id=content><h1>T</h1>" + "<div>" * 7 + "<p>a, b</p><p>c, d</p>" + "</div>" * 7 + "<h2>U</h2>" + "<div>" * 7 + "<p>e, f</p>" + "</div>" * 7 + "</div>", "T\na, b\nc, d\nU\ne, f"),
    ("<div class=page><div class=title><h1>T</h1></div><div class=links><a href=x>One, two</a></div><div class=wrap><div class=in><p>a, b</p><p>c, d</p></div></div></div>", "T\na, b\nc, d"),
    ("<div id=a><div class=sec><div><p>" + "a, b, c, d</p><p>" * 9 + "e</p></div></div><div class=sec><div><p>f</p></div></div><div class=links><ul><li><a href=x>One, two</a></ul></div><p>g</p></div><div id=b><div>Not much</div></div>", "a, b, c, d\n" * 9 + "e\nf\ng"),
    ("<div><x-part><div><p>a, b</p></div></x-part><x-part><div><p>c, d</p></div></x-part></div>", "a, b\nc, d"),
]


@pytest.mark.parametrize("html,text", NESTED)
def test_html_sections_below_wrappers(html, text):
    assert html_text.main_text(html) == text


CLASSED = [
    *((f"<div {c}><h1>T</h1><p>a, b</p><p>c, d</p></div><div class=sidebar><p>e</p></div>", "T\na, b\nc, d") for c in ("class='content has-sidebar'", "class='main-content no-sidebar'", "class='post social-issues'", "id='search-results'", "class='content sidebar'")),
    ("<article><div class='page-header'><h1>T</h1></div><p>a, b</p><p class='notice-text'>c, d</p><p class=ad>e</p></article>", "T\na, b\nc, d"),
    ("<div class='site-header'><h1>S</h1></div><article><div class='entry-header'><h1>T</h1></div><p>a, b</p><article class=comment><p>c</p><article class=comment><p>d</p></article></article></article>", "T\na, b"),
    ("<article class='post has-comments'><p>a, b</p></article><article class='comment-body'><p>c</p></article>", "a, b"),
    *((f"<div class=post><p>a, b</p><p>c, d</p></div><div {c}><p>e, f, g</p></div>", "a, b\nc, d") for c in ("class=sidebar", "class='sidebar-left'", "class='left_sidebar'", "id=ad-slot-2", "class=widget__inner", "role=complementary")),
    ("<div class=post><p>a, b</p></div><div id=comments><p>" + "c, d" * 99 + "</p></div>", "a, b"),
    *((f"<div {c}>" + "x, y" * 99 + "</div><article><h1>T</h1><p>a, b</p></article>", "T\na, b") for c in ("class=ad", "class=sidebar")),
    ("<div class=comments><p>a, b</p></div>", "a, b"),
    ("<article><p>a, b</p><pre><code>x = 1 <span class='token comment'># a note</span>\ny <em class=ad>= 2</em></code></pre></article>", "a, b\nx = 1 # a note y = 2"),
    *((f"<article><p>a, b</p>{o}so <{t} class='{c}'>really</{t}> it is{e}</article>", "a, b\nso really it is") for o, e in (("<p>", "</p>"), ("<pre>", "</pre>"), ("<ul><li>", "</li></ul>"), ("<table><tr><td>", "</td></tr></table>")) for t in ("span", "em", "a") for c in ("comment", "ad", "reply", "consent", "share")),
    ("<article><p>a, b</p><span class=ad><div>c</div></span></article>", "a, b"),
    ("<div class=ad hidden><p>a, b</p></div>", ""),
]


@pytest.mark.parametrize("html,text", CLASSED)
def test_html_furniture_by_class(html, text):
    assert html_text.main_text(html) == text


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    pieces, sequences = {}, {}
    for r in QUERIES["op10_pack"](spark, FOLDER).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, ids.size, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == ids.size
    total = padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.03 * total


def test_encoder_and_plan():
    import pyarrow as pa

    e = packing.encoder(packing.word_tokenizer(), True)
    texts = ["a  b", "it's... O'Neil's Ünï,", "<|endoftext|> x, <|endoftext|>.", "<|ENDOFTEXT|>, y", "é ́x.́", "\x1c.\x1c a\x85b c", "ΑΣ. Σ ΑΣ'S", "", "   ", "$$$ 12,3.5 a\tb\r\nc İ. İx, ", '"word", (x).']
    ids, ends = e.encode(pa.array(texts))
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    random.seed(6)
    for _ in range(200):
        n = random.randint(2, 12)
        at = np.array([0, *sorted(random.sample(range(1, 40), n))])
        if max(np.diff(at)) > 16:
            continue
        cost = np.array([0, *(random.choice((0, 2, 9)) for _ in range(n))])
        got = packing.windows(at, cost, False, 16)
        value = lambda cuts: sum(16 - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(cost[at.tolist().index(c)] for c in cuts)
        plans = ([c for k, c in enumerate(at[1:].tolist()) if m >> k & 1] for m in range(1 << n))
        best = min(value(x) for x in plans if all(b - a <= 16 for a, b in zip([0, *x], [*x, int(at[-1])])))
        assert value(got) == best


def test_encoder_gives_words_to_the_model():
    """Words of letters skip the tokenizer's long way, but for a few by which that is checked, and get its ids, whatever their letters."""
    import pyarrow as pa

    pick = random.Random(3)
    letters = [chr(c) for c in range(0x3000) if chr(c).isalpha()]
    words = list(dict.fromkeys([*letters, *("".join(pick.choices(letters, k=pick.randint(1, 4))) for _ in range(3000)), *("".join(pick.choices("abcdefgh", k=7)) for _ in range(3000))]))
    text = " ".join(words)
    e = packing.Encoder(packing.word_tokenizer())
    whole, seen = e.tokenizer, []
    e.tokenizer = type("Counting", (), {"encode": lambda self, x, **how: seen.append(len(x.split())) or whole.encode(x, **how)})()
    ids, _ = e.encode(pa.array([text]))
    assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert sum(seen) < 0.2 * len(words)


def test_encoder_over_any_slices():
    """Slices that bring no new word, none at all, only digits or signs, or known words with new numbers, in any order and number."""
    import pyarrow as pa

    pick = random.Random(11)
    kinds = [
        lambda: "",
        lambda: "   ",
        lambda: ".",
        lambda: " ".join(str(pick.randrange(1000)) for _ in range(pick.randint(1, 4))),
        lambda: " ".join(pick.choice((".", "?!", "$,", "--", "(x)", "#1")) for _ in range(3)),
        lambda: f"known words {pick.randrange(10**6)}, again.",
        lambda: " ".join("".join(pick.choices("abcdeé", k=pick.randint(1, 6))) + pick.choice(("", ".", ",")) for _ in range(4)),
        lambda: pick.choice(("e\u0301.", "word \u09b9\u09df, word", "\u091c\u095b.", "\ufb33,", "\u0a5a.", "a\u0300\u0323!", "\u0130.", "ΑΣ, ΣΑΣ.")),
    ]
    e = packing.Encoder(packing.word_tokenizer())
    for round_ in range(1000):
        if round_ % 50 == 0:
            e.forget()
        texts = [pick.choice(kinds)() for _ in range(pick.randint(0, 3))]
        ids, ends = e.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, ends[:-1])][: len(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts], texts


def test_encoder_at_letters_that_normalising_takes_apart():
    import unicodedata

    import pyarrow as pa

    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha() and not unicodedata.is_normalized("NFC", chr(c))]
    assert len(letters) > 500
    e = packing.Encoder(packing.word_tokenizer())
    texts = [f"{c}{sign} x{c}{sign}" for c in letters for sign in packing.PUNCTUATION]
    ids, ends = e.encode(pa.array(texts))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_pack_over_many_batches(spark):
    """Several Arrow batches a task, which bring numbers, then known words and new numbers, then nothing new."""
    rows = [(k, ["12 34 56", "some known words", f"known words {k}", ".", "words known"][(k // 500) % 5]) for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        got = packing.pack(df, packing.word_tokenizer()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    tokenizer = packing.encoder(packing.word_tokenizer(), True).tokenizer
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, ids.size, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == ids.size


def test_packing_leaves_no_words_behind(spark, monkeypatch):
    """A worker's encoder outlives its tasks; the words that it has met don't."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "TaskContext", type("Context", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 3)}))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2], pa.int64()), "_text": pa.array(["some words of a text", "and some more"])})
    got = list(packing._packer(packing.word_tokenizer(), 2048, True, pa.int64())(iter([batch])))
    assert sum(x.num_rows for x in got) >= 2 and len(packing.encoder(packing.word_tokenizer(), True).cores) == 1


def test_batches_of_few_bytes(spark):
    """What near_copies() sends to Python at once goes by bytes, and the setting is as it was afterwards."""
    texts = spark.range(0, 3000, numPartitions=1).select(F.repeat(F.lit("x"), 2000).alias("t"))
    rows = lambda: texts.mapInArrow(lambda batches: (b.slice(0, 1).select([]).append_column("n", pa_array([b.num_rows])) for b in batches), "n long").collect()
    from pyarrow import array as pa_array

    with common.batch_bytes(spark, 1 << 20):
        few = [r["n"] for r in rows()]
    assert sum(few) == 3000 and max(few) < 1000
    assert [r["n"] for r in rows()] == [3000]


def test_pack_gets_few_bytes_at_once(spark, monkeypatch):
    """10,000 whole texts in one batch took an executor with two tasks beyond its memory."""
    import pyarrow as pa

    def told(*_):
        return lambda batches: (pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), *[pa.array([b.num_rows], pa.int64())] * 6], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]) for b in batches)

    monkeypatch.setattr(packing, "_packer", told)
    docs = spark.range(0, 3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 8000).alias("text"))
    few = [r["length"] for r in packing.pack(docs, packing.word_tokenizer()).collect()]
    assert sum(few) == 3000 and max(few) < 1000


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_and_empty_tables(spark, odd, stage, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    clash = odd.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    name, run = pipeline.STAGES[stage]
    for docs in (clash, clash.filter("false")):
        out = run(spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == clash.columns or name == "packing"
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    assert rows == []


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = docs
    for name, stage in pipeline.STAGES[:3]:
        new = common.frozen(stage(spark, left, "/root/testdata/sf0.01"), name)
        assert new.columns == docs.columns and 0.7 * left.count() < new.count() <= left.count()
        left = new
    assert left.select(exact_dedup.normalised(F.col("text"))).distinct().count() == left.count()
    assert left.select("doc_id").distinct().count() == left.count()
    assert pipeline.run(spark, FOLDER).count() > 0


def test_pipeline_stages_against_brute_force(spark):
    """Each stage's rows from what its predecessor kept, and run()'s from the last."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    left = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        left = common.frozen(stage(spark, left, FOLDER), name)
        kept.append(left.collect())
    every = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    toxic, exact, near, mixed, packed = kept
    graded = {r["doc_id"]: r["rejected"] for r in QUERIES["op7_toxicity"](spark, FOLDER).collect()}
    assert sorted(r["doc_id"] for r in toxic) == sorted(k for k in every if not graded[k])
    first = {}
    for r in toxic:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        first[text] = min(first.get(text, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(first.values())
    sets = {}
    for r in exact:
        words = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in near} == set(brute_components(ids, linked).values()) and len(near) == len({r["doc_id"] for r in near})
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(spark.createDataFrame(near, spark.read.parquet(f"{FOLDER}/documents.parquet").schema)).collect()}
    assert Counter(r["doc_id"] for r in mixed) == Counter({k: n for k, n in copies.items() if n})
    assert all(r["text"] == every[r["doc_id"]]["text"] for r in mixed)
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    tokens = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in near}
    assert sum(r["length"] for r in packed) == sum(n * len(tokens[k]) for k, n in copies.items())
    for r in packed:
        ids_ = np.array(tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(tokens[r["doc_id"]]), zlib.crc32(ids_.tobytes()))
    rows = lambda rs: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    whole = pipeline.run(spark, FOLDER).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in packed) and {x[0] for x in rows(whole)} == {x[0] for x in rows(packed)}


def test_keep_rows_repeats(spark, odd):
    kept = spark.createDataFrame([(7,), (None,)], "doc_id long")
    out = common.keep_rows(odd, {"doc_id": odd["doc_id"]}, kept, True)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 7]


def test_transpositions():
    for n in (1, 2, 5):
        seen, last = set(), None
        for order, at in filter_audit.transpositions(n):
            if last is not None:
                swapped = list(last)
                swapped[at], swapped[at + 1] = swapped[at + 1], swapped[at]
                assert swapped == order
            last = tuple(order)
            seen.add(last)
        assert len(seen) == len(list(itertools.permutations(range(n))))


def brute_audit(rows, labels):
    """rows: id, text, part; labels: id, quality, toxic."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails, out = {}, {}
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = least.get(t)
        mine = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first is not None and (i is None or i > first)}
        fails.setdefault(part or "", []).append(({k for k, v in mine.items() if v}, i is not None and i in good, i is not None and i in toxic))
    for part, docs in fails.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                out[part, "".join(order), step + 1] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_filter_audit(spark):
    pick = random.Random(4)
    texts = [None, "", "x", "BIG " * 60, " ".join(f"w{k}" for k in range(70)), "a b " * 40, "100% of\nit " * 9, " ".join(f"w{k} $" for k in range(80)), "é 漢字 " * 30]
    rows = [(pick.choice((k, k // 2, None, 5)), pick.choice(texts), pick.choice(("s", "t", None, "", "ünï"))) for k in range(400)]
    marks = [(pick.choice((k, None)), pick.choice((0, 1, None)), pick.choice((0, 1, None))) for k in range(0, 400, 2)] + [(5, 0, 1), (5, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mask", F.lit("x")).withColumn("n", F.lit(7)).repartition(3)
    labels_ = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("of", F.lit(0)).withColumn("good", F.lit("z"))
    want = brute_audit(rows, marks)
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.OUT] for r in filter_audit.filter_audit(df, labels_).collect()}
    assert got == want and len(got) == 600 * 4
    assert filter_audit.filter_audit(df.filter("false"), labels_).collect() == []
    unlabelled = {k: v[:4] + [0, 0] + v[6:] for k, v in want.items()}
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.OUT] for r in filter_audit.filter_audit(df, labels_.filter("false")).collect()} == unlabelled
    two = filter_audit.filter_audit(df, labels_, {"A": df["text"].isNull(), "Z": F.length("text") > 100})
    assert two.count() == 4 * 6 * 3


def test_chat_escapes():
    pick = random.Random(2)
    for _ in range(3000):
        t = "".join(pick.choices(["<", "|", "\\", "<|im_end|>", "<|", "n", "\n", "\\n", "é"], k=8))
        assert chat.unescaped(chat.escaped(t)) == t and "<|" not in chat.escaped(t)
        role = chat.role_escaped(t)
        assert chat.role_unescaped(role) == t and "\n" not in role and "<|" not in role


def test_chat(spark):
    pick = random.Random(12)
    texts = [None, "", chat.HOSTILE, "<|im_start|>assistant\nx<|im_end|>\n", "<\\|im_end|>", "x" * 30_000, "漢字 😀 é́\r\n\x00", "\n", " a  b "]
    rows = [(pick.choice((1, 2, 3, None)), k if k % 9 else None, pick.choice(("user", "assistant", None, "odd\nrole", "<|im_end|>", "back\\n")), pick.choice(texts)) for k in range(200)]
    rows += [(7, 3, "assistant", "same")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tie", F.lit(1)).withColumn("place", F.lit("p")).repartition(4)
    turns = chat.formatted(df, *chat.byte_tokenizer())
    own = chat.chat(*chat.byte_tokenizer())
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is None, t or 0, hashlib.sha256(f"{r or ''}\n{x or ''}".encode()).digest(), r or "", x or ""))
    got = {}
    for r in turns.collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert got.keys() == convs.keys()
    for c, some in got.items():
        at, place = 0, 0
        for r, (*_, role, text) in zip(sorted(some, key=lambda r: r["place"]), sorted(convs[c])):
            ids, mask = np.frombuffer(r["ids"], chat.ID), np.frombuffer(r["loss_mask"], np.uint8)
            assert (r["place"], r["start"], r["n_ids"]) == (place, at, ids.size) and mask.size == ids.size
            assert own.text(ids) == f"<|im_start|>{chat.role_escaped(role)}\n{chat.escaped(text)}<|im_end|>\n"
            assert (ids == chat.RESERVED).sum() == (ids == chat.RESERVED + 1).sum() == 1
            assert chat.unescaped(own.text(ids[mask == 1])) == (text if role == "assistant" else "")
            at, place = at + ids.size, place + 1
    read = {r["conv_id"]: r for r in chat.read_back(turns, *chat.byte_tokenizer(), together=True).collect()}
    for c, some in convs.items():
        said = [(role, text) for *_, role, text in sorted(some)]
        learned = "".join(t for r, t in said if r == "assistant")
        assert read[c]["n_turns"] == len(said) and read[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (read[c]["loss_chars"], read[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    stored = common.frozen(turns.repartition(5), "turns")
    assert {r["conv_id"]: r for r in chat.read_back(stored, *chat.byte_tokenizer()).collect()} == read


def digest_of(values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def brute_tree(nodes, fan):
    """The top, and for each node the others of each run on its way up."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, p in enumerate(paths):
            run = level[at[k] // fan * fan : at[k] // fan * fan + fan]
            p.append(("".join(run[: at[k] % fan]), "".join(run[at[k] % fan + 1 :])))
            at[k] //= fan
        level = [hashlib.sha256("".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
    return level[0], paths


def test_manifest(spark):
    pick = random.Random(6)
    sizes = {None: 9, "": 1, "de": 70, "en": 8, "é": 2, "zz": 3} | {f"l{k}": 1 for k in range(5)}
    rows = [(pick.choice((n, None, n % 7)), lang, pick.choice((None, "", "Text", "text", "ünï 漢"))) for lang, size in sizes.items() for n in range(size)]
    rows += [(3, "de", "Text")] * 4
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("idx", F.lit("x")).withColumn("group", F.lit(1)).repartition(3)
    for fan in (2, 8):
        got = manifest.manifest(df, fields=("doc_id", "lang", "text"), later=lambda c: F.lower(df["text"]) if c == "text" else None, fan_out=fan).collect()
        groups = {}
        for i, lang, text in rows:
            groups.setdefault(lang, []).append((i is None, i or 0, digest_of((i, lang, text)), digest_of((i, lang, text and text.lower()))))
        names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
        trees = {g: brute_tree([x[2] for x in sorted(groups[g])], fan) for g in names}
        root, over = brute_tree([trees[g][0] for g in names], fan)
        want = []
        for g, up in zip(names, over):
            for (none, i, leaf, later), path in zip(sorted(groups[g]), trees[g][1]):
                folded = later
                for left, right in path + up:
                    folded = hashlib.sha256((left + folded + right).encode()).hexdigest()
                proof = hashlib.sha256("".join(a + b for a, b in path + up).encode()).hexdigest()
                want.append((str(None if none else i), str(g), leaf, trees[g][0], root, proof, folded, folded == root))
                assert (leaf == later) == (folded == root)
        assert sorted((str(r["doc_id"]), str(r["lang"]), *(r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in got) == sorted(want)
    one = manifest.manifest(df.filter("lang = ''"), fields=("doc_id", "lang", "text")).collect()
    assert len(one) == 1 and one[0]["root"] == one[0]["leaf"] == one[0]["subroot"] == one[0]["folded_root"] and one[0]["path"] == []


def test_manifest_of_one_hot_group(spark):
    """Repeated rows, all of one group, in range partitions of several tasks: numbered without gaps."""
    df = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit("en").alias("lang"), F.lit("t").alias("text"))
    got = manifest.manifest(df, fields=("doc_id", "lang", "text"))
    assert got.filter("verified").count() == 3000
    assert got.agg(F.count_distinct("root")).first()[0] == 1
    nodes = [digest_of((k, "en", "t")) for k in range(3) for _ in range(1000)]
    assert got.select("root").first()[0] == brute_tree(nodes, 8)[0]
