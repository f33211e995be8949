"""A Merkle manifest of a dataset: levels by windows, proofs of every row, and what becomes of them when rows change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.common import frozen, released

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "g long, idx long, of long, hash binary"
_STEP = "array<struct<left:string,right:string>>"


def _digest(preimage: Column) -> Column:
    return F.sha2(preimage.cast("binary"), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(values: list[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 length, a colon and itself, or - if null, so no two rows have one preimage."""
    texts = [v.cast("string") for v in values]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _numbered(leaves: DataFrame) -> DataFrame:
    """leaves with g, the number of their group (null first, bytewise), and their idx among its `of` rows, by id (null last), then digest.

    No window runs over a whole group: range partitions are frozen, and each one's rows of a group are counted, numbered and offset. Equal
    rows, even a third of all, are told apart by their number in the table, so they too are dealt to several partitions.
    """
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_last(), F.col("leaf"), F.col("row")]
    parts = frozen(leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "manifest-order")
    count = parts.groupBy("part", "group").agg(F.count(F.lit(1)).alias("n"))
    by_group = Window.partitionBy("group").orderBy("part")  # a row per partition that has some of it
    known = count.withColumn("before", F.coalesce(F.sum("n").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = frozen(known.withColumn("of", F.sum("n").over(by_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "manifest-groups")
    starts = known.filter("before = 0")  # a group's number is that of the groups that begin before it
    begun = starts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    begun = begun.select(F.col("part").alias("begins"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("groups"))  # a row per partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("group").asc_nulls_first())) - 1
    named = starts.withColumn("nth", nth).join(begun, F.col("part") == F.col("begins")).select(F.col("group").alias("group_of"), (F.col("groups") + F.col("nth")).alias("g"))
    offsets = known.join(named, F.col("group").eqNullSafe(F.col("group_of"))).select(F.col("part").alias("part_of"), "group_of", "g", "of", "before")
    inside = F.row_number().over(Window.partitionBy("part", "group").orderBy(*order[1:])) - 1
    placed = parts.withColumn("inside", inside).join(offsets, (F.col("part") == F.col("part_of")) & F.col("group").eqNullSafe(F.col("group_of")))
    out = frozen(placed.select("g", (F.col("before") + F.col("inside")).alias("idx"), "of", F.col("leaf").alias("hash"), "id", "group", "later"), "manifest-leaves")
    released(parts, known)
    return out


def _runs(nodes: DataFrame, fan_out: int) -> DataFrame:
    """nodes with their parent's number and its run of digests, in order."""
    full = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("parent", F.expr(f"idx div {fan_out}")).withColumn("run", F.collect_list(_hex(F.col("hash"))).over(full))


def _climbed(nodes: DataFrame, fan_out: int) -> list[DataFrame]:
    """The levels from nodes (g, idx, of, hash) up to that where every group has one node. Of each run the first node, which has all of it, gives the parent."""
    levels, most = [nodes], nodes.agg(F.max("of")).first()[0] or 0
    while most > 1:
        first = _runs(levels[-1].select("g", "idx", "of", "hash").filter("of > 1"), fan_out).filter(f"idx % {fan_out} = 0")
        up = first.select("g", F.col("parent").alias("idx"), F.expr(f"(of + {fan_out - 1}) div {fan_out}").alias("of"), F.unhex(_digest(F.array_join("run", ""))).alias("hash"))
        levels.append(frozen(up, "manifest-level"))
        most = -(-most // fan_out)
    return levels


def _proven(levels: list[DataFrame], tops: DataFrame, fan_out: int, keep: list[str]) -> DataFrame:
    """The rows of the lowest level with path, the run's others left and right of the way up at each level, the nearest first, and the columns keep of tops.

    tops: g, path and keep, of each group's single node. Paths come down level by level, each joined on group and parent. They are long for their number and
    shrink in shuffles, so no size that Spark sees tells whether they could be broadcast; runs are sorted by these keys anyway, so both sides are merged.
    """
    above = None
    step = F.struct(F.array_join(F.slice("run", F.lit(1), F.col("at")), "").alias("left"), F.array_join(F.slice("run", F.col("at") + 2, F.lit(fan_out)), "").alias("right"))
    for nodes in reversed(levels):
        rest = [c for c in nodes.columns if c != "hash"] + ["hash"]
        single = nodes.filter("of = 1").join(tops.hint("merge"), "g").select(*rest, "path", *keep)
        if above is None:
            above = single
            continue
        runs = _runs(nodes.filter("of > 1"), fan_out).withColumn("at", (F.col("idx") % fan_out).cast("int"))
        over = above.select(F.col("g").alias("g_of"), F.col("idx").alias("parent_of"), F.col("path").alias("upper"), *keep)
        many = runs.join(over.hint("merge"), (F.col("g") == F.col("g_of")) & (F.col("parent") == F.col("parent_of"))).select(*rest, F.concat(F.array(step), F.col("upper")).alias("path"), *keep)
        above = many.unionByName(single)
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, later: Callable[[str], Column] | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """A row per row of docs: <id_col>, <group_col>, leaf, subroot, root, proof_sha256, path (structs of left and right), folded_root, verified.

    A row's leaf is leaf() of its fields. Per group, leaves ascend by id; while there are several nodes, each fan_out in line (at the end: fewer,
    even one) become the digest of their digests, as hex text end to end; what remains is the subroot, a lone leaf itself. Subroots, by group, likewise give the
    root. path holds the others of each run on the way to the root, proof_sha256 is the digest of them all. later: by a field's name, its
    value when the row is checked (None: the same); folded_root is what that row's leaf and the path lead to, verified whether that is the root.

    Null ids come last, ties in the order of their digests; repeated rows are leaves of their own, a null group is one of its own, the first. Null
    values are told from empty ones. An empty table gives no rows. No task holds a group: windows are over runs, ranks over range partitions.
    """
    now = leaf([docs[c] for c in fields])
    then = now if later is None else leaf([later(c) if later(c) is not None else docs[c] for c in fields])
    own = docs.select(docs[id_col].alias("id"), docs[group_col].alias("group"), F.unhex(now).alias("leaf"), F.unhex(then).alias("later"), F.monotonically_increasing_id().alias("row"))
    leaves = frozen(own, "manifest-rows")
    placed = _numbered(leaves)
    released(leaves)
    levels = _climbed(placed, fan_out)
    tops = levels[0].filter("of = 1").select("g", "hash")
    for nodes in levels[1:]:
        tops = tops.union(nodes.filter("of = 1").select("g", "hash"))
    tops = frozen(tops, "manifest-subroots")
    groups = tops.count()
    over = _climbed(tops.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(groups).cast("long").alias("of"), "hash"), fan_out)
    root = over[-1].select(_hex(F.col("hash"))).first()  # one row, none for an empty table
    end = docs.sparkSession.range(1).select(F.col("id").alias("g"), F.lit(None).cast(_STEP).alias("path")).select("g", F.coalesce("path", F.array().cast(_STEP)).alias("path"))
    subroots = _proven(over, end, fan_out, []).select(F.col("idx").alias("g"), "path", _hex(F.col("hash")).alias("subroot"))
    found = _proven(levels, subroots, fan_out, ["subroot"])
    others = F.concat(F.array(F.lit("")), F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = F.aggregate("path", _hex(F.col("later")), lambda digest, s: _digest(F.concat(s["left"], digest, s["right"])))
    rows = found.select("id", "group", _hex(F.col("hash")).alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), _digest(F.array_join(others, "")).alias("proof_sha256"), "path", folded.alias("folded_root"))
    return rows.select(F.col("id").alias(id_col), F.col("group").alias(group_col), "leaf", "subroot", "root", "proof_sha256", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = F.crc32(docs["doc_id"].cast("string")) % 3 == 0
    lower = F.when(changed, F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(docs["text"])
    return manifest(docs, later=lambda field: lower if field == "text" else None).drop("lang", "path")


def _sql(levels: int = 8, over: int = 4) -> str:
    """DuckDB SQL for up to 8**levels documents of a language and 8**over languages."""
    field = lambda c, x=None: f"coalesce(strlen({x or f'CAST({c} AS VARCHAR)'}) || ':' || {x or f'CAST({c} AS VARCHAR)'}, '-')"
    pre = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field("text", text)]) + ")"
    tree = lambda name, k, g: f"{name}{k} AS (SELECT {g}idx // 8 AS idx, (of + 7) // 8 AS of, sha256(string_agg(hash, '' ORDER BY idx)) AS hash, list(hash ORDER BY idx) AS run FROM {name}{k - 1} WHERE of > 1 GROUP BY ALL)"
    up = [tree("n", k, "lang, ") for k in range(1, levels + 1)]
    top = " UNION ALL ".join(f"SELECT lang, hash FROM n{k} WHERE of = 1" for k in range(levels + 1))
    more = [tree("s", k, "") for k in range(1, over + 1)]
    root = " UNION ALL ".join(f"SELECT hash FROM s{k} WHERE of = 1" for k in range(over + 1))
    joins = [f"LEFT JOIN n{k} ON n{k}.lang IS NOT DISTINCT FROM n0.lang AND n{k}.idx = n0.idx // {8**k}" for k in range(1, levels + 1)]
    joins += ["JOIN s0 ON s0.lang IS NOT DISTINCT FROM n0.lang", *(f"LEFT JOIN s{k} ON s{k}.idx = s0.idx // {8**k}" for k in range(1, over + 1))]
    runs = [(f"n{k}.run", f"n0.idx // {8 ** (k - 1)} % 8") for k in range(1, levels + 1)] + [(f"s{k}.run", f"s0.idx // {8 ** (k - 1)} % 8") for k in range(1, over + 1)]
    path = ", ".join(f"CASE WHEN {r} IS NULL THEN NULL ELSE {{'l': array_to_string({r}[1:{p}], ''), 'r': array_to_string({r}[{p} + 2:], '')}} END" for r, p in runs)
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], repeat([0::BIGINT], 8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS code FROM documents, t),
n0 AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, hash) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS of, hash, later
       FROM (SELECT lang, doc_id, {pre("text")} AS hash, {pre("CASE WHEN code % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS later FROM d)),
{", ".join(up)},
top AS ({top}),
s0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS of, hash FROM top),
{", ".join(more)},
root AS ({root}),
p AS (SELECT n0.doc_id, n0.hash AS leaf, n0.later, s0.hash AS subroot, root.hash AS root, list_filter([{path}], lambda x: x IS NOT NULL) AS path FROM n0 {" ".join(joins)}, root),
f AS (SELECT *, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
      list_reduce(list_concat([{{'l': later, 'r': ''}}], path), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


SQL = _sql()
