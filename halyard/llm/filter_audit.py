"""How filters work together: what each removes in every order, by adjacent transpositions over cells of failure masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import SPACES, frozen, released, text_of

#: Parts whose orders a task walks through at once; 600 rows come of each.
PARTS = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n", "good", "toxic")
OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: The filter that is about other rows: a text that a smaller id has too. It comes last among the letters.
REPEATED = "E"


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of whole texts by letter: short, few different words, many capitals, special signs."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")  # white space at an end leaves an empty one
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def transpositions(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of 0..n-1, each after one swap of neighbours, and the place of the swap's first (None at the start).

    The largest item that can move in its direction moves; those above it turn round.
    """
    order, step = list(range(n)), [-1] * n
    yield order, None
    while True:
        for item in range(n - 1, -1, -1):
            at = order.index(item)
            to = at + step[item]
            if 0 <= to < n and order[to] < item:
                break
            step[item] = -step[item]
        else:
            return
        order[at], order[to] = order[to], order[at]
        yield order, min(at, to)


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of n filters, and for each part, order and step the counts of OUT.

    cells: parts x 2**n masks x COUNTS. alive[p] counts what fails none of the filters of p, so what filter x removes behind them is
    alive[p] - alive[p with x]. A swap of neighbours changes what its two steps remove, and what is kept between them; all else stays.
    """
    alive = cells.copy()
    for bit in range(n):  # sums over all masks inside a mask's complement
        shaped = alive.reshape(alive.shape[0], -1, 2, 1 << bit, alive.shape[2])
        shaped[:, :, 1] += shaped[:, :, 0]
    alive = alive[:, ::-1]
    fails = np.stack([alive[:, 0, 0] - alive[:, 1 << f, 0] for f in range(n)], 1)
    unique = np.stack([cells[:, 1 << f, 0] for f in range(n)], 1)
    removed = np.zeros((cells.shape[0], n, cells.shape[2]), np.int64)  # by step
    kept = np.zeros((cells.shape[0], n), np.int64)
    shapley = np.zeros((cells.shape[0], n), np.int64)
    mine = np.zeros((cells.shape[0], n), np.int64)  # by filter
    orders, out = [], []
    for order, swapped in transpositions(n):
        steps = range(n) if swapped is None else (swapped, swapped + 1)
        before = sum(1 << f for f in order[: steps[0]])
        for k in steps:
            after = before | 1 << order[k]
            removed[:, k] = alive[:, before] - alive[:, after]
            kept[:, k] = alive[:, after, 0]
            mine[:, order[k]] = removed[:, k, 0]
            before = after
        shapley += mine
        orders.append(tuple(order))
        out.append(np.stack([kept, removed[:, :, 0], fails[:, order] - removed[:, :, 0], unique[:, order], removed[:, :, 1], removed[:, :, 2]], 2))
    rows = np.stack(out, 1)
    total = np.stack([shapley[:, list(o)] for o in orders], 1)
    return orders, np.concatenate([rows, total[..., None]], 3)


def _walked(letters: str):
    n = len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                some = batch.slice(at, PARTS)
                cells = np.zeros((some.num_rows, 1 << n, len(COUNTS)), np.int64)
                for k, found in enumerate(some.column("cells").to_pylist()):
                    for c in found:
                        cells[k, c["mask"]] = [c[x] for x in COUNTS]
                orders, counts = walk(cells, n)
                names = ["".join(letters[f] for f in o) for o in orders]
                each = counts.reshape(-1, len(OUT))
                columns = [
                    some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), len(orders) * n))),
                    pa.array(np.tile(np.repeat(np.array(names, object), n), some.num_rows), pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1), len(orders) * some.num_rows), pa.int32()),
                    *(pa.array(each[:, k]) for k in range(len(OUT))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *OUT])

    return run


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail (bit k: the k-th letter; the last: REPEATED), among them those labelled so.

    Equal rows are counted in their tasks before anything is shuffled, and no step meets by text alone, so neither a text nor a row that a
    third of all share goes to one task. Texts are equal if their SHA-256, length and a second hash are.
    """
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    text = text_of(docs, text_col)
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("check"))
    same = ["digest", "bytes", "check"]
    rows = frozen(own.groupBy("id", "part", "mask", *same).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.groupBy(*same).agg(F.min("id").alias("first"))
    told = F.coalesce(labels["quality"] == 1, F.lit(False)).alias("good"), F.coalesce(labels["toxic"] == 1, F.lit(False)).alias("toxic")
    flags = labels.select(labels[id_col].alias("of"), *told).filter("of is not null and (good or toxic)").groupBy("of").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Null ids have no label; a second key spreads them.
    salt = F.when(F.isnull("id"), F.xxhash64(*same)).otherwise(F.lit(0))
    told_rows = rows.withColumn("salt", salt).join(flags.withColumn("salt_of", F.lit(0).cast("long")), (F.col("id") == F.col("of")) & (F.col("salt") == F.col("salt_of")), "left")
    seen = told_rows.select("id", "part", "mask", *same, "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    least = first.select(*[F.col(c).alias(f"{c}_of") for c in same], "first", F.lit(True).alias("leads"))
    leading = F.col("id").eqNullSafe(F.col("first"))
    for c in same:
        leading = leading & (F.col(c) == F.col(f"{c}_of"))
    judged = seen.join(least, leading, "left")
    bit = F.when(F.col("leads"), 0).otherwise(1 << len(filters))
    some = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    cells = frozen(judged.groupBy("part", (F.col("mask") + bit).alias("mask")).agg(F.sum("n").alias("n"), some("good"), some("toxic")), "audit-cells")
    released(rows)
    return cells


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per part, order of the filters and step, zeros included: part, filter_order, step, and the counts of OUT within the part.

    filters: up to seven failure conditions by letter (standard_filters() by default) on columns of docs; REPEATED is added, which a row fails if a smaller id has
    its text, wherever. labels: <id_col>, quality, toxic; an id counts as good or toxic if any of its rows says 1. kept: after the
    step; removed: at it; redundant: failing its filter, but removed before; unique_fails: failing its filter alone; good_lost, toxic_lost: removed
    with that label; shapley: what its filter removes, summed over all orders.

    A null text is empty, a null part the empty string. A null id is larger than all others and has no label; null ids have no order among
    them. Repeated rows are documents of their own, none smaller than the other. An empty table gives no rows. A part's cells, 2**filters at most, are
    all that its orders are walked by.
    """
    filters = standard_filters(text_of(docs, text_col)) if filters is None else filters
    cells = mask_cells(docs, labels, filters, id_col, text_col, part_col)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return parts.mapInArrow(_walked("".join(filters) + REPEATED), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUT))


def op11_filter_audit(spark, sf_dir):
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CAST(len(words) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(w.doc_id > least, least IS NOT NULL) AS INTEGER) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (SELECT o, CAST(s AS INTEGER) AS step, o[s] AS letter, CAST(1 << (ascii(o[s]) - 65) AS INTEGER) AS bit, CAST(coalesce(list_sum(list_transform(range(1, s), lambda k: 1 << (ascii(o[k]) - 65))), 0) AS INTEGER) AS before FROM orders, range(1, 6) AS r(s)),
counts AS (SELECT part, o AS filter_order, step, letter,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, o, step, letter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counts
"""
