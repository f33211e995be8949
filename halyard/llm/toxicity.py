"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import frozen, released, text_of

#: Labelled rows that the fit reads at most (in expectation), features that it weighs at most, and documents that a feature needs.
SAMPLE, FEATURES, LEAST = 20_000, 2048, 4
#: A document is rejected if it is of grade 1 or above with this probability: when in doubt, it stays.
REJECT = 0.6
PREFIXES = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The text's words in lower case, and their prefixes, marked by *: inflected words share a stem."""
    words = set(LETTERS.findall(text.lower()))
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in PREFIXES))


class Model:
    """Grades 0..K by P(grade > k) = 1 / (1 + exp(cut[k] - score)); score: the sum of the weights of the features present."""

    def __init__(self, weights: dict[str, float], cuts: list[float]) -> None:
        self.weights, self.cuts = weights, np.asarray(cuts)

    def above(self, text: str) -> np.ndarray:
        score = sum(map(self.weights.get, self.weights.keys() & features(text)))
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -60, 60)))


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch, how many rows and toxic rows have each feature."""
    for frame in frames:
        every, bad = Counter(), Counter()
        for toxic, text in zip(frame["toxic"], frame["_text"]):
            found = features(text)
            every.update(found)
            if toxic:
                bad.update(found)
        yield pd.DataFrame({"f": list(every), "n": list(every.values()), "t": [bad[f] for f in every]})


def _placed(place: dict[str, int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "found": [np.array(sorted(place[f] for f in features(x) & place.keys()), np.int32) for x in frame["_text"]]})

    return run


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n: int, penalty: float = 2e-4, rounds: int = 400, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts: the likelihood of a proportional-odds model, with an absolute-value penalty, by accelerated proximal gradients with Adam's scaling."""
    top, m = int(grades.max(initial=0)), len(rows)
    flat = np.concatenate(rows).astype(np.int64) if m else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(m), [r.size for r in rows])
    share = np.array([np.clip((grades > k).mean(), 1e-4, 1 - 1e-4) for k in range(top)])
    weights, first, gaps = np.zeros(n), -np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2))
    theta = np.concatenate((weights, [first], gaps))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, cuts = theta[:n], theta[n] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n + 1 :]))))
        score = np.bincount(owner, w[flat], m)
        up = 1 / (1 + np.exp(np.clip(np.concatenate((np.full((1, m), -60.0), cuts[:, None] - score[None], np.full((1, m), 60.0))), -60, 60)))  # P(grade >= k)
        here = np.maximum(up[grades, np.arange(m)] - up[grades + 1, np.arange(m)], 1e-12)
        slope = up * (1 - up)
        d_score = -(slope[grades, np.arange(m)] * (grades > 0) - slope[grades + 1, np.arange(m)] * (grades < top)) / here / m
        d_cut = np.array([((slope[k + 1] / here)[grades == k + 1].sum() - (slope[k + 1] / here)[grades == k].sum()) / m for k in range(top)])
        grad = np.concatenate((np.bincount(flat, d_score[owner], n), [d_cut.sum()], np.exp(theta[n + 1 :]) * (d_cut.sum() - np.cumsum(d_cut))[: max(0, top - 1)]))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        step = rate * min(1, 4 * (1 - t / (rounds + 1))) / (np.sqrt(square / (1 - 0.999**t)) + 1e-4)
        theta = theta - step * mean / (1 - 0.9**t)
        theta[:n] = np.sign(theta[:n]) * np.maximum(np.abs(theta[:n]) - penalty * step[:n], 0)
    return theta[:n], theta[n] + np.concatenate(([0.0], np.cumsum(np.exp(theta[n + 1 :]))))


def _part(hashes: Column, share: float) -> Column:
    """Whether a hash is among a share of all, however small: 2^62 steps."""
    return F.pmod(hashes, F.lit(2**62)) < F.lit(int(2**62 * share))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most about `sample` labelled rows, chosen by hashes of id and text, whatever the tables' sizes.

    labels.toxic is 0 or 1; other rows, those without an id, and documents that are labelled both ways are left out; rows with equal id and
    text are one. Toxic rows get grades 1 to 3 by how many of the features that set toxic rows apart they hold, cut at the thirds of
    the sample. Without labels of both kinds every document gets grade 0. The sample is read from the documents once.
    """
    given = labels.select(labels[id_col].alias("_key"), labels["toxic"].cast("int").alias("_toxic")).filter("_toxic in (0, 1) and _key is not null")
    known = given.groupBy("_key").agg(F.min("_toxic").alias("toxic"), F.max("_toxic").alias("_most")).filter("toxic = _most").select("_key", "toxic")
    n = known.count()
    if n > sample:
        known = known.filter(_part(F.xxhash64("_key"), sample / n))
    # The sample is bounded (about 20,000 rows of 16 bytes), so it may be broadcast; no text but the sample's is shuffled.
    own = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text"))
    texts = own.join(F.broadcast(known), F.col("_id") == F.col("_key")).select("_id", "toxic", "_text", F.xxhash64("_id", "_text").alias("_h"))
    texts = frozen(texts.groupBy("_h").agg(F.first("toxic").alias("toxic"), F.first("_text").alias("_text")), "labelled")
    table = texts
    found = texts.count()
    if found > sample:  # many documents with one id
        texts = texts.filter(_part(F.col("_h"), sample / found))
    counts = texts.mapInPandas(_counted, "f string, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    sizes = dict(texts.groupBy("toxic").count().collect())
    clean, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not bad:
        released(table)
        return Model({}, [60.0])
    odds = F.log((F.col("t") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1.0))
    gain = F.abs(odds) * F.sqrt(F.least(F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5) + F.col("n"))
    listed = counts.filter((F.col("n") >= LEAST) & (F.abs(odds) > 1)).select("f", odds.alias("odds"), gain.alias("gain"), "t", "n").orderBy(F.desc("gain"), "f").limit(FEATURES).collect()
    place = {r["f"]: i for i, r in enumerate(listed)}
    got = texts.mapInPandas(_placed(place), "toxic int, found array<int>").toPandas()  # bounded: sample rows of a few hundred numbers
    released(table)
    toxic, rows = got["toxic"].to_numpy(), [np.asarray(x, np.int64) for x in got["found"]]
    strong = np.array([r["odds"] > 3 and r["t"] >= max(LEAST, bad // 100) for r in listed])
    hits = np.array([strong[r].sum() for r in rows])
    thirds = np.unique(np.quantile(hits[toxic == 1], [1 / 3, 2 / 3]))
    raw = np.where(toxic == 1, 1 + np.searchsorted(thirds, hits, side="left"), 0)
    grades = np.unique(raw, return_inverse=True)[1]  # grades that no row has are closed up
    weights, cuts = fit_ordinal(rows, grades, len(listed))
    return Model({f: float(weights[i]) for f, i in place.items() if weights[i]}, cuts.tolist())


def scored(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column: struct of severity (the expected grade), p_toxic (of grade 1 or above) and grade (the likeliest)."""

    @F.pandas_udf("severity double, p_toxic double, grade int")
    def score(texts: pd.Series) -> pd.DataFrame:
        up = np.array([model.above(x) for x in texts]).reshape(len(texts), -1)
        each = -np.diff(np.concatenate((np.ones((len(texts), 1)), up, np.zeros((len(texts), 1))), axis=1), axis=1)
        return pd.DataFrame({"severity": up.sum(1), "p_toxic": up[:, 0], "grade": each.argmax(1).astype(np.int32)})

    return score(text_of(docs, text_col))


def severities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: <id_col>, severity, grade, p_toxic, rejected.

    The model (a few hundred weights) goes to the tasks with the code; a document is scored by itself, whole, in one pass without a
    shuffle. A null text is empty, and an empty text gets the grades' base rates. Repeated rows get equal results.
    """
    at = docs.select(docs[id_col], scored(docs, train(docs, labels, id_col, text_col), text_col).alias("_s"))
    return at.select(id_col, F.round("_s.severity", 6).alias("severity"), "_s.grade", F.round("_s.p_toxic", 6).alias("p_toxic"), (F.col("_s.p_toxic") >= REJECT).alias("rejected"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rejected rows; the same columns, repeated rows and order of columns included.

    A null or empty text gets the grades' base rates, so it stays unless most labelled rows are toxic; without labels of both kinds every
    row stays. Repeated rows stay or go together, a probability of just REJECT goes, and an empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col)
    return docs.filter(scored(docs, model, text_col)["p_toxic"] < REJECT)


def op7_toxicity(spark, sf_dir):
    return severities(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
