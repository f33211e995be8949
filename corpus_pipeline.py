"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halyard.llm.common import frozen, released
from halyard.llm.exact_dedup import drop_exact_copies
from halyard.llm.mixing import mix
from halyard.llm.packing import pack, word_tokenizer
from halyard.llm.simhash import drop_near_copies
from halyard.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model is fitted on the labels of the table folder, less those without an id, without 0 or 1, or of both kinds.

    A null or empty text is scored without features, by the base rates. Repeated rows share their fate. Without labels all stay; an empty table stays one.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, that with the smallest id; null ids come last, null texts are empty, and of repeated rows one stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (sets of five-word shingles with a similarity of 0.8 or more, directly or over others) the one with the smallest id stays.

    Null ids come last; null and empty texts are equal; of repeated rows one stays.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times. A null source is one of its own, the last; a null text has size 0; a null id only affects the order."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence. A null or empty text has one piece, its end; null and repeated ids are packed like any others."""
    return pack(docs, word_tokenizer())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Models, fingerprints and token ids can't be expressed in SQL. tests/llm holds every stage's rows against brute force on what the stage before kept, but
#: for the first, whose model is judged by its accuracy on labels held out.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are a table in the shared folder, which goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = frozen(stage(spark, docs, sf_dir), f"pipeline-{name}", codec="snappy")
        if before is not None:
            released(before)
        before = docs
    return docs
