"""From raw documents to packed batches: each stage works on all rows that the one before kept.

All stages but the last return the columns of ``documents``; the last returns each document's place in a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.exact_dedup import exact_dedup
from timberline.llm.jaccard_join import one_of_each_class
from timberline.llm.packing import pack, token_count
from timberline.llm.substring_dedup import substring_dedup
from timberline.llm.tables import stash, table
from timberline.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose likeliest severity is a grade above 0 go."""
    return toxicity(docs, table(spark, sf_dir, "labels")).filter("not toxic").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest id stays."""
    return exact_dedup(docs).filter("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-copy links connect, the one of the least id stays."""
    return one_of_each_class(docs).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, words joined by one space, without passages that occur twice; n_chars follows the text."""
    cut = substring_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets of least padding, filled with token-budget batches."""
    return pack(docs.select("doc_id", token_count().alias("n_tokens")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack_batches),
]
#: Learned weights and searches by hash have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
