"""Cleaning of a corpus: toxic documents go, then repeated lines, near copies and repeated passages; what is left is packed."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoquarry.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from repoquarry.llm.queries import WORD_TOKENIZER
from repoquarry.llm.tables import written

TOXIC = 0.3
"""Documents with this score or more are rejected."""


def _like_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`; `n_chars` is that of the text as it is now."""
    return changed.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


BATCH_ROWS = 2000
"""Whole texts pass between Spark and Python in batches of so many rows; both sides hold some batches at a time."""


def _in_small_batches(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the others stay as they are."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, model, score="_toxicity")
    return scored.filter(F.col("_toxicity") < TOXIC).select(*docs.columns)


@_in_small_batches
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, if need be with an empty text."""
    return _like_documents(line_dedup.dedup_lines(docs), docs)


@_in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return near_dedup.keep_one(docs).select(*docs.columns)


@_in_small_batches
def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds go; every document stays."""
    return _like_documents(substring_dedup.dedup_substrings(docs), docs)


@_in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.pack_documents(docs, WORD_TOKENIZER, capacity=4096, end_id=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_passages),
    ("packing", pack_sequences),
]

ORACLE_SQL = None
"""Scores, signatures and the plan of the packing have no SQL; tests compare with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`; what a stage returns is stored and read by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"after-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
