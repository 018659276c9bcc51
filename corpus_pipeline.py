"""A training corpus in five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir). ``run`` writes each result to the
shared folder and reads it back for the next stage. Documents of a language
that can't be told go, copies and near copies go down to one document each,
sources are mixed to their target weights, and the last stage packs the
rest into sequences. Null and empty texts are rejected by the first stage. An
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, langid, mixing, ngram_join, packing
from graphloom.llm._common import materialize

#: Rows that a stage hands to Python at a time: with whole texts, batches of the default size take hundreds of MB of an executor.
ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Bound the memory of batches, for this application's session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, min(ROWS, now) if now > 0 else ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (6); the model learns from the labelled rows of ``docs``."""
    prepare(spark)
    return langid.keep_identified(docs, langid.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (8)."""
    prepare(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (2)."""
    prepare(spark)
    return ngram_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (5)."""
    prepare(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens (9)."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bin_packing", pack_sequences),
]

#: SQL can't express the trained model, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
