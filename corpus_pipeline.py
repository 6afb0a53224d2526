"""From raw documents to packed training sequences: quality, exact and near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import exact_dedup, mixing, near_dedup, packing, quality
from llm.common import read_table, staged


def _sparing(spark: SparkSession) -> None:
    """Batches of few bytes between Spark and Python: stages of all kinds follow one another in the same executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good, all columns as they were.

    Null and empty texts are scored as one empty line; equal rows stay or go together; without
    labels of both kinds all documents stay; an empty table stays empty.
    """
    _sparing(spark)
    return quality.good_only(docs, read_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then that of the smallest doc_id (null last).

    Null texts are empty; of rows that share doc_id and text one stays; an empty table stays empty.
    """
    _sparing(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id (null last).

    Null texts are empty; texts of one word or none are near copies of equal ones only; of rows
    that share doc_id and text one stays; an empty table stays empty.
    """
    _sparing(spark)
    return near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, copies as rows of their own.

    Null and empty texts are drawn like the others of their source, though they add no words; null
    source is a source; rows that share a doc_id, or have none, are drawn by their texts; an empty table stays empty.
    """
    _sparing(spark)
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; each row is packed, repeated ones and null texts too."""
    _sparing(spark)
    return packing.pack(docs, with_ids=True, cache_words=WORKER_WORDS)


#: Words that a packing worker remembers: few, as the other stages share its executor.
WORKER_WORDS = 200_000
#: Bytes of one batch on its way to a Python worker.
BATCH_BYTES = 4 << 20

STAGES = [
    ("quality classifier", filter_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, order MinHash or the tokenizer; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
