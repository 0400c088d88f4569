"""The corpus pipeline: quality, near duplicates, personal data, mixture of sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the
last return the columns of ``documents``. :func:`run` writes each stage's rows as Parquet in the
shared folder and reads them again, so that a lost executor repeats part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import mil_quality, mixing, near_copies, packing, pii
from claimweave.llm.common import table, work_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model, learned from ``labels``, scores at least 0.5."""
    return mil_quality.keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id."""
    return near_copies.keep_one_of_each_group(docs).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data."""
    replaced = pii.pseudonymise(docs.select(COLUMNS))
    return replaced.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources have equal shares of as many rows as there are."""
    return mixing.mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs).drop("row_key")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: A fitted model and tokens are beyond SQL: the tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
