"""A training corpus from raw documents: five stages, each on all its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again before the next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import langid, packing, pii, simhash, toxicity
from causeway.llm.common import table
from causeway.plans.durable import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.5 or more.

    The classifier is fitted on labels of documents outside the held-out fold.  Null and empty texts score low and stay.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null text, or no letter); the others have the predicted one in ``lang``."""
    return langid.keep_identified(docs, langid.train(docs)).select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays (of repeated rows, one).

    Near duplicates share eight tenths of their five-word shingles at least.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its kind; n_chars follows.  No document is dropped; null texts stay null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    return packing.placements(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("language", language_filter),
    ("near duplicates", near_duplicate_filter),
    ("personal data", redact_personal_data),
    ("packing", pack_windows),
]

#: Fitted models, Unicode-aware tokenizers and packing cannot be said in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
