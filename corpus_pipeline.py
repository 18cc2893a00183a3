"""From raw documents to packed sequences, in stages that each read what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Run stage by stage, each result is written
and read again; ``run`` applies them in one go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language_id, minhash_dedup, mixing, packing, pii
from quillon.session import table


#: The score that says which language a document has: less than two fifths are as much of others.
LANGUAGE_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    A text goes that is null or has no letter, is in letters of no learned language, or
    has no main one among them: the best one's share of all positions is below ``LANGUAGE_SCORE``.
    """
    return language_id.keep_known(docs, language_id.learn(docs), LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a fifth of the word shingles may differ."""
    return minhash_dedup.keep_one(docs, percent=80, size=5)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts and the length to match."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids, with their ids."""
    return packing.pack(docs, 1024)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("pii", redact_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language, trees and token ids are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
