"""Corpus preparation in four stages: language, near-duplicates, source mixture, packed sequences.

Each stage takes the documents its predecessor kept and returns documents with the same columns;
the last returns the packed pieces. Columns beyond doc_id, text, lang and source ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arborscan.llm import langid, mixing, neardup, packing, tokens
from arborscan.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those of null text or without a letter go. Labelled documents teach the model."""
    named = langid.predict(docs, langid.train(docs), names=("_language", "_language_score"))
    return named.where(F.col("_language") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every near-duplicate group: five-word shingles, similarity of at least 0.8.

    Documents without an id stay; rows that repeat an id stay or go together.
    """
    kept = neardup.groups(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct().hint("shuffle_hash")
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed by temperature: every one at least once, no source repeated more than twice; copies are rows."""
    whole = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n_tokens"), F.struct(*docs.columns).alias("document"))
    return mixing.mix(whole, "n_tokens").select("document.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all copies, in sequences of 2,048 ids."""
    return packing.pack_documents(docs, tokens.public())


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packed),
]

#: Language identification and tokens cannot be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
