"""The corpus pipeline: documents to packed training sequences.

Stages in order: toxic documents go, repeated lines go, one document of each near-duplicate group
stays, and what is left is packed. Every stage reads all that the one before it kept, written as
Parquet in the shared checkpoint folder; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import line_dedup, packing, simhash_dedup, toxicity
from ledgerlens.llm.tables import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows outside the held-out fold, doesn't reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less non-empty lines that occur earlier (from 20 characters on up to 2 edits); documents
    of which nothing is left go."""
    return line_dedup.drop_repeating(docs, k=2, min_chars=20, equal_chars=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash class (3-word shingles, 3 bits)."""
    return simhash_dedup.keep_one_of_each(docs, shingle=3, radius=3)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: A learned classifier, hash votes and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
