"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns a DataFrame, which is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tangency.llm import language, mixing, packing, simhash, substrings
from tangency.llm.common import shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents without a letter or a recognised language go.

    Learns from the rows that have a lang. A null or empty text goes; a null
    doc_id, source or lang stays, as do repeated rows; without any labelled
    row every document goes. An empty table stays empty.
    """
    return language.with_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near-duplicates the document of the least doc_id stays.

    Nulls come last, ties go to the text of least hash, and of equal rows one
    stays; no group loses its last row. Null and empty texts are one group.
    """
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: bytes of 200-byte strings found elsewhere are cut from the texts.

    All rows stay, also those left empty; null texts stay null and n_chars
    follows the cut. Equal rows that are long enough are cut in every copy.
    """
    return substrings.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents as often as their source's share of the mix takes them, at most three times.

    A null source is one of its own; documents of no words are not taken.
    Equal rows are interchangeable, so reruns agree.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token pieces placed in sequences.

    A null or empty text is one piece of the end id; repeated rows are packed
    as often as they come and null ids stay null.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("pack", pack),
]

#: SQL cannot express the trained, tokenised and seeded stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result goes to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
