"""Corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainsieve.llm import bpe, jaccard, language, mixing, suffixes
from chainsieve.session import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is accepted."""
    return language.identified(docs, language.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.one_of_each(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 100 bytes and more that occur earlier out of the texts."""
    return suffixes.cut_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the round trip."""
    return bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", cut_repeated_strings),
    ("mix_sources", mix),
    ("bpe", encode),
]

#: The stages include trained models and byte-level work, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:  # each stage reads its input more than once
            docs = cut_lineage(docs)
    return docs
