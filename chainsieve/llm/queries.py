"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsieve.llm import alignment, bpe, chat, jaccard, language, mixing, negatives, neighbours, passages, quality, simhash, suffixes, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_mix_sources", mixing.MIX_SQL)
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


@query("op4_chat_format", chat.CHAT_SQL)
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chat(table(spark, folder, "conversations"))


@query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(table(spark, folder, "documents"))


@query("op6_substring_dedup", passages.PASSAGES_SQL)
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.dedup_passages(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.dedup_bytes(table(spark, folder, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op1_ngram_jaccard_join", jaccard.JACCARD_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op5_exact_top_k", topk.TOP_K_SQL)
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.approximate_top_k(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment_counts(table(spark, folder, "documents"))


@query("op12_simhash_near_dedup")
def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op13_hard_negatives", negatives.NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", label), F.col("id") % 100 == 0)
