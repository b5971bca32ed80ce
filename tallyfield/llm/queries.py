"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, katz, language, lexical, media, negatives, packing, pii, quality, sentences, simhash, token_counts
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return chat.preference_pairs(conversations, chat.with_borrowed_reply(conversations), "conv_id")


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.remove_repeats(table(spark, sf_dir, "documents"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=negatives.shifted_label())


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_benchmark_decontamination,
        op3_chat_formatting,
        op4_katz_scores,
        op5_media_columns,
        op6_pii,
        op7_token_counts,
        op8_substring_dedup,
        op9_vector_packing,
        op10_simhash_near_dedup,
        op11_hard_negatives,
        op12_quality,
        op13_lexical_search,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op3_chat_formatting": chat.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op13_lexical_search": lexical.ORACLE_SQL,
}
