"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, chat, html_extract, lexical, media, minhash, mixing, negatives, quality, rans, substring, url_filter, winnowing
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_decode(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(table(spark, sf_dir, "documents"))


def op10_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_segments(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.integers(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict:
    ops = (
        op1_quality_rules, op2_audio_features, op3_minhash_dedup, op4_bpe_trie, op5_html_text,
        op6_mix_sources, op7_url_filter, op8_rans_ids, op9_substring_dedup, op10_chat_masks,
        op11_lexical_search, op12_decontamination, op13_hard_negatives,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mix_sources": mixing.oracle(), "op11_lexical_search": lexical.oracle(), "op12_decontamination": winnowing.oracle(),
        "op13_hard_negatives": negatives.oracle(),
    }
