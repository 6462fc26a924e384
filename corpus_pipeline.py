"""A corpus pipeline of five stages, each over all that the one before it kept.

Quality rules, MinHash near-dedup, substring dedup, mixing to target weights, BPE encoding. Each
stage is written as Parquet to the folder the cluster shares and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliploom.llm import bpe_trie, minhash, mixing, quality, substring
from cliploom.llm.common import drop_scratch, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules don't reject."""
    return quality.keep(docs)


#: Near copies are texts whose shingles have this similarity or more, in percent; op3 takes 85.
NEAR_PERCENT = 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.dedup(docs, NEAR_PERCENT)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier; n_chars counts what is left."""
    return substring.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities."""
    return mixing.keep(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe_trie.encode_decode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Near-duplicate components and BPE have no SQL form at this size; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_scratch(before)
        before = docs
    return docs
