"""Corpus pipeline: quality rules, exact and near duplicates, mixing, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.

All stages but the last give the columns of docs, whatever others there are and however they are named. A
null text counts as an empty one; both fail the base rules, so later stages only see them if they are run by
themselves, and then keep one of them (exact duplicates), all (near duplicates), none (mixing, as they have no
words) or give no tokens (encoding). Texts of any length are whole. Rows without an identifier are documents of
their own. Rows that repeat are equal texts, of which one stays. An empty table goes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from sparkloom.llm.common import discard, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go. Null labels, and labels of no document,
    count for nothing; without labels only the base rules hold. A null language is a stratum of its own."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays; one without an identifier only if all are."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest identifier stays; rows without one all stay."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from not at all to three times. A null source is one of its own.
    Ties in size go by identifier, then by the row's hash."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the identifiers and of the decoded bytes. All distinct words are folded and
    decoded by higher-order functions, but for those beyond byte_bpe.LONG bytes, which go by the heap."""
    return byte_bpe.encode_folded(docs, ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL can't express the merges of the last stage, nor near duplicates at a bearable cost.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
