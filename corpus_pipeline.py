"""The corpus pipeline: documents through quality rules, near-dedup, decontamination, secret masking and mixing.

Each stage reads what its predecessor wrote as Parquet. Quality, near-dedup and decontamination drop documents;
the secret stage masks secrets inside texts; mixing decides how often each document is taken.

Null and empty texts: rejected by the quality rules (few words). Very long texts: whole in every stage. Null and repeated
ids: rows are judged by their own texts, so no row takes another one along; of near duplicates one row stays, the one
with the smallest id (null first), then the smallest hash of its text. Repeated rows: one stays. Extra columns, whatever
their names: kept until the last stage, which returns mixing's columns. Empty table: empty result in the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.llm import decontam, mixing, omh, quality, secrets
from quirefold.llm.common import drop_stored, load, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return omh.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_only(docs, load(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: Near-dedup and mixing aren't SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stored(*before)  # what the stage read; its rows are written now
        before = [docs]
    return docs
