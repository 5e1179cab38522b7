"""A corpus pipeline out of five operators; each stage's result is written and reread.

Quality rules drop documents, the n-gram join keeps one document of each class, substring dedup takes repeated
passages out of the texts, mixing takes each source's documents as often as its target asks, and packing lays
the token pieces of the mix into sequences.  Other columns of documents pass through the first four stages.

Defined results: an empty table, or one of which the rules reject all, gives an empty result through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing, ngram_join, packing, quality, substring_dedup
from .common import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_dedup(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL can't express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return docs
