"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embedding_dedup, hard_negatives, license_scan, mixing, ngram_join, packing, quality, spelling, substring_dedup, suffix_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": lambda spark, d: suffix_dedup.op1(table(spark, d, "documents")),
    "op2_best_fit_packing": lambda spark, d: packing.op2(table(spark, d, "documents")),
    "op3_chat_formatting": lambda spark, d: chat.op3(table(spark, d, "conversations")),
    "op4_url_filter": lambda spark, d: url_filter.op4(table(spark, d, "pages")),
    "op5_ngram_jaccard_join": lambda spark, d: ngram_join.op5(table(spark, d, "documents")),
    "op6_quality_rules": lambda spark, d: quality.op6(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_embedding_near_dedup": lambda spark, d: embedding_dedup.op7(table(spark, d, "embeddings")),
    "op8_source_mixing": lambda spark, d: mixing.op8(table(spark, d, "documents")),
    "op9_license_scan": lambda spark, d: license_scan.op9(table(spark, d, "documents")),
    "op10_substring_dedup": lambda spark, d: substring_dedup.op10(table(spark, d, "documents")),
    "op11_benchmark_decontamination": lambda spark, d: decontaminate.op11(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op12_hard_negatives": lambda spark, d: hard_negatives.op12(table(spark, d, "embeddings")),
    "op13_spelling_variants": lambda spark, d: spelling.op13(table(spark, d, "documents")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_formatting": chat.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_ngram_jaccard_join": ngram_join.ORACLE,
    "op7_embedding_near_dedup": embedding_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op11_benchmark_decontamination": decontaminate.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
