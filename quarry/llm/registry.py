"""Queries of the corpus operators, one per dealt operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (exact_topk, html_text, line_dedup, lm_mixing, merkle_manifest, minhash_dedup, packing, quality_knn, quality_rules, ranked_search,
               sentencepiece_codec, toxicity_gru, url_filter)
from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _on_documents(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": _on_documents(sentencepiece_codec.query),
    "op2_url_filter": lambda spark, d: url_filter.judge(spark.read.parquet(f"{d}/pages.parquet")),
    "op3_packing": _on_documents(packing.query),
    "op4_exact_topk": lambda spark, d: exact_topk.query(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op5_toxicity": lambda spark, d: toxicity_gru.query(documents(spark, d), _labels(spark, d)),
    "op6_line_dedup": _on_documents(line_dedup.query),
    "op7_lm_mixing": _on_documents(lm_mixing.query),
    "op8_quality_rules": _on_documents(quality_rules.query),
    "op9_minhash_dedup": _on_documents(minhash_dedup.query),
    "op10_quality_knn": lambda spark, d: quality_knn.query(documents(spark, d), _labels(spark, d)),
    "op11_html_text": lambda spark, d: html_text.query(spark.read.parquet(f"{d}/pages.parquet")),
    "op12_merkle_manifest": _on_documents(merkle_manifest.query),
    "op13_ranked_search": lambda spark, d: ranked_search.query(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
}

ORACLE: dict[str, str] = {
    "op2_url_filter": url_filter.oracle_sql(),
    "op4_exact_topk": exact_topk.oracle_sql(),
    "op6_line_dedup": line_dedup.oracle_sql(),
    "op8_quality_rules": quality_rules.oracle_sql(),
    "op12_merkle_manifest": merkle_manifest.oracle_sql(),
    "op13_ranked_search": ranked_search.oracle_sql(),
}
