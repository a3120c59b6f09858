"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function (spark, docs, sf_dir) -> DataFrame and calls one
operator of ``quarry.llm``; its result is written as Parquet and read again as
the next stage's documents.  All stages but the last return the documents they
keep (line dedup: with boilerplate lines removed) with the columns they came with.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, minhash_dedup, packing, quality_rules, toxicity_gru
from quarry.llm.common import SPACE, documents, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the network is fitted on the labelled ones among them."""
    return toxicity_gru.filter_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy of quality rules."""
    return quality_rules.filter_stage(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines and repeated passages; those left without a word go."""
    cleaned = line_dedup.dedup(docs, long_sites=line_dedup.LONG_SITES)
    whole = (F.col("n_removed") == 0) | F.col("text").rlike(f"[^{SPACE}]")
    return cleaned.filter(F.coalesce(whole, F.lit(True))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash_dedup.filter_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("line dedup", drop_boilerplate),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: A trained network and its scores can't be expressed in SQL; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
