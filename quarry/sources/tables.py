"""Reading the driver's parquet tables, plus the column-alias views.

The parquet scan is where column pruning and filter pushdown land, so the
loaders return plain ``spark.read.parquet`` DataFrames and let Catalyst prune.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan with fewer splits than cores out to all cores (a shuffle).

    Only when the session asks for it (``spark.quarry.scan.spread`` = true): it
    helps tables stored as a single row group, as in the benchmark, and is
    wrong for large ones.
    """
    if df.sparkSession.conf.get("spark.quarry.scan.spread", "false") != "true":
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


# ---------------------------------------------------------------------------
# Domain fixtures.  The test tables have no stroke / delivery / weather /
# sales / asthma columns, so these views rename real columns to the names the
# domain views look for.  The same aliases are used in the oracle SQL.
# ---------------------------------------------------------------------------

def sales_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_type").alias("PRODUCTLINE"),
        F.col("l_extendedprice").alias("SALES"),
        F.col("l_shipdate").alias("ORDERDATE"),
        F.when(F.col("l_quantity") < 10, "Small").when(F.col("l_quantity") < 35, "Medium")
        .otherwise("Large").alias("DEALSIZE"),
    )


def delivery_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_quantity").alias("distance_km"),
        F.col("l_extendedprice").alias("delivery_time_min"),
        F.col("l_returnflag").alias("traffic_level"),
        F.col("l_linestatus").alias("weather"),
        F.col("l_linestatus").alias("vehicle_type"),
    )


def weather_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("temp_max"),
        (F.col("o_totalprice") / 2).alias("temp_min"),
        F.col("o_orderstatus").alias("weather"),
    )


def stroke_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return lab.join(docs, "doc_id").select(
        F.col("toxic").alias("stroke"),
        F.col("quality").alias("hypertension"),
        F.col("n_chars").cast("double").alias("bmi"),
        F.col("lang").alias("smoking_status"),
    )


def asthma_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return lab.join(docs, "doc_id").select(
        F.col("toxic").alias("has_asthma"),
        F.col("n_chars").cast("double").alias("bmi"),
        F.col("quality").cast("double").alias("age"),
        F.col("lang").alias("gender"),
        F.col("lang").alias("smoking_status"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels: real nulls for unlabelled documents (a
    nullable int, a nullable boolean and a nullable text column)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality",
        (F.col("toxic") == 1).alias("toxic_flag"),
        F.col("toxic").cast("string").alias("toxic_text"))


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels JOIN documents: two binary targets, a numeric and a categorical column."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "quality", "toxic", "n_chars", "lang")


def events_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with text columns that are mostly / partly numbers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.regexp_extract("props", r"(\d+)", 1).alias("k_text"),
        F.when(F.col("event_type") == "click", F.col("value").cast("string"))
        .otherwise(F.col("event_type")).alias("mixed"),
        "value")


def history_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report-history table derived from orders (one report per order)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("file_name"), F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("file_size"),
        F.col("o_orderstatus").alias("file_type"),
        F.concat(F.lit("Report for order "), F.col("o_orderkey").cast("string")).alias("insights"),
        (F.col("o_orderstatus") == "F").alias("has_report"), F.col("o_orderdate").alias("upload_date"))


def settings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings table derived from orders (one saved setting per order)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("analysis_type"),
        F.col("o_orderpriority").alias("report_format"),
        F.when(F.col("o_totalprice") > 100000, "Enabled").otherwise("Disabled").alias("visual_charts"),
        F.col("o_orderdate").alias("created_at"))
