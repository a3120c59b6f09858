"""Sinks: report history, chart-data tables, report sections.

Everything is written by Spark executors as Parquet/JSON; nothing is
assembled on the driver.  The history table is append-only and partitioned
by file type, so per-type listings prune partitions.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "quarry-io", f"{name}-{uuid.uuid4().hex}")


def with_history_id(df: DataFrame) -> DataFrame:
    """Ids that grow with the upload time and need no counter: milliseconds of
    the upload in the high bits, 20 bits of the identifying fields below."""
    below = F.pmod(F.xxhash64("user_id", "file_name", "file_size", "upload_date"), F.lit(1 << 20))
    return df.withColumn("id", F.unix_millis(F.col("upload_date").cast("timestamp")) * F.lit(1 << 20) + below)


def sink_history_append(df: DataFrame, path: str) -> None:
    with_history_id(df).write.mode("append").partitionBy("file_type").parquet(path)


def sink_chart_tables(charts: dict, path: str, mode: str = "overwrite") -> dict:
    """Write each chart's data to ``path/<chart_key>``; returns key -> location."""
    out = {}
    for key, df in charts.items():
        loc = os.path.join(path, key)
        df.write.mode(mode).parquet(loc)
        out[key] = loc
    return out


def roundtrip_csv(df: DataFrame, spark: SparkSession) -> str:
    loc = scratch_dir(spark, "csv")
    df.write.option("header", True).csv(loc)
    return loc


def roundtrip_json(df: DataFrame, spark: SparkSession) -> str:
    loc = scratch_dir(spark, "json")
    df.write.json(loc)
    return loc
