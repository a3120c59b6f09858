"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "quarry") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    * UTC session time zone, so day/week/month buckets do not move with the host.
    * AQE on: coalesces small shuffle partitions and splits skewed ones.
    * ANSI stays on (Spark 4 default); operators guard divisions and casts.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master (one
    machine: tests, local runs) may leave it unset and gets a scratch folder;
    on a cluster a local folder would lose files, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df, eager: bool = True):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) and keeps long plans
    from being recomputed by every downstream query.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def as_table(df):
    """The rows written once as a compressed table in the shared folder, to be read by column (no interval columns)."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"quarry-table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
