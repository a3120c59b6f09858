"""Continuous document ingest: new documents in -> analysis rows appended.

The batch plan is the unit of work: Structured Streaming picks up new
Parquet files of ``(doc_id, text)``, and each micro-batch runs the document
analysis and appends the result to a report table.  There is no cross-batch
state (every document is analysed on its own).  A batch writes the partition of
its ``batch_id`` and replaces it when it is replayed, so a restarted query,
which resumes from the checkpoint in the shared folder, adds no row twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.documents import text_analysis
from quarry.session import checkpoint_dir

DOC_SCHEMA = "doc_id long, text string"


def analysis_rows(batch: DataFrame) -> DataFrame:
    a = text_analysis(batch.select("doc_id", "text"))
    return a.select("doc_id", "document_type", "executive_summary", "key_insights", "recommendations",
                    "keywords", "sentiment", "readability", "readability_grade")


def write_analysis(batch: DataFrame, batch_id: int, sink_dir: str) -> None:
    """Write a batch's rows as the partition ``batch_id``, in place of an earlier try."""
    (analysis_rows(batch).withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink_dir))


def start_document_stream(spark: SparkSession, source_dir: str, sink_dir: str, name: str = "doc_ingest",
                          trigger_once: bool = False, max_files_per_trigger: int = 64):
    """Start the stream; returns the StreamingQuery."""
    stream = (spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_analysis(batch, batch_id, sink_dir)

    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt).queryName(name)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
