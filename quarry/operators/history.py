"""Report history and settings queries.

History is an append-only table (Parquet, partitioned by file type).  Every
lookup is a filter + projection that Parquet min/max statistics and
partition pruning serve; per-user listings are windows partitioned by user,
so each user's rows are ranked independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def escape_like(q: str) -> str:
    """Escape LIKE wildcards so ``q`` matches literally."""
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def history_list(h: DataFrame, user_id=None) -> DataFrame:
    """Reports per user, newest id first (``position`` 1 = newest)."""
    if user_id is not None:
        h = h.where(F.col("user_id") == user_id)
    w = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return h.withColumn("position", F.row_number().over(w))


def history_search(h: DataFrame, q: str, user_id=None) -> DataFrame:
    """Case-insensitive substring match on file name, file type or insights."""
    pat = f"%{escape_like(q)}%"
    cond = (F.col("file_name").ilike(pat) | F.col("file_type").ilike(pat) | F.col("insights").ilike(pat))
    return history_list(h.where(cond), user_id)


def history_kpis(h: DataFrame, recent: int = 5) -> DataFrame:
    """Per user: uploads, reports with an output, ids of the newest ``recent``."""
    w = Window.partitionBy("user_id").orderBy(F.desc("id"))
    top = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= recent)
    recent_ids = top.groupBy("user_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda s: s["id"].cast("string")), ",")
        .alias("recent_ids"))
    counts = h.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_uploads"),
                                      F.count_if(F.col("has_report")).alias("total_reports"))
    return counts.join(recent_ids, "user_id", "left")


def history_get(h: DataFrame, ids) -> DataFrame:
    """Reports by id (a point or batch lookup; Parquet statistics prune it)."""
    ids = [ids] if isinstance(ids, int) else list(ids)
    return h.where(F.col("id").isin(*ids)).select("id", "user_id", "file_name", "file_type", "insights",
                                                   "upload_date")


def history_duplicate(h: DataFrame, incoming: DataFrame | None = None) -> DataFrame:
    """Latest id with the same file name and size, for each incoming upload."""
    latest = h.groupBy("file_name", "file_size").agg(F.max("id").alias("existing_id"))
    if incoming is None:
        return latest
    return incoming.join(latest, ["file_name", "file_size"], "left")


def settings_latest(s: DataFrame) -> DataFrame:
    """The newest settings row (by id)."""
    cols = [c for c in s.columns]
    best = s.agg(F.max_by(F.struct(*cols), F.col("id")).alias("r"))
    return best.select("r.*")


def settings_upsert(s: DataFrame, analysis_type: str, report_format: str, visual_charts: str,
                    created_at=None) -> DataFrame:
    """New version of the settings table: the newest row updated in place,
    or one new row when the table is empty.  Written as a new version by the
    caller (no in-place mutation)."""
    newest = s.agg(F.max("id").alias("id"))
    updated = newest.where(F.col("id").isNotNull()).select(
        "id", F.lit(analysis_type).alias("analysis_type"), F.lit(report_format).alias("report_format"),
        F.lit(visual_charts).alias("visual_charts"),
        (F.lit(created_at) if created_at is not None else F.current_timestamp()).cast("timestamp")
        .alias("created_at"))
    inserted = newest.where(F.col("id").isNull()).select(
        F.lit(1).cast("bigint").alias("id"), F.lit(analysis_type).alias("analysis_type"),
        F.lit(report_format).alias("report_format"), F.lit(visual_charts).alias("visual_charts"),
        (F.lit(created_at) if created_at is not None else F.current_timestamp()).cast("timestamp")
        .alias("created_at"))
    rest = s.join(newest, "id", "left_anti")
    return rest.unionByName(updated).unionByName(inserted)
