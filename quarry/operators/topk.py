"""Top-k per group.

``row_number() <= k`` over a window: Catalyst (WindowGroupLimit) keeps only
the first k rows of every group inside each task *before* the shuffle, so a
group holding a third of the table ships k rows per task, not its whole
content.  Ties are broken by the explicit ``order`` list, never by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def top_k(df: DataFrame, group, order, k: int, rank_col: str = "rank") -> DataFrame:
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def ranked_list(df: DataFrame, group, rank_col: str, value, alias: str) -> DataFrame:
    """Collect the (already top-k limited) values of each group in rank order."""
    group = [group] if isinstance(group, str) else list(group)
    v = F.col(value) if isinstance(value, str) else value
    coll = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), v.alias("v"))))
    return df.groupBy(*group).agg(F.transform(coll, lambda s: s["v"]).alias(alias))


def global_rank(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Rank over all rows (``order`` without ties), without sorting them in one task.

    Rows are range-partitioned by ``order``; each partition ranks its own and
    starts after the rows of those before it (one count per partition).
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    # one row per partition
    starts = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_start") + own).cast("int")).drop("_p", "_start")
