"""Exact quantiles of any size, without holding a column in one task.

Values are first counted (partial aggregation), the counts are range-partitioned
by key and value, each partition's total gives the ranks at which it starts,
and only the rows that hold a wanted rank are picked.  The result is that of
Spark's ``percentile`` (linear interpolation between neighbouring ranks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize


def quantiles_of_counts(counts: DataFrame, keys: list, value: str, n: str, probs) -> DataFrame:
    """``keys`` plus ``q`` (array, one entry per probability) of values that occur ``n`` times."""
    spread = counts.select(*keys, F.col(value).alias("_v"), F.col(n).alias("_c")) \
        .repartitionByRange(*[F.col(k) for k in keys], F.col("_v")).withColumn("_p", F.spark_partition_id())
    spread = materialize(spread)
    # at most one row per key and partition
    totals = spread.groupBy(*keys, "_p").agg(F.sum("_c").alias("_t"))
    of_key = Window.partitionBy(*keys)
    starts = totals.select(*keys, "_p", (F.sum("_t").over(of_key.orderBy("_p")) - F.col("_t")).alias("_start"),
                           F.sum("_t").over(of_key).alias("_n"))
    here = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys] + [F.col("s._p") == F.col("t._p")]
    cond = here[0]
    for h in here[1:]:
        cond = cond & h
    j = spread.alias("s").join(starts.alias("t"), cond).select(*[F.col(f"s.{k}").alias(k) for k in keys], "s._p", "_v", "_c", "_start", "_n")
    within = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_hi", F.col("_start") + F.sum("_c").over(within)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    at = lambda rank: F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))
    aggs, outs = [], []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_a{i}"), at(F.ceil(pos)).alias(f"_b{i}"), F.max(pos).alias(f"_x{i}")]
        a, b, x = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_x{i}")
        outs.append(F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b))
    return j.groupBy(*keys).agg(*aggs).select(*keys, F.array(*outs).alias("q"))


def value_at(df: DataFrame, value: str, rank: int, parts: int = 4096, few: int = 10_000) -> float:
    """The value of ``rank`` (0 is the smallest) of a written column of finite doubles, in bounded memory and without a sort.

    Values are counted in ``parts`` equal parts of their range, the part that holds the rank is the
    next range, and so on until it has few rows or a single value; each step reads the column once.
    """
    v = F.col(value)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    while lo < hi:
        width = hi - lo
        part = F.least(F.floor((v - F.lit(lo)) / F.lit(width) * F.lit(float(parts))), F.lit(parts - 1))
        inside = df.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
        for r in sorted(inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()):
            if rank < r["n"]:
                break
            rank -= r["n"]
        lo, hi = r["lo"], r["hi"]  # narrower each time, as the ends lie in different parts
        if r["n"] <= few:
            return sorted(x[0] for x in df.where((v >= F.lit(lo)) & (v <= F.lit(hi))).select(v).collect())[rank]
    return lo


def quantiles(long: DataFrame, keys: list, value: str, probs) -> DataFrame:
    """Exact quantiles of ``value`` per ``keys``; nulls are left out."""
    counts = long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    return quantiles_of_counts(counts, keys, value, "_count", probs)
