"""Time-bucketed trends.

Bucket labels follow the calendar conventions of the original charts:
month buckets are labelled by their last day, week buckets run Monday to
Sunday and are labelled by the Sunday, day buckets by the day.  All buckets
are timestamps at midnight (UTC session time zone).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicons as L
from quarry.operators.charts import TableProfile
from quarry.operators.profile import parse_ts


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def as_ts(df: DataFrame, col: str) -> Column:
    """The column as a timestamp: native types cast, text parsed, failures null."""
    dt = df.schema[col].dataType.simpleString()
    c = _c(col)
    if dt in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    return parse_ts(c.cast("string"))


def granularity_expr(span_days: Column) -> Column:
    """span > 730 days -> month; > 60 days -> week; else day."""
    return F.when(span_days > 730, "month").when(span_days > 60, "week").otherwise("day")


def span_days(lo: Column, hi: Column) -> Column:
    """Whole days between two timestamps (floor, like timedelta.days)."""
    return F.floor((F.unix_micros(hi) - F.unix_micros(lo)) / F.lit(86_400_000_000)).cast("bigint")


def bucket_expr(ts: Column, granularity: str) -> Column:
    if granularity == "month":
        return F.last_day(ts).cast("timestamp")
    if granularity == "week":
        return F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")
    return F.date_trunc("day", ts)


def bucket_step(granularity: str) -> Column:
    return {"month": F.expr("INTERVAL 1 MONTH"), "week": F.expr("INTERVAL 7 DAYS"),
            "day": F.expr("INTERVAL 1 DAY")}[granularity]


def trend_granularity(df: DataFrame, col: str) -> DataFrame:
    t = as_ts(df, col)
    return df.agg(F.min(t).alias("start"), F.max(t).alias("end")).select(
        F.lit(col).alias("column"), "start", "end",
        span_days(F.col("start"), F.col("end")).alias("span_days"),
        granularity_expr(span_days(F.col("start"), F.col("end"))).alias("granularity"))


def _granularity_of(df: DataFrame, col: str) -> str | None:
    r = trend_granularity(df, col).collect()[0]
    return r["granularity"] if r["start"] is not None else None


def datetime_trend(df: DataFrame, date_col: str | None = None, cols=None, prof: TableProfile | None = None,
                   max_cols: int | None = None, min_buckets: int = 2) -> DataFrame:
    """Mean of each numeric column per time bucket; empty buckets dropped;
    a column with fewer than ``min_buckets`` buckets is left out."""
    if date_col is None or cols is None:
        prof = prof or TableProfile.of(df)
        dts = prof.by_role("datetime")
        if not dts:
            return df.sparkSession.createDataFrame([], "column string, bucket timestamp, mean double")
        date_col = date_col or dts[0]
        cols = cols if cols is not None else prof.by_role("numeric")[:max_cols]
    g = _granularity_of(df, date_col)
    if g is None or not cols:
        return df.sparkSession.createDataFrame([], "column string, bucket timestamp, mean double")
    t = as_ts(df, date_col)
    base = df.select(bucket_expr(t, g).alias("bucket"), *[_c(c).cast("double").alias(f"v{i}")
                                                          for i, c in enumerate(cols)]) \
        .where(F.col("bucket").isNotNull())
    means = base.groupBy("bucket").agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(cols))])
    long = means.select("bucket", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(cols)])))
    long = long.where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    from pyspark.sql import Window
    w = Window.partitionBy("column")
    return (long.withColumn("_nb", F.count(F.lit(1)).over(w)).where(F.col("_nb") >= min_buckets)
            .select("column", "bucket", "mean"))


def bucket_counts(df: DataFrame, date_col: str, granularity: str | None = None,
                  value_col: str | None = None, how: str = "count") -> DataFrame:
    """Rows (or sum/mean of ``value_col``) per bucket, *including* empty buckets.

    The bucket range comes from min/max (one row); ``sequence`` expands it
    (bounded by the span, not the data) and a left join fills the gaps.
    """
    g = granularity or _granularity_of(df, date_col)
    if g is None:
        return df.sparkSession.createDataFrame([], "bucket timestamp, value double")
    t = as_ts(df, date_col)
    b = df.select(bucket_expr(t, g).alias("bucket"),
                  (_c(value_col).cast("double") if value_col else F.lit(1.0)).alias("v")) \
        .where(F.col("bucket").isNotNull())
    if how == "count":
        agg = F.count(F.lit(1)).cast("double")
    elif how == "sum":
        agg = F.sum("v")
    else:
        agg = F.avg("v")
    per = b.groupBy("bucket").agg(agg.alias("value"))
    rng = b.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    if g == "month":
        # month ends are not evenly spaced: step over month starts, then take the last day
        seq = F.transform(F.sequence(F.trunc(F.col("lo"), "month"), F.trunc(F.col("hi"), "month"),
                                     F.expr("INTERVAL 1 MONTH")),
                          lambda d: F.last_day(d).cast("timestamp"))
    else:
        seq = F.sequence(F.col("lo"), F.col("hi"), bucket_step(g))
    allb = rng.select(F.explode(seq).alias("bucket"))
    fill = 0.0 if how in ("count", "sum") else None
    out = allb.join(per, "bucket", "left")
    if fill is not None:
        out = out.withColumn("value", F.coalesce("value", F.lit(fill)))
    return out.select("bucket", "value")


def event_count_trend(df: DataFrame, date_col: str | None = None, prof: TableProfile | None = None) -> DataFrame:
    """Rows per bucket, empty buckets as 0.  Applies when the table has a
    datetime column, no numeric column and some categorical column."""
    if date_col is None:
        prof = prof or TableProfile.of(df)
        dts = prof.by_role("datetime")
        if not dts or prof.by_role("numeric") or not prof.by_role("categorical"):
            return df.sparkSession.createDataFrame([], "bucket timestamp, count bigint")
        date_col = dts[0]
    return bucket_counts(df, date_col, how="count").select("bucket", F.col("value").cast("bigint").alias("count"))


def severity_column(cols) -> str | None:
    for c in cols:
        if any(p in c.lower() for p in L.SEVERITY_NAME_PATTERNS):
            return c
    return None


def year_month_pivot(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Mean of ``value_col`` per year (rows) and month (columns m01..m12);
    a month without rows in a year shows 0."""
    t = as_ts(df, date_col)
    base = df.select(F.year(t).alias("year"), F.month(t).alias("month"), _c(value_col).cast("double").alias("v")) \
        .where(F.col("year").isNotNull())
    months = list(range(1, 13))
    p = base.groupBy("year").pivot("month", months).agg(F.avg("v"))
    return p.select("year", *[F.coalesce(F.col(str(m)), F.lit(0.0)).alias(f"m{m:02d}") for m in months])
