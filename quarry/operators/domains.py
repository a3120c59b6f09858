"""Domain views, chosen from the (lower-cased) column names.

Each view is an ordinary aggregation over the table; the dispatcher only
decides *which* views apply, from the schema and the profile (bounded by
the column count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexicons as L
from quarry.functions.text import az_words, without
from quarry.operators import charts as C
from quarry.operators.topk import global_rank
from quarry.operators.trends import bucket_counts


def cols_lower(df: DataFrame) -> dict:
    return {c.lower(): c for c in df.columns}


def _c(name: str):
    return F.col(f"`{name}`")


def domain_dispatch(df: DataFrame, prof: C.TableProfile | None = None) -> list:
    """Names of the domain views a table gets, by its column names and text columns."""
    cl = cols_lower(df)
    rules = [
        ("health", "stroke" in cl),
        ("delivery", "delivery_time_min" in cl or "distance_km" in cl),
        ("weather", "precipitation" in cl or "temp_max" in cl),
        ("sales", "sales" in cl or "productline" in cl),
        ("asthma", "has_asthma" in cl or "asthma" in cl),
    ]
    found = [v for v, applies in rules if applies]
    prof = prof or C.TableProfile.of(df)
    if any(r["role"] == "text" and (r["avg_len"] or 0) > 40 for r in prof.rows):
        found.append("text_terms")
    return found


def health_counts(df: DataFrame, fields=("hypertension", "heart_disease", "smoking_status")) -> DataFrame:
    """Rows per (field value, stroke value) for each present field."""
    cl = cols_lower(df)
    stroke = cl["stroke"]
    present = [f for f in fields if f in cl]
    long = df.select(_c(stroke).cast("string").alias("stroke"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), _c(cl[f]).cast("string").alias("value")) for f in present])))
    return (long.where(F.col("value").isNotNull() & F.col("stroke").isNotNull())
            .groupBy("field", "value", "stroke").agg(F.count(F.lit(1)).alias("count")))


def health_distributions(df: DataFrame, conts=("bmi", "avg_glucose_level")) -> DataFrame:
    cl = cols_lower(df)
    present = [cl[c] for c in conts if c in cl]
    return C.grouped_box_stats(df, cl["stroke"], present).withColumn("stroke", F.col("group").cast("string")) \
        .drop("group")


def delivery_scatter_fit(df: DataFrame) -> DataFrame:
    cl = cols_lower(df)
    return C.linear_fit(df, cl["distance_km"], cl["delivery_time_min"])


def delivery_by_traffic(df: DataFrame) -> DataFrame:
    """Box statistics of delivery time per traffic level, levels ordered by median."""
    cl = cols_lower(df)
    b = C.grouped_box_stats(df, cl["traffic_level"], [cl["delivery_time_min"]])
    return global_rank(b, [F.asc("median"), F.asc("group")], "order").withColumn(
        "traffic_level", F.col("group").cast("string")).drop("group", "column")


def mean_by(df: DataFrame, key: str, value: str, how: str = "avg") -> DataFrame:
    """Mean (or sum) of ``value`` per ``key``, largest first."""
    agg = F.avg if how == "avg" else F.sum
    # exact decimal accumulation: the result does not depend on how rows are
    # spread over tasks (a double sum changes in its last bits with the order).
    # Groups with values that a decimal can't hold closely are summed as doubles.
    v = _c(value)
    held = v.try_cast("decimal(38,10)")
    lost = v.isNotNull() & (held.isNull() | ((v != 0) & (F.abs(v.cast("double")) < 1e-4)))
    g = df.where(_c(key).isNotNull()).groupBy(_c(key).cast("string").alias("key")).agg(
        F.when(F.count_if(lost) > 0, agg(v.cast("double"))).otherwise(agg(held).cast("double")).alias("value"))
    return global_rank(g, [F.desc("value"), F.asc("key")], "order")


def delivery_by_weather(df: DataFrame) -> DataFrame:
    cl = cols_lower(df)
    return mean_by(df, cl["weather"], cl["delivery_time_min"], "avg")


def weather_monthly(df: DataFrame, cols=("temp_max", "precipitation", "temp_min", "wind")) -> DataFrame:
    """Month-end means per weather measure; months without rows kept as null."""
    cl = cols_lower(df)
    parts = []
    for c in cols:
        if c in cl:
            parts.append(bucket_counts(df, cl["date"], "month", cl[c], how="avg")
                         .select(F.lit(c).alias("measure"), "bucket", F.col("value").alias("mean")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weather_frequency(df: DataFrame) -> DataFrame:
    cl = cols_lower(df)
    return C.value_frequency(df, cl["weather"])


def weather_temp_range(df: DataFrame) -> DataFrame:
    """Monthly mean of temp_max and temp_min side by side (the band)."""
    cl = cols_lower(df)
    hi = bucket_counts(df, cl["date"], "month", cl["temp_max"], how="avg").withColumnRenamed("value", "max_mean")
    lo = bucket_counts(df, cl["date"], "month", cl["temp_min"], how="avg").withColumnRenamed("value", "min_mean")
    return hi.join(lo, "bucket", "full")


def sales_by_productline(df: DataFrame) -> DataFrame:
    cl = cols_lower(df)
    return mean_by(df, cl["productline"], cl["sales"], "sum")


def sales_monthly_trend(df: DataFrame) -> DataFrame:
    """Month-end sum of sales; months without orders show 0."""
    cl = cols_lower(df)
    return bucket_counts(df, cl["orderdate"], "month", cl["sales"], how="sum")


def share_of(df: DataFrame, col: str) -> DataFrame:
    """Count and percentage per value."""
    f = C.value_frequency(df, col)
    total = f.agg(F.sum("count")).first()[0]
    return f.withColumn("pct", F.col("count") * 100.0 / F.lit(total))


def sales_deal_size(df: DataFrame) -> DataFrame:
    cl = cols_lower(df)
    return share_of(df, cl["dealsize"])


def asthma_target(df: DataFrame):
    cl = cols_lower(df)
    return cl.get("has_asthma") or cl.get("asthma_control_level")


def asthma_box(df: DataFrame, conts=("bmi", "age", "peak_expiratory_flow", "feno_level",
                                     "number_of_er_visits")) -> DataFrame:
    cl = cols_lower(df)
    target = asthma_target(df)
    present = [cl[c] for c in conts if c in cl]
    if not target or not present:
        return df.sparkSession.createDataFrame([], "target string, column string, q1 double, median double, "
                                                   "q3 double")
    return C.grouped_box_stats(df, target, present).withColumn("target", F.col("group").cast("string")) \
        .drop("group")


def asthma_crosstab(df: DataFrame, cats=("smoking_status", "air_pollution_level", "physical_activity_level",
                                         "gender")) -> DataFrame:
    cl = cols_lower(df)
    target = asthma_target(df)
    present = [cl[c] for c in cats if c in cl]
    return C.crosstab_share(df, target, present)


def text_column_terms(df: DataFrame, col: str, top: int = 15, stopwords=L.CHART_STOPWORDS) -> DataFrame:
    """Most frequent ``[a-z]{4,}`` words over a whole text column (all rows).

    Partial aggregation per task keeps the shuffle to distinct words per
    task; a global top-k then keeps ``top`` rows (ties by word).
    """
    words = without(az_words(_c(col), 4), stopwords)
    c = df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    # orderBy + limit plans as TakeOrderedAndProject: each task keeps its own
    # top rows, so no single task ever sorts the whole vocabulary
    t = c.orderBy(F.desc("count"), "term").limit(top)
    w = Window.orderBy(F.desc("count"), "term")
    return t.withColumn("rank", F.row_number().over(w))


def label_distribution(df: DataFrame, col: str, top: int = 10) -> DataFrame:
    return C.value_frequency(df, col, top)
