"""Per-column profile, column roles and the dataset domain.

``column_stats`` is the one scan every tabular plan starts from: a single
wide ``agg`` computes count, nulls, distinct count, min/max/mean/std/skew,
mean text length and the date-parse probe for *all* columns at once, then
``inline`` turns the one result row into one row per column.  Roles are
column expressions over that long table, so they stay lazy; plans that need
them on the driver collect at most one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import lexicons as L
from quarry.operators.clean import is_numeric_kind, kind_of, nan_to_null

STATS_SCHEMA = (
    "column string, ord int, kind string, n bigint, nulls bigint, n_distinct bigint, "
    "min double, max double, mean double, std double, skew double, avg_len double, "
    "dt_min timestamp, dt_max timestamp, dt_ok boolean"
)

# Formats tried, in order, when text is read as a timestamp.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]


def parse_ts(c: Column) -> Column:
    """Timestamp from text: ISO first (the cast), then the declared formats.

    Each failed try raises and catches an exception, some 5 microseconds; so texts without
    a digit, or without the separator of a format, are not tried.
    """
    tries = [F.when(c.contains("/" if "/" in f else "-"), F.try_to_timestamp(c, F.lit(f))) for f in DATE_FORMATS]
    return F.when(c.rlike("[0-9]"), F.coalesce(F.try_to_timestamp(c), *tries))


def _name_has(name: str, patterns) -> bool:
    lc = name.lower()
    return any(p in lc for p in patterns)


def column_stats(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per column; distinct counts only when asked for, as they need a shuffle."""
    n_all = F.count(F.lit(1))
    structs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        k = kind_of(f.dataType)
        num = is_numeric_kind(k)
        v = nan_to_null(c, f.dataType).cast("double") if num else None
        dnull = F.lit(None).cast("double")
        tnull = F.lit(None).cast("timestamp")
        nd = F.lit(None).cast("bigint")  # exact counts come from distinct_counts()
        if k == "temporal":
            dmin, dmax, dok = F.min(c).cast("timestamp"), F.max(c).cast("timestamp"), F.lit(True)
        elif k == "string" and _name_has(f.name, L.PROFILE_DATETIME_PATTERNS + L.BASIC_DATE_PATTERNS):
            p = parse_ts(c)
            dmin, dmax = F.min(p), F.max(p)
            dok = F.coalesce(F.every(c.isNull() | p.isNotNull()), F.lit(True))
        else:
            dmin, dmax, dok = tnull, tnull, F.lit(False)
        if k in ("string", "boolean"):
            alen = F.avg(F.length(c.cast("string"))).cast("double")
        else:
            alen = dnull
        if num:
            sk = F.skewness(v)
            cnt = F.count(v)
            # pandas reports the bias-corrected skew (G1); Spark gives g1
            g1 = F.when(cnt > 2, sk * F.sqrt(cnt * (cnt - 1)) / (cnt - 2))
            skew = F.when(F.stddev_pop(v) == 0, F.lit(0.0)).otherwise(g1)
            stats = [F.min(v), F.max(v), F.avg(v), F.stddev_samp(v), skew]
        else:
            stats = [dnull] * 5
        nulls = F.count_if(nan_to_null(c, f.dataType).isNull()) if k != "other" else F.count_if(c.isNull())
        structs.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(i).alias("ord"), F.lit(k).alias("kind"),
            n_all.alias("n"), nulls.cast("bigint").alias("nulls"), nd.alias("n_distinct"),
            stats[0].alias("min"), stats[1].alias("max"), stats[2].alias("mean"),
            stats[3].alias("std"), stats[4].alias("skew"), alen.alias("avg_len"),
            dmin.alias("dt_min"), dmax.alias("dt_max"), dok.alias("dt_ok"),
        ))
    stats = df.agg(F.array(*structs).alias("s")).select(F.inline("s"))
    exact = [f.name for f in df.schema.fields if kind_of(f.dataType) != "other"]
    if not distinct or not exact:
        return stats
    nd = distinct_counts(df, exact)
    # one row per column on both sides: the join is bounded by the column count
    return (stats.drop("n_distinct").join(F.broadcast(nd), "column", "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint")))
            .select(*[f.split()[0] for f in STATS_SCHEMA.split(", ")]))


def distinct_counts(df: DataFrame, cols) -> DataFrame:
    """Exact distinct non-null values per column in one pass.

    Values are unpivoted to (column, 128-bit digest of the value) and
    deduplicated with a groupBy (partial aggregation inside each task first),
    then counted per column; so whole texts never travel, and the aggregate
    needs no Expand over many ``count(DISTINCT ...)``.
    """
    def digest(c):
        v = F.col(f"`{c}`")
        return F.struct(F.lit(c).alias("column"), F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"),
                        v.isNotNull().alias("some"))
    long = df.select(F.inline(F.array(*[digest(c) for c in cols])))
    return (long.where("some").select("column", "a", "b").distinct()
            .groupBy("column").agg(F.count(F.lit(1)).cast("bigint").alias("n_distinct")))


def _contains_any(col: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.lower(col).contains(p)
    return out


def basic_role_expr() -> Column:
    """5-way role: id / date / numeric / categorical / text (first rule wins)."""
    name = F.col("column")
    numeric = F.col("kind").isin("integral", "fractional")
    return (F.when(_contains_any(name, L.BASIC_ID_PATTERNS), "id")
            .when(_contains_any(name, L.BASIC_DATE_PATTERNS) | (F.col("kind") == "temporal"), "date")
            .when(numeric, "numeric")
            .when(F.col("n_distinct") < 20, "categorical")
            .otherwise("text"))


def profile_role_expr() -> Column:
    """6-way role: id / datetime / binary / categorical / numeric / text.

    A native date or timestamp column is ``datetime`` first; a numeric column
    is never ``datetime`` because of its name.
    """
    name = F.col("column")
    kind = F.col("kind")
    numeric = kind.isin("integral", "fractional")
    nd = F.col("n_distinct")
    return (F.when(kind == "temporal", "datetime")
            .when(_contains_any(name, L.PROFILE_ID_PATTERNS), "id")
            .when(numeric & (nd == F.col("n")) & (nd > 50), "id")
            .when((kind == "string") & _contains_any(name, L.PROFILE_DATETIME_PATTERNS) & F.col("dt_ok"),
                  "datetime")
            .when(numeric & (nd == 2), "binary")
            .when(numeric & (nd <= 15) & (nd / F.greatest(F.col("n"), F.lit(1)) < 0.05), "categorical")
            .when(numeric, "numeric")
            .when(kind == "other", "text")
            .when((F.col("avg_len") > 60) | (nd > 30), "text")
            .otherwise("categorical"))


def roles_basic(df: DataFrame) -> DataFrame:
    return column_stats(df).select("column", "ord", basic_role_expr().alias("role"))


def roles_profile(df: DataFrame) -> DataFrame:
    return column_stats(df).select("column", "ord", profile_role_expr().alias("role"))


def domain_from_names(names, domains=L.DATASET_DOMAINS, default: str = "generic") -> str:
    joined = " ".join(n.lower() for n in names)
    best, best_score = default, 0
    for d, kws in domains:
        s = sum(1 for kw in kws if kw in joined)
        if s > best_score:
            best, best_score = d, s
    return best


def dataset_domain_expr(names_col: Column, domains=L.DATASET_DOMAINS, default: str = "generic") -> Column:
    """Domain from a space-joined lower-case name string; ties go to the first listed."""
    scored = []
    for i, (d, kws) in enumerate(domains):
        s = sum((names_col.contains(kw).cast("int") for kw in kws), F.lit(0))
        scored.append(F.struct(s.alias("score"), F.lit(-i).alias("neg_ord"), F.lit(d).alias("domain")))
    best = F.array_max(F.array(*scored))
    return F.when(best["score"] > 0, best["domain"]).otherwise(F.lit(default))


def table_summary(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """rows, columns, names, nulls per column, basic roles and domain (one row); ``stats``: ``column_stats`` of df where at hand."""
    st = (column_stats(df) if stats is None else stats).withColumn("role", basic_role_expr())
    ordered = F.array_sort(F.collect_list(F.struct("ord", "column", "nulls", "role")))
    names = F.transform(ordered, lambda s: s["column"])
    return st.agg(
        F.max("n").alias("rows"),
        F.count(F.lit(1)).cast("int").alias("columns"),
        ordered.alias("_o"),
    ).select(
        "rows", "columns",
        F.transform("_o", lambda s: s["column"]).alias("column_names"),
        F.map_from_entries(F.transform("_o", lambda s: F.struct(s["column"], s["nulls"]))).alias("missing"),
        F.map_from_entries(F.transform("_o", lambda s: F.struct(s["column"], s["role"]))).alias("roles"),
        dataset_domain_expr(F.array_join(F.transform("_o", lambda s: F.lower(s["column"])), " ")).alias("domain"),
    )
