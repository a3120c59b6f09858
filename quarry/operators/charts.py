"""Chart-data operators: the numbers behind every chart kind, as DataFrames.

Plans here are data-dependent in one way only: which columns to chart and
their ranges come from the profile (one row per column, collected once).
The data itself is only ever touched by Spark aggregations:

* histogram counts: one bin number per value, counted per (column, bin);
* KDE: values are counted first, grid points exploded over the distinct values
  and summed with map-side partial aggregation;
* quartiles: exact, from range-partitioned value counts (``quantiles``);
* value counts: unpivot -> groupBy (partial agg collapses hot values) -> top-k.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.profile import basic_role_expr, column_stats, profile_role_expr
from quarry.operators.quantiles import quantiles
from quarry.operators.topk import global_rank, top_k


@dataclass
class TableProfile:
    """Collected profile: one Row per column (bounded by the column count)."""

    rows: list

    @classmethod
    def of(cls, df: DataFrame, distinct: bool = True) -> "TableProfile":
        """``distinct=False`` leaves the distinct counts out (roles then mean little)."""
        st = column_stats(df, distinct).withColumn("role", profile_role_expr()) \
            .withColumn("basic_role", basic_role_expr())
        return cls(sorted(st.collect(), key=lambda r: r["ord"]))

    def stats(self, spark) -> DataFrame:
        """What ``table_summary`` reads of ``column_stats``, from the collected rows."""
        names = ["column", "ord", "kind", "n", "nulls", "n_distinct"]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in self.rows],
                                     "column string, ord int, kind string, n bigint, nulls bigint, n_distinct bigint")

    @property
    def n(self) -> int:
        return self.rows[0]["n"] if self.rows else 0

    @property
    def roles(self) -> dict:
        return {r["column"]: r["role"] for r in self.rows}

    def by_role(self, *roles) -> list:
        return [r["column"] for r in self.rows if r["role"] in roles]

    def by_basic_role(self, *roles) -> list:
        return [r["column"] for r in self.rows if r["basic_role"] in roles]

    def stat(self, col: str):
        for r in self.rows:
            if r["column"] == col:
                return r
        raise KeyError(col)


def _c(name: str):
    return F.col(f"`{name}`")


def _num(name: str):
    c = _c(name).cast("double")
    return F.when(~F.isnan(c), c)


# ---------------------------------------------------------------------------
# histogram
# ---------------------------------------------------------------------------

def hist_edges(lo: float, hi: float, bins: int) -> list:
    """Equal-width edges exactly as numpy builds them (i*step + lo, last = hi)."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    edges = [i * step + lo for i in range(bins)] + [hi]
    return edges


def numeric_histogram(df: DataFrame, cols=None, bins: int = 25, prof: TableProfile | None = None,
                      max_cols: int | None = None, min_values: int = 5) -> DataFrame:
    """Counts per equal-width bin between min and max, last bin closed; all numeric
    columns unless ``cols`` or ``max_cols`` says otherwise."""
    prof = prof or TableProfile.of(df)
    if cols is None:
        cols = prof.by_role("numeric")[:max_cols]
    cols = [c for c in cols if (prof.stat(c)["n"] - prof.stat(c)["nulls"]) >= min_values]
    schema = "column string, bin int, lo double, hi double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema + ", count bigint")
    frame, structs = [], []
    for c in cols:
        e = hist_edges(prof.stat(c)["min"], prof.stat(c)["max"], bins)
        frame += [(c, i, e[i], e[i + 1]) for i in range(bins)]
        lo, step, v = F.lit(e[0]), F.lit((e[-1] - e[0]) / bins), _num(c)
        edge = lambda i: i * step + lo
        i = F.least(F.greatest(F.floor((v - lo) / step), F.lit(0)), F.lit(bins - 1))
        i = F.when((i > 0) & (v < edge(i)), i - 1).when((i < bins - 1) & (v >= edge(i + 1)), i + 1).otherwise(i)
        structs.append(F.struct(F.lit(c).alias("column"), i.cast("int").alias("bin")))
    counts = (df.select(F.inline(F.array(*structs))).where(F.col("bin").isNotNull())
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    # the frame has ``bins`` rows per column
    return df.sparkSession.createDataFrame(frame, schema).join(counts, ["column", "bin"], "left").select(
        "column", "bin", "lo", "hi", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


# ---------------------------------------------------------------------------
# KDE
# ---------------------------------------------------------------------------

def numeric_kde(df: DataFrame, cols=None, points: int = 200, bins: int = 25,
                prof: TableProfile | None = None, max_cols: int | None = None) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on ``points`` grid points from min to max,
    scaled to histogram counts (n x bin width), as the histogram overlay."""
    prof = prof or TableProfile.of(df)
    if cols is None:
        cols = prof.by_role("numeric")[:max_cols]
    parts = []
    for c in cols:
        s = prof.stat(c)
        n = s["n"] - s["nulls"]
        if n < 2 or not s["std"]:
            continue
        bw = s["std"] * n ** (-1.0 / 5.0)
        lo, hi = s["min"], s["max"]
        width = (hist_edges(lo, hi, bins)[1] - hist_edges(lo, hi, bins)[0])
        scale = width / (bw * math.sqrt(2 * math.pi))
        step = (hi - lo) / (points - 1)
        v = _num(c)
        base = (df.select(v.alias("v")).where(F.col("v").isNotNull()).groupBy("v")
                .agg(F.count(F.lit(1)).cast("double").alias("w")))
        grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
        xs = F.when(F.col("point") == points - 1, F.lit(hi)).otherwise(F.col("point") * F.lit(step) + F.lit(lo))
        z = (F.col("x") - F.col("v")) / F.lit(bw)
        part = (base.select("v", "w", grid.alias("point"))
                .withColumn("x", xs)
                .groupBy("point", "x")
                .agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("s"))
                .select(F.lit(c).alias("column"), "point", "x", (F.col("s") * F.lit(scale)).alias("density")))
        parts.append(part)
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, point int, x double, density double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# quartiles and box statistics
# ---------------------------------------------------------------------------

QUARTILES = (0.25, 0.5, 0.75)
BOX_SCHEMA = ("column string, q1 double, median double, q3 double, whislo double, whishi double, "
              "n_fliers bigint, n bigint")


def _long(df: DataFrame, cols, extra=()) -> DataFrame:
    """(extra..., column, v): the numeric columns one below the other."""
    return df.select(*extra, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _num(c).alias("v")) for c in cols])))


def box_stats(df: DataFrame, cols=None, prof: TableProfile | None = None, max_cols: int | None = None,
              whis: float = 1.5) -> DataFrame:
    """q1, median, q3, whiskers (last value inside 1.5 IQR) and outlier count."""
    if cols is None:
        prof = prof or TableProfile.of(df)
        cols = prof.by_role("numeric")[:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], BOX_SCHEMA)
    quart = {r["column"]: r["q"] for r in quantiles(_long(df, cols), ["column"], "v", QUARTILES).collect()}  # one row per column
    structs = []
    for c in cols:
        if c not in quart:
            continue
        q1, med, q3 = quart[c]
        v = _num(c)
        iqr = q3 - q1
        lo, hi = q1 - whis * iqr, q3 + whis * iqr
        wlo = F.coalesce(F.min(F.when(v >= lo, v)), F.lit(q1))
        whi = F.coalesce(F.max(F.when(v <= hi, v)), F.lit(q3))
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(med).alias("median"),
            F.lit(q3).alias("q3"), wlo.alias("whislo"), whi.alias("whishi"),
            # a flier lies outside the whiskers, i.e. outside [lo, hi]
            F.count_if((v < lo) | (v > hi)).alias("n_fliers"), F.count(v).alias("n")))
    if not structs:
        return df.sparkSession.createDataFrame([], BOX_SCHEMA)
    return df.agg(F.array(*structs).alias("b")).select(F.inline("b"))


def box_outliers(df: DataFrame, boxes: DataFrame, cols, whis: float = 1.5) -> DataFrame:
    """(column, value, count): the values outside the fences of ``box_stats``."""
    iqr = F.col("q3") - F.col("q1")
    fences = boxes.select("column", (F.col("q1") - whis * iqr).alias("lo"), (F.col("q3") + whis * iqr).alias("hi"))
    return (_long(df, cols).join(F.broadcast(fences), "column")  # one row per column
            .where((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")))
            .groupBy("column", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("count")))


def grouped_box_stats(df: DataFrame, group: str, cols, whis: float = 1.5) -> DataFrame:
    """Box statistics of each column per value of ``group`` (null groups dropped).

    Exact quartiles per group and column, then a second pass joins them back
    (one row per group and column) for whiskers.
    """
    g = _c(group)
    vals = _long(df.where(g.isNotNull()), cols, extra=[g.alias("group")])
    q = quantiles(vals, ["group", "column"], "v", QUARTILES)
    long_q = q.select("group", "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    # the quartile side is one row per (group, column); AQE broadcasts it at
    # run time when it is small and falls back to a shuffle join when not
    j = vals.join(long_q, ["group", "column"], "left")
    iqr = F.col("q3") - F.col("q1")
    lo = F.col("q1") - whis * iqr
    hi = F.col("q3") + whis * iqr
    v = F.col("v")
    return j.groupBy("group", "column").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.coalesce(F.min(F.when(v >= lo, v)), F.first("q1")).alias("whislo"),
        F.coalesce(F.max(F.when(v <= hi, v)), F.first("q3")).alias("whishi"),
        F.count_if((v < lo) | (v > hi)).alias("n_fliers"),
        F.count(v).alias("n"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )


# ---------------------------------------------------------------------------
# value counts
# ---------------------------------------------------------------------------

def _unpivot_as_text(df: DataFrame, cols, extra=()) -> DataFrame:
    return df.select(*[_c(e) for e in extra], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("col_ord"), _c(c).cast("string").alias("value"))
        for i, c in enumerate(cols)])))


def categorical_counts(df: DataFrame, cols=None, top: int = 10, prof: TableProfile | None = None,
                       max_cols: int | None = None) -> DataFrame:
    """Top values per categorical/binary column; pct is of the values shown."""
    if cols is None:
        prof = prof or TableProfile.of(df)
        cols = prof.by_role("categorical", "binary")[:max_cols]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count bigint, pct double, chart string")
    long = _unpivot_as_text(df, cols).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    t = top_k(counts, "column", [F.desc("count"), F.asc("value")], top)
    from pyspark.sql import Window
    w = Window.partitionBy("column")
    return t.select("column", "rank", "value", "count",
                    (F.col("count") * 100.0 / F.sum("count").over(w)).alias("pct"),
                    F.when(F.count(F.lit(1)).over(w) <= 6, "pie+bar").otherwise("bar").alias("chart"))


def value_frequency(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Count per value, most frequent first (ties by value)."""
    c = _c(col)
    counts = df.where(c.isNotNull()).groupBy(c.cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    if top is not None:
        counts = counts.orderBy(F.desc("count"), F.asc("value")).limit(top)
    return global_rank(counts, [F.desc("count"), F.asc("value")])


# ---------------------------------------------------------------------------
# correlation, pairs, linear fit
# ---------------------------------------------------------------------------

def _pearson(x, y):
    both = x.isNotNull() & y.isNotNull()
    xm, ym = F.when(both, x), F.when(both, y)
    den = F.stddev_samp(xm) * F.stddev_samp(ym)
    return F.try_divide(F.covar_samp(xm, ym), F.when(den != 0, den))


def correlation_matrix(df: DataFrame, cols=None, prof: TableProfile | None = None, max_cols: int | None = None,
                       min_cols: int = 3) -> DataFrame:
    """Pearson r for the lower triangle (row after column), pairwise non-null."""
    if cols is None:
        prof = prof or TableProfile.of(df)
        cols = prof.by_role("numeric", "binary")
        if len(cols) < min_cols:
            cols = []
        cols = cols[:max_cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i > j]
    if not pairs:
        return df.sparkSession.createDataFrame([], "row string, col string, r double")
    return df.agg(F.array(*[
        F.struct(F.lit(cols[i]).alias("row"), F.lit(cols[j]).alias("col"),
                 _pearson(_num(cols[i]), _num(cols[j])).alias("r")) for i, j in pairs]).alias("p")
    ).select(F.inline("p"))


def top_correlated_pairs(df: DataFrame, cols=None, prof: TableProfile | None = None, top: int = 3) -> DataFrame:
    """Numeric pairs with the largest |r| (upper triangle, NaN dropped)."""
    if cols is None:
        prof = prof or TableProfile.of(df)
        cols = prof.by_role("numeric")
    pairs = [(i, j) for i in range(len(cols)) for j in range(len(cols)) if i < j]
    if not pairs:
        return df.sparkSession.createDataFrame([], "rank int, c1 string, c2 string, r double, abs_r double")
    allp = df.agg(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("c1"), F.lit(cols[j]).alias("c2"),
                 _pearson(_num(cols[i]), _num(cols[j])).alias("r")) for i, j in pairs]).alias("p")
    ).select(F.inline("p")).where(F.col("r").isNotNull())
    from pyspark.sql import Window
    w = Window.orderBy(F.desc(F.abs("r")), "i", "j")
    return (allp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("rank", "c1", "c2", "r", F.abs("r").alias("abs_r")))


def linear_fit(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Least-squares line of y on x (same as a degree-1 polyfit) and its
    ``points``-point trace from min(x) to max(x)."""
    xv, yv = _num(x), _num(y)
    both = xv.isNotNull() & yv.isNotNull()
    fit = df.agg(
        F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"),
        F.regr_r2(yv, xv).alias("r2"), F.regr_count(yv, xv).alias("n"),
        F.min(F.when(both, xv)).alias("xmin"), F.max(F.when(both, xv)).alias("xmax"))
    i = F.col("i")
    step = (F.col("xmax") - F.col("xmin")) / F.lit(points - 1)
    xs = F.when(i == points - 1, F.col("xmax")).otherwise(i * step + F.col("xmin"))
    return (fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
            .select(F.lit(x).alias("x_col"), F.lit(y).alias("y_col"), "i", xs.alias("x"),
                    (F.col("slope") * xs + F.col("intercept")).alias("y"),
                    "slope", "intercept", "r2", "n"))


POINT_SCHEMA = "pair string, x double, y double, hue string"


def pair_scatter(df: DataFrame, pairs, hue: str | None = None, max_points: int | None = None, seed: int = 42) -> DataFrame:
    """Points for each (x, y) pair plus the colour column, nulls dropped.

    All points, unless the caller asks for at most ``max_points``: then those
    with the smallest seeded row hashes.
    """
    out = df.sparkSession.createDataFrame([], POINT_SCHEMA)
    for x, y in pairs:
        keep = list(dict.fromkeys([x, y] + ([hue] if hue else [])))
        pts = df.where(_c(x).isNotNull() & _c(y).isNotNull() & (_c(hue).isNotNull() if hue else F.lit(True)))
        if max_points is not None:
            pts = pts.orderBy(F.xxhash64(*[_c(k) for k in df.columns], F.lit(seed))).limit(max_points)
        out = out.unionByName(pts.select(*[_c(k) for k in keep]).select(
            F.lit(f"{x}|{y}").alias("pair"), _c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"),
            (_c(hue).cast("string") if hue else F.lit(None).cast("string")).alias("hue")))
    return out


# ---------------------------------------------------------------------------
# target-based views
# ---------------------------------------------------------------------------

def binary_vs_numeric(df: DataFrame, target: str | None = None, cols=None, prof: TableProfile | None = None,
                      max_cols: int | None = None) -> DataFrame:
    """Quartiles and range of each numeric column per value of the binary target."""
    if target is None or cols is None:
        prof = prof or TableProfile.of(df)
        bins_, nums = prof.by_role("binary"), prof.by_role("numeric")
        if not bins_ or not nums:
            return df.sparkSession.createDataFrame(
                [], "target string, column string, q1 double, median double, q3 double, whislo double, "
                    "whishi double, n_fliers bigint, n bigint, min double, max double")
        target = target or bins_[0]
        cols = cols or nums[:max_cols]
    g = grouped_box_stats(df, target, cols)
    return g.withColumn("target", F.col("group").cast("string")).drop("group")


def crosstab_share(df: DataFrame, target: str, cols) -> DataFrame:
    """Row-normalised cross-tab of each column against ``target`` (long form)."""
    long = _unpivot_as_text(df, cols, extra=[target]).where(
        F.col("value").isNotNull() & _c(target).isNotNull())
    counts = long.groupBy("column", "value", _c(target).cast("string").alias("target")).agg(
        F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window
    w = Window.partitionBy("column", "value")
    return counts.withColumn("share", F.col("count") / F.sum("count").over(w))


def binary_vs_categorical(df: DataFrame, target: str | None = None, cols=None, prof: TableProfile | None = None,
                          max_cols: int | None = None) -> DataFrame:
    if target is None or cols is None:
        prof = prof or TableProfile.of(df)
        bins_, cats = prof.by_role("binary"), prof.by_role("categorical")
        if not bins_ or not cats:
            return df.sparkSession.createDataFrame(
                [], "column string, value string, target string, count bigint, share double")
        target = target or bins_[0]
        cols = cols or cats[:max_cols]
    return crosstab_share(df, target, cols)


def dataset_overview(df: DataFrame, prof: TableProfile | None = None) -> DataFrame:
    """Panels of the overview card: missing %, role counts, summary table.

    Missing shares are measured on the table as given (before any filling).
    """
    st = column_stats(df).withColumn("role", profile_role_expr())
    missing = st.where(F.col("nulls") > 0).select(
        F.lit("missing").alias("panel"), F.col("column").alias("label"),
        (F.col("nulls") * 100.0 / F.col("n")).alias("value"))
    roles = st.groupBy("role").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("roles").alias("panel"), F.col("role").alias("label"), "value")
    summ = st.agg(
        F.max("n").cast("double").alias("Rows"), F.count(F.lit(1)).cast("double").alias("Columns"),
        F.count_if(F.col("role") == "numeric").cast("double").alias("Numeric"),
        F.count_if(F.col("role") == "categorical").cast("double").alias("Categorical"),
        F.count_if(F.col("role") == "binary").cast("double").alias("Binary"),
        F.count_if(F.col("role") == "datetime").cast("double").alias("Datetime"),
        F.count_if(F.col("nulls") > 0).cast("double").alias("Missing cols"),
    ).select(F.lit("summary").alias("panel"), F.expr(
        "stack(7, 'Rows', `Rows`, 'Columns', `Columns`, 'Numeric', `Numeric`, 'Categorical', `Categorical`, "
        "'Binary', `Binary`, 'Datetime', `Datetime`, 'Missing cols', `Missing cols`) as (label, value)"))
    return missing.unionByName(roles).unionByName(summ)
