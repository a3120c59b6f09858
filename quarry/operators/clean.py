"""Table cleaning: dedup, boolean to text, numeric coercion, imputation.

Two phases, as every data-dependent plan here:

1. one ``agg`` over the deduplicated table gathers, per column, the null
   count, how many values parse as numbers and the means.  The result is a
   single row (size bounded by the column count), collected to the driver.
2. a single projection applies the decisions.  Nothing per-row reaches the
   driver, and the table is read by Spark, never by Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import WS
from quarry.session import as_table

# What pandas.to_numeric accepts (after trimming): decimals, exponents, inf.
# Spark's own cast also takes '1d' or '1f'; the pattern keeps those out.
NUMERIC_TEXT = rf"(?i)^[{WS}]*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?)[{WS}]*$"

MISSING_LABEL = "Missing"


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "fractional"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def is_numeric_kind(k: str) -> bool:
    return k in ("integral", "fractional")


def parse_number(c: Column) -> Column:
    """Number from text the way pandas reads it; anything else is null."""
    return F.when(c.rlike(NUMERIC_TEXT), F.regexp_replace(c, rf"[{WS}]", "").try_cast("double"))


def nan_to_null(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop fully identical rows.  Map-side partial aggregation collapses a hot
    duplicate group inside each task before the shuffle."""
    return df.dropDuplicates()


def bool_to_string(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            cols.append(F.when(F.coalesce(F.col(f.name), F.lit(False)), "True").otherwise("False").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


@dataclass
class Cleaned:
    df: DataFrame
    rows: int
    nulls: dict            # nulls per column before filling
    kinds: dict            # column -> kind after cleaning
    coerced: list = field(default_factory=list)
    means: dict = field(default_factory=dict)

    @property
    def numeric(self) -> list:
        return [c for c, k in self.kinds.items() if is_numeric_kind(k)]


def clean_table(df: DataFrame, threshold: float = 0.5, dedup: bool = True,
                impute: bool = True, keep: bool = False) -> Cleaned:
    """Dedup, coerce mostly-numeric text columns, fill nulls.

    A string column becomes numeric when at least ``threshold`` of *all* rows
    (nulls count against) parse as numbers; values that do not parse become
    null and are then filled with the column mean like any numeric null.
    ``keep`` writes the deduplicated rows once, for callers that read the
    result several times: else each reading deduplicates the table again.
    """
    d = dedup_rows(df) if dedup else df
    if keep:
        d = as_table(d)
    fields = d.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        k = kind_of(f.dataType)
        aggs.append(F.count_if(nan_to_null(c, f.dataType).isNull()).alias(f"n{i}"))
        if k == "string":
            p = parse_number(c)
            aggs.append(F.count(p).alias(f"p{i}"))
            aggs.append(F.avg(p).alias(f"m{i}"))
        elif is_numeric_kind(k):
            aggs.append(F.avg(nan_to_null(c, f.dataType).cast("double")).alias(f"m{i}"))
    row = d.agg(*aggs).collect()[0]
    n = row["__n"]

    out, kinds, coerced, means, nulls = [], {}, [], {}, {}
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        k = kind_of(f.dataType)
        nulls[f.name] = row[f"n{i}"]
        if k == "boolean":
            out.append(F.when(F.coalesce(c, F.lit(False)), "True").otherwise("False").alias(f.name))
            kinds[f.name] = "string"
        elif k == "string" and n > 0 and row[f"p{i}"] >= n * threshold:
            m = row[f"m{i}"]
            coerced.append(f.name)
            means[f.name] = m
            v = parse_number(c)
            out.append((F.coalesce(v, F.lit(m)) if impute and m is not None else v).alias(f.name))
            kinds[f.name] = "fractional"
        elif k == "string":
            out.append((F.coalesce(c, F.lit(MISSING_LABEL)) if impute else c).alias(f.name))
            kinds[f.name] = "string"
        elif is_numeric_kind(k):
            m = row[f"m{i}"]
            means[f.name] = m
            v = nan_to_null(c, f.dataType)
            if impute and nulls[f.name] > 0 and m is not None:
                # pandas holds an integer column with gaps as float, and so do we
                target = "double" if k == "integral" else f.dataType.simpleString()
                out.append(F.coalesce(v.cast(target), F.lit(m).cast(target)).alias(f.name))
                kinds[f.name] = "fractional"
            else:
                out.append(v.alias(f.name))
                kinds[f.name] = k
        else:
            out.append(c)
            kinds[f.name] = k
    return Cleaned(d.select(*out), n, nulls, kinds, coerced, means)


def numeric_coerce(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return clean_table(df, threshold=threshold, dedup=False, impute=False).df


def impute(df: DataFrame) -> DataFrame:
    """Mean for numeric columns, the 'Missing' label for text columns."""
    return clean_table(df, dedup=False, impute=True).df


def dropna_subset(df: DataFrame, cols) -> DataFrame:
    return df.na.drop(subset=list(cols))
