"""Spark queries against their DuckDB oracle on the smallest fixture."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from quarry.sources.tables import TABLES

# a spread over every operator family; the full set runs in tools/check_oracle.py
KEYS = ["dedup_rows", "numeric_coerce", "clean_table", "roles_profile", "table_summary", "column_breakdown",
        "numeric_histogram", "box_stats", "categorical_counts", "event_count_trend", "correlation_matrix",
        "binary_vs_categorical", "scan_text_pages", "text_statistics", "tfidf_keywords", "keyphrases", "headings",
        "domain_detect", "sentiment", "readability", "page_keywords", "key_sentences", "topic_coherence",
        "sales_monthly_trend", "anomaly_iqr", "json_flatten", "history_kpis", "settings_upsert"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(E.oracle_sql()[key]).df()
    c1, r1 = _rows(got)
    c2, r2 = _rows(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 11
    assert df.columns == ["column", "ord", "type", "missing_percent", "unique_values", "summary"]
