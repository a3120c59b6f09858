"""The date probe, the cut of the forest, and the table that a report reads several times."""

import datetime

from pyspark.sql import functions as F

from quarry.operators import anomaly as AN
from quarry.operators import clean as CL
from quarry.operators import profile as P
from quarry.operators import quantiles as Q
from quarry.plans import registry


def test_texts_that_cannot_be_dates_are_not_tried(spark):
    texts = ["2024-01-02", "2024-01-02 03:04:05", "01/31/2024", "31-01-2024", "2024/01/31", "F", "", "open", None, "7 of 9", "n/a", "2024", "x-y"]
    df = spark.createDataFrame([(t,) for t in texts], "l_linestatus string")
    plain = F.coalesce(F.try_to_timestamp("l_linestatus"), *[F.try_to_timestamp("l_linestatus", F.lit(f)) for f in P.DATE_FORMATS])
    got = df.select(P.parse_ts(F.col("l_linestatus")).alias("got"), plain.alias("want"))
    assert [r["got"] for r in got.collect()] == [r["want"] for r in got.collect()]
    assert "RLIKE" in df.select(P.parse_ts(F.col("l_linestatus")))._jdf.queryExecution().optimizedPlan().toString()
    assert P.column_stats(df, distinct=False).first()["dt_ok"] is False


def test_value_at_a_rank(spark):
    values = [((i * 7919) % 1009) ** 3 / 1e3 - 2e5 for i in range(3000)] + [0.25] * 2000 + [-1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values)
    for rank in (0, 1, 150, 1111, 2600, 5000, 5001):
        assert Q.value_at(df, "v", rank, parts=16, few=40) == ordered[rank]


def test_flagged_rows_are_those_beyond_the_exact_percentile(spark):
    df = spark.range(3000).select((F.col("id") * 37 % 501).cast("double").alias("a"), (F.col("id") * 11 % 97).alias("b"))
    neg = [-r["_score"] for r in AN.iforest_scores(df, ["a", "b"], trees=20, psi=64).collect()]
    cut = spark.createDataFrame([(x,) for x in neg], "x double").agg(F.percentile("x", 0.05)).first()[0]
    got = AN.anomaly_iforest(df, ["a", "b"], trees=20, psi=64).first()
    assert (got["anomaly_count"], got["total_records"]) == (sum(x < cut for x in neg), 3000)


def test_the_report_deduplicates_its_table_once(spark, monkeypatch, tmp_path):
    rows = [(i % 400, i % 7, float(i % 400) * 3, "ab"[i % 2], datetime.datetime(2024, 1, 1 + i % 28)) for i in range(2000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_tax double, l_returnflag string, l_shipdate timestamp") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    plans, plain = [], CL.clean_table
    monkeypatch.setattr(CL, "clean_table", lambda *a, **k: plans.append(plain(*a, **k)) or plans[-1])
    report = registry.QUERIES["table_report_full"](spark, str(tmp_path)).first()
    assert "Aggregate" not in plans[0].df._jdf.queryExecution().optimizedPlan().toString()
    assert plans[0].df.count() == len(set(rows)) and f"{len(set(rows)):,} rows, 5 columns" in report["executive_summary"]
