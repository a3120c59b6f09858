"""Golden edge cases on inline rows."""

import json

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import charts as C
from quarry.operators import clean as CL
from quarry.operators import text_ops as TO
from quarry.operators import text_pages as TP
from quarry.operators import text_structure as TS
from quarry.plans import documents as D
from quarry.sources import files as FS


def test_numeric_text_like_pandas(spark):
    vals = ["1d", " 12 ", "1e3", "inf", "NaN", "0x10", "1,000", None, "7", "-2.5"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(CL.parse_number(F.col("x"))).collect()]
    assert got == [None, 12.0, 1000.0, float("inf"), None, None, None, None, 7.0, -2.5]


def test_coercion_threshold(spark):
    # 5 of 10 rows parse (50 %): numeric; 4 of 10: stays text, filled with "Missing"
    half = spark.createDataFrame([(str(i) if i < 5 else "a",) for i in range(10)], "x string")
    assert dict(CL.clean_table(half, dedup=False).kinds)["x"] == "fractional"
    less = spark.createDataFrame([(str(i) if i < 4 else None,) for i in range(10)], "x string")
    c = CL.clean_table(less, dedup=False)
    assert c.kinds["x"] == "string"
    assert sorted(r[0] for r in c.df.collect()).count("Missing") == 6


def test_nullable_boolean_and_mean_fill(spark):
    df = spark.createDataFrame([(True, 1), (None, None), (False, 3)], "b boolean, n int")
    rows = CL.clean_table(df, dedup=False).df.collect()
    assert [r.b for r in rows] == ["True", "False", "False"]
    assert [r.n for r in rows] == [1.0, 2.0, 3.0]


def test_dedup_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    once = CL.dedup_rows(df)
    assert once.count() == 2 and CL.dedup_rows(once).count() == 2


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i), float(2 * i)) for i in range(20)], "c double, a double, b double")
    rows = {(r.row, r.col): r.r for r in C.correlation_matrix(df, cols=["c", "a", "b"]).collect()}
    assert rows[("a", "c")] is None and abs(rows[("b", "a")] - 1.0) < 1e-12


def test_histogram_counts_sum_to_n(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("v"))
    prof = C.TableProfile.of(df)
    h = C.numeric_histogram(df, cols=["v"], prof=prof)
    assert h.agg(F.sum("count")).first()[0] == 1000 and h.count() == 25


def test_crosstab_rows_sum_to_one(spark):
    df = spark.createDataFrame([(i % 3, "abc"[i % 2]) for i in range(30)], "t int, c string")
    s = C.crosstab_share(df, "t", ["c"]).groupBy("value").agg(F.sum("share").alias("s"))
    assert all(abs(r.s - 1) < 1e-12 for r in s.collect())


def test_paging_keeps_every_line(spark):
    text = "\n".join(f"line {i}" for i in range(1, 20)) + "\n\n   \n"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pages = TP.scan_text_pages(docs).orderBy("page_no").collect()
    assert [p.page_no for p in pages] == [1, 2, 3]
    assert " ".join(p.page for p in pages).split(" ")[1::2] == [str(i) for i in range(1, 20)]


def test_empty_document_record(spark):
    docs = spark.createDataFrame([(1, ""), (2, "Growth was strong and robust this quarter.")],
                                 "doc_id long, text string")
    rows = {r.doc_id: r for r in D.text_analysis(docs).collect()}
    assert rows[1].document_type == "unknown" and rows[1].readability == "Unknown"
    assert rows[2].sentiment == "Positive"


def test_no_sentiment_words_is_negative(spark):
    df = spark.createDataFrame([(1, "plain words only here")], "doc_id long, text string")
    assert TO.sentiment(df, "text").first().sentiment == "Negative"


def test_substring_domain_match(spark):
    # 'act' hits 'factor' under substring matching, not under word matching
    df = spark.createDataFrame([(1, "a factor")], "doc_id long, text string")
    lists = [("legal", ["act"])]
    sub = df.select(TO.keyword_class(F.col("text"), lists, "general")).first()[0]
    word = df.select(TO.keyword_class(F.col("text"), lists, "general", match="word")).first()[0]
    assert (sub, word) == ("legal", "general")


def test_headings_and_page_cleaning(spark):
    page = "1.2 Introduction To Methods\nREPORT SUMMARY SECTION\nPage 3\n- 2 -\nBody text follows here."
    pages = spark.createDataFrame([(1, 1, 1, page)], TP.PAGE_SCHEMA)
    titles = [r.title for r in TO.headings(pages).orderBy("ord").collect()]
    assert titles == ["1.2 Introduction To Methods", "REPORT SUMMARY SECTION"]
    clean = TP.page_clean(pages).first()
    assert "Page 3" not in clean.clean_text and "- 2 -" not in clean.clean_text


def test_page_summary_cut_at_400(spark):
    long_sentence = ("Alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 12).strip()
    pages = spark.createDataFrame([(1, 1, 1, long_sentence)], TP.PAGE_SCHEMA)
    s = TS.page_breakdown(pages, max_chars=400).first().summary
    assert len(s) <= 400
    assert len(TS.page_breakdown(pages).first().summary) > 100


def test_json_flatten_nested(spark):
    doc = json.dumps({"a": {"b": [1, {"c": True}], "d": "x"}, "e": [[1, 2], 3]})
    df = spark.createDataFrame([(1, doc)], "id long, j string")
    lines = sorted(r.line for r in FS.json_flatten(df, "id", "j").collect())
    assert lines == sorted(["a.b[0]: 1", "a.b[1].c: True", "a.d: x", "e[0]: [1, 2]", "e[1]: 3"])


def test_json_flatten_any_depth(spark):
    doc = {"k": 1}
    for _ in range(20):
        doc = {"k": doc}
    odd = {"a": [["x,y", True, None, "it's", 'say "hi"']]}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(odd)), (3, "no json"), (4, None)], "id long, j string")
    lines = {r.doc_id: r.line for r in FS.json_flatten(df, "id", "j").collect()}
    assert lines == {1: ".".join(["k"] * 21) + ": 1", 2: "a[0]: " + str(odd["a"][0])}


def test_exact_quantiles_match_percentile(spark):
    from quarry.operators.quantiles import quantiles
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.when(F.col("id") % 11 != 0, (F.hash("id") % 500) / 7.0).alias("v"))
    probs = (0.0, 0.05, 0.25, 0.5, 0.75, 1.0)
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    got = {r.g: r.q for r in quantiles(df, ["g"], "v", probs).collect()}
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for g in got for a, b in zip(got[g], want[g]))
    assert quantiles(df.limit(0), ["g"], "v", probs).count() == 0


def test_paging_time_is_linear(spark):
    """Four times the lines take about four times as long, not sixteen."""
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, "\n".join(f"line {i} of the text" for i in range(n)))], "doc_id long, text string")
        start = time.time()
        assert TP.scan_text_pages(docs, lines_per_page=1).count() == n
        return time.time() - start

    seconds(500)
    small = min(seconds(2000) for _ in range(3))
    assert min(seconds(8000) for _ in range(2)) < 9 * small + 1


def test_empty_inputs_do_not_crash(spark):
    df = spark.createDataFrame([(None, None)], "v double, s string")
    assert C.box_stats(df, cols=["v"]).count() == 0
    assert C.categorical_counts(df.select("v"), cols=[]).count() == 0
    assert C.pair_scatter(df, []).count() == 0
    from quarry.operators import anomaly as AN
    assert AN.anomaly_iforest(df.limit(0), ["v"]).first().anomaly_count == 0


def test_history_ids_follow_time(spark):
    from quarry.operators import history as H
    from quarry.sources.sinks import scratch_dir, sink_history_append
    rows = [(7, f"f{i}", i, "csv", "text", True, f"2024-01-{i + 1:02d} 10:00:00") for i in range(9)]
    df = spark.createDataFrame(rows, "user_id long, file_name string, file_size long, file_type string, insights string, "
                                     "has_report boolean, upload_date string").withColumn("upload_date", F.col("upload_date").cast("timestamp"))
    path = scratch_dir(spark, "history")
    sink_history_append(df, path)
    got = H.history_list(spark.read.parquet(path)).orderBy("position").collect()
    assert [r.file_name for r in got] == [f"f{i}" for i in range(8, -1, -1)]


def test_replayed_batch_adds_no_row(spark):
    from quarry.sources.sinks import scratch_dir
    from quarry.streaming.ingest import write_analysis
    batch = spark.createDataFrame([(1, "Some text here. More text follows.")], "doc_id long, text string")
    path = scratch_dir(spark, "stream")
    for k in (0, 1, 1):
        write_analysis(batch, k, path)
    assert spark.read.parquet(path).count() == 2


def test_text_plans_stay_in_jvm(spark):
    docs = spark.createDataFrame([(1, "Some text here.\nMore text.")], "doc_id long, text string")
    plan = D.text_analysis(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_document_stream(spark):
    import os
    import uuid

    from quarry.session import checkpoint_dir
    from quarry.streaming.ingest import start_document_stream
    base = os.path.join(checkpoint_dir(spark), f"stream-test-{uuid.uuid4().hex}")
    src, out = os.path.join(base, "in"), os.path.join(base, "out")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text") \
        .write.parquet(src)
    q = start_document_stream(spark, src, out, name=f"t{uuid.uuid4().hex[:8]}", trigger_once=True)
    q.awaitTermination(300)
    n_docs = spark.read.parquet(src).count()
    assert spark.read.parquet(out).select("doc_id").distinct().count() == n_docs


def test_two_decimals_round_the_exact_value(spark):
    values = [0.575, 0.125, 0.375, 2.675, 1.005, 0.285, 10.235, 1.115, 8.345, 0.0, -0.0, -0.001, -2.675, 0.995, 99.995, 1e12 + 0.125, 123456.785, 0.005, -0.125]
    values += [k / 1000 for k in range(5, 20000, 10)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in df.select("x", T.two_decimals(F.col("x"))).collect()]
    assert got == [(x, f"{x:.2f}") for x in values]
    empty = spark.createDataFrame([(None,), (1e15,)], "x double").select(T.two_decimals(F.col("x"))).collect()
    assert [r[0] for r in empty] == [None, "1000000000000000.00"]


def test_csv_encoding_is_decided_by_the_bytes(spark, tmp_path):
    for name, raw in {"latin": "name,n\ncafé,1\n".encode("latin-1"), "utf8": "name,n\ncafé �,2\n".encode()}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_bytes(raw)
    assert [r.name for r in FS.scan_csv(spark, str(tmp_path / "latin")).collect()] == ["café"]
    assert [r.name for r in FS.scan_csv(spark, str(tmp_path / "utf8")).collect()] == ["café �"]
    both = tmp_path / "both"
    both.mkdir()
    for name in ("latin", "utf8"):
        (both / f"{name}.csv").write_bytes((tmp_path / name / "a.csv").read_bytes())
    assert sorted(r.name for r in FS.scan_csv(spark, str(both)).collect()) == ["café", "café �"]
