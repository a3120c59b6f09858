"""Registered queries: one callable per operator key, ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or views Spark derives from them) in
full.  Floating outputs are rounded to 6 places so that the oracle can
compare values across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import breakdown as B
from quarry.operators import charts as C
from quarry.operators import clean as CL
from quarry.operators import profile as P
from quarry.operators import trends as TR
from quarry.sources import tables as T

QUERIES: dict = {}

# All numeric columns of lineitem, and those that its role rules call categorical
# (checked by ``roles_profile``); named so that a chart query has the same
# columns at every scale factor.
LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CATEGORICAL = ["l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def r6(df: DataFrame, *cols) -> DataFrame:
    """Round the given (or all double) columns to 6 places."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if c in names else F.col(f"`{c}`")
                       for c in df.columns])


# ---------------------------------------------------------------------------
# 2-B cleaning, roles
# ---------------------------------------------------------------------------

@query("dedup_rows")
def q_dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = T.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return CL.dedup_rows(li)


@query("bool_to_string")
def q_bool_to_string(spark, sf):
    return CL.bool_to_string(T.doc_labels(spark, sf).select("doc_id", "toxic_flag"))


@query("numeric_coerce")
def q_numeric_coerce(spark, sf):
    return CL.numeric_coerce(T.events_mixed(spark, sf))


@query("impute_mean")
def q_impute_mean(spark, sf):
    return r6(CL.impute(T.doc_labels(spark, sf).select("doc_id", "n_chars", "quality")))


@query("impute_label")
def q_impute_label(spark, sf):
    return CL.impute(T.doc_labels(spark, sf).select("doc_id", "lang", "toxic_text"))


@query("clean_table")
def q_clean_table(spark, sf):
    return r6(CL.clean_table(T.doc_labels(spark, sf)).df)


@query("table_summary")
def q_table_summary(spark, sf):
    s = P.table_summary(T.table(spark, sf, "lineitem"))
    return s.select(
        "rows", "columns", F.array_join("column_names", ",").alias("column_names"),
        F.array_join(F.transform(F.map_entries("missing"), lambda e: F.concat_ws(":", e["key"], e["value"])),
                     ",").alias("missing"),
        F.array_join(F.transform(F.map_entries("roles"), lambda e: F.concat_ws(":", e["key"], e["value"])),
                     ",").alias("roles"),
        "domain")


@query("roles_basic")
def q_roles_basic(spark, sf):
    return P.roles_basic(T.table(spark, sf, "lineitem"))


@query("roles_profile")
def q_roles_profile(spark, sf):
    return P.roles_profile(T.table(spark, sf, "lineitem"))


@query("roles_profile_customer")
def q_roles_profile_customer(spark, sf):
    return P.roles_profile(T.table(spark, sf, "customer"))


@query("sample_cap")
def q_sample_cap(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    return C.pair_scatter(li, [("l_quantity", "l_extendedprice")], hue="l_returnflag", max_points=5000)


@query("dropna_subset")
def q_dropna_subset(spark, sf):
    return CL.dropna_subset(T.doc_labels(spark, sf).select("doc_id", "quality", "lang"), ["quality"])


# ---------------------------------------------------------------------------
# 2-C profile columns
# ---------------------------------------------------------------------------

@query("column_breakdown")
def q_column_breakdown(spark, sf):
    return B.column_breakdown(T.table(spark, sf, "lineitem"))


@query("column_breakdown_docs")
def q_column_breakdown_docs(spark, sf):
    return B.column_breakdown(T.doc_labels(spark, sf))


@query("col_missing_pct")
def q_col_missing_pct(spark, sf):
    return B.column_profile(T.doc_labels(spark, sf)).select("column", "missing_percent")


@query("col_distinct")
def q_col_distinct(spark, sf):
    return P.column_stats(T.table(spark, sf, "orders")).select(
        "column", F.col("n_distinct").alias("unique_values"))


@query("col_numeric_stats")
def q_col_numeric_stats(spark, sf):
    st = P.column_stats(T.table(spark, sf, "lineitem"), distinct=False).where(F.col("kind").isin("integral", "fractional"))
    return r6(st.select("column", "min", "max", "mean", "std"))


@query("col_skew")
def q_col_skew(spark, sf):
    st = P.column_stats(T.table(spark, sf, "events"), distinct=False).where(F.col("kind").isin("integral", "fractional"))
    return r6(st.select("column", "skew", B.skew_label(F.col("skew")).alias("skew_label")))


@query("col_date_span")
def q_col_date_span(spark, sf):
    st = P.column_stats(T.table(spark, sf, "orders"), distinct=False).where(F.col("kind") == "temporal")
    return st.select("column", F.date_format("dt_min", "yyyy-MM-dd").alias("date_min"),
                     F.date_format("dt_max", "yyyy-MM-dd").alias("date_max"),
                     TR.span_days(F.col("dt_min"), F.col("dt_max")).alias("span_days"))


@query("col_top_values")
def q_col_top_values(spark, sf):
    o = T.table(spark, sf, "orders")
    return B.top_values(o, ["o_orderstatus", "o_orderpriority"], 3)


# ---------------------------------------------------------------------------
# 2-C chart data
# ---------------------------------------------------------------------------

@query("numeric_histogram")
def q_numeric_histogram(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return r6(C.numeric_histogram(li, cols=LI_NUMERIC, prof=C.TableProfile.of(li.select(*LI_NUMERIC), distinct=False)))


@query("numeric_kde")
def q_numeric_kde(spark, sf):
    return r6(C.numeric_kde(T.table(spark, sf, "events"), cols=["value"], prof=C.TableProfile.of(T.table(spark, sf, "events").select("value"), distinct=False)))


@query("box_stats")
def q_box_stats(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return r6(C.box_stats(li, cols=LI_NUMERIC))


@query("categorical_counts")
def q_categorical_counts(spark, sf):
    return r6(C.categorical_counts(T.table(spark, sf, "lineitem"), cols=LI_CATEGORICAL))


@query("trend_granularity")
def q_trend_granularity(spark, sf):
    return TR.trend_granularity(T.table(spark, sf, "orders"), "o_orderdate")


@query("datetime_trend")
def q_datetime_trend(spark, sf):
    return r6(TR.datetime_trend(T.table(spark, sf, "orders")))


@query("datetime_trend_day")
def q_datetime_trend_day(spark, sf):
    return r6(TR.datetime_trend(T.table(spark, sf, "events")))


@query("event_count_trend")
def q_event_count_trend(spark, sf):
    return TR.event_count_trend(T.table(spark, sf, "events").select("ts", "event_type"))


@query("year_month_pivot")
def q_year_month_pivot(spark, sf):
    o = T.table(spark, sf, "orders").select("o_orderdate", F.col("o_totalprice").alias("price_score"))
    return r6(TR.year_month_pivot(o, "o_orderdate", TR.severity_column(o.columns)))


@query("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return r6(C.correlation_matrix(T.table(spark, sf, "lineitem"), cols=LI_NUMERIC))


@query("top_correlated_pairs")
def q_top_correlated_pairs(spark, sf):
    return r6(C.top_correlated_pairs(T.table(spark, sf, "lineitem"), cols=LI_NUMERIC))


@query("pair_scatter")
def q_pair_scatter(spark, sf):
    li = T.table(spark, sf, "lineitem")
    prof = C.TableProfile.of(li)
    pairs = [(r["c1"], r["c2"]) for r in C.top_correlated_pairs(li, prof=prof).collect()]
    hue = (prof.by_role("binary") or prof.by_role("categorical") or [None])[0]
    return C.pair_scatter(li, pairs, hue=hue)


@query("linear_fit")
def q_linear_fit(spark, sf):
    return r6(C.linear_fit(T.delivery_view(spark, sf), "distance_km", "delivery_time_min"))


@query("binary_vs_numeric")
def q_binary_vs_numeric(spark, sf):
    return r6(C.binary_vs_numeric(T.labelled_docs(spark, sf)))


@query("binary_vs_categorical")
def q_binary_vs_categorical(spark, sf):
    return r6(C.binary_vs_categorical(T.labelled_docs(spark, sf)))


@query("dataset_overview")
def q_dataset_overview(spark, sf):
    return r6(C.dataset_overview(T.doc_labels(spark, sf)))


# ---------------------------------------------------------------------------
# 2-F text operators (documents: one row per document; conversations: one
# conversation per document, one turn per page)
# ---------------------------------------------------------------------------

from quarry.operators import row_terms as RT  # noqa: E402
from quarry.operators import text_ops as TO  # noqa: E402
from quarry.operators import text_pages as TP  # noqa: E402
from quarry.operators import text_structure as TS  # noqa: E402
from quarry.plans import documents as D  # noqa: E402


def _docs(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "text")


def _prep(spark, sf):
    return D.prepared(_docs(spark, sf))


def _pages(spark, sf):
    return TP.scan_text_pages(_docs(spark, sf))


@query("scan_text_pages")
def q_scan_text_pages(spark, sf):
    return _pages(spark, sf)


@query("text_normalize")
def q_text_normalize(spark, sf):
    return TO.text_normalize(TP.doc_content(_docs(spark, sf)))


@query("text_statistics")
def q_text_statistics(spark, sf):
    return r6(TO.text_statistics(_prep(spark, sf), "text", "n_pages"))


@query("text_statistics_raw")
def q_text_statistics_raw(spark, sf):
    p = _prep(spark, sf)
    return r6(TO.text_statistics(p, "content", "n_pages"))


@query("tfidf_keywords")
def q_tfidf_keywords(spark, sf):
    return r6(TO.tfidf_of_documents(_docs(spark, sf), TP.page_array(F.col("text")), 20))


@query("tfidf_conversations")
def q_tfidf_conversations(spark, sf):
    return r6(TO.tfidf_keywords(TP.conversation_pages(T.table(spark, sf, "conversations")), 20))


@query("keyphrases")
def q_keyphrases(spark, sf):
    return TO.keyphrases(_prep(spark, sf), "text", 10)


def numbered_docs(spark, sf):
    """documents whose every line is numbered ("3 Line text"), so heading rules fire."""
    from quarry.functions.text import split_lines
    d = _docs(spark, sf)
    return d.select("doc_id", F.array_join(F.transform(split_lines(F.col("text")),
                                                       lambda l, i: F.concat((i + 1).cast("string"), F.lit(" "), l)),
                                           "\n").alias("text"))


@query("headings")
def q_headings(spark, sf):
    return TO.headings_of_documents(numbered_docs(spark, sf), TP.page_array(F.col("text"), keep_newlines=True), 20)


@query("domain_detect")
def q_domain_detect(spark, sf):
    return TO.domain_detect(_prep(spark, sf), "text")


@query("document_type")
def q_document_type(spark, sf):
    return TO.document_type(_prep(spark, sf), "cleaned_text")


@query("sentiment")
def q_sentiment(spark, sf):
    return TO.sentiment(_prep(spark, sf), "text")


@query("sentiment_raw")
def q_sentiment_raw(spark, sf):
    return TO.sentiment(_docs(spark, sf), "text")


@query("readability")
def q_readability(spark, sf):
    return r6(TO.readability(_prep(spark, sf), "content"))


@query("nlp_keywords")
def q_nlp_keywords(spark, sf):
    return TO.nlp_keywords(_prep(spark, sf), "cleaned_text", 20, (1, 2))


@query("nlp_bigrams")
def q_nlp_bigrams(spark, sf):
    return TO.nlp_keywords(_prep(spark, sf), "cleaned_text", 10, (2, 2))


@query("nlp_word_stats")
def q_nlp_word_stats(spark, sf):
    return r6(TS.nlp_word_stats(_prep(spark, sf), "cleaned_text"))


@query("summary_sentences")
def q_summary_sentences(spark, sf):
    return TS.summary_sentences(TP.scan_text_pages(_docs(spark, sf), keep_newlines=True))


@query("repeated_header")
def q_repeated_header(spark, sf):
    return TP.repeated_header(TP.scan_text_pages(_docs(spark, sf), lines_per_page=1))


@query("page_clean")
def q_page_clean(spark, sf):
    return TP.page_clean(TP.scan_text_pages(_docs(spark, sf), keep_newlines=True)).select(
        "doc_id", "page_no", "clean_text")


@query("page_chunk_words")
def q_page_chunk_words(spark, sf):
    return TP.page_chunk_words(_prep(spark, sf))


@query("page_keywords")
def q_page_keywords(spark, sf):
    return TS.page_keywords(TP.page_clean(_pages(spark, sf)))


@query("key_sentences")
def q_key_sentences(spark, sf):
    return r6(TS.key_sentences(TP.page_clean(_pages(spark, sf))))


@query("page_breakdown")
def q_page_breakdown(spark, sf):
    b = TS.page_breakdown(_pages(spark, sf))
    return b.select("doc_id", "page_no", "heading", F.array_join("keywords", ", ").alias("keywords"),
                    "word_count", "summary")


@query("page_heading")
def q_page_heading(spark, sf):
    clean = TP.page_clean(TP.scan_text_pages(numbered_docs(spark, sf), keep_newlines=True))
    return clean.select("doc_id", "page_no", TS.heading_of(F.col("lines")).alias("heading"))


@query("lexical_diversity")
def q_lexical_diversity(spark, sf):
    return r6(_prep(spark, sf).select("doc_id", *TO.lexical_diversity_cols(F.col("cleaned_text"))))


@query("sentence_complexity")
def q_sentence_complexity(spark, sf):
    return r6(_prep(spark, sf).select("doc_id", *TO.sentence_complexity_cols(F.col("content"))))


@query("term_density")
def q_term_density(spark, sf):
    terms = F.transform(RT.tfidf(F.col("pages"), 5), lambda t: t["keyword"])
    return r6(TO.term_density(_prep(spark, sf), terms, "cleaned_text"))


@query("topic_coherence")
def q_topic_coherence(spark, sf):
    return r6(TO.topic_coherence(_docs(spark, sf), TP.page_array(F.col("text")), 10))


@query("linguistic_summary")
def q_linguistic_summary(spark, sf):
    return r6(D.linguistic_summary(_docs(spark, sf)))


@query("research_sections")
def q_research_sections(spark, sf):
    return TS.research_sections(_docs(spark, sf))


@query("section_clean")
def q_section_clean(spark, sf):
    return TS.research_sections_clean(_docs(spark, sf))


@query("text_analysis")
def q_text_analysis(spark, sf):
    a = D.text_analysis(_docs(spark, sf))
    return a.select("doc_id", "document_type", "executive_summary",
                    F.array_join("key_insights", " || ").alias("key_insights"),
                    F.array_join("recommendations", " || ").alias("recommendations"),
                    F.array_join("keywords", ", ").alias("keywords"),
                    F.array_join("keyphrases", ", ").alias("keyphrases"),
                    F.array_join("topics", ", ").alias("topics"),
                    F.size("sections").alias("n_sections"), "sentiment", "readability",
                    F.round("readability_grade", 6).alias("readability_grade"),
                    F.col("statistics.word_count").alias("word_count"))


# ---------------------------------------------------------------------------
# 2-D domain views (alias views over the driver tables, see sources.tables)
# ---------------------------------------------------------------------------

from quarry.operators import anomaly as AN  # noqa: E402
from quarry.operators import domains as DV  # noqa: E402


@query("health_counts")
def q_health_counts(spark, sf):
    return DV.health_counts(T.stroke_view(spark, sf))


@query("health_distributions")
def q_health_distributions(spark, sf):
    return r6(DV.health_distributions(T.stroke_view(spark, sf)))


@query("delivery_scatter_fit")
def q_delivery_scatter_fit(spark, sf):
    return r6(DV.delivery_scatter_fit(T.delivery_view(spark, sf)))


@query("delivery_by_traffic")
def q_delivery_by_traffic(spark, sf):
    return r6(DV.delivery_by_traffic(T.delivery_view(spark, sf)))


@query("delivery_by_weather")
def q_delivery_by_weather(spark, sf):
    return r6(DV.delivery_by_weather(T.delivery_view(spark, sf)))


@query("weather_monthly")
def q_weather_monthly(spark, sf):
    return r6(DV.weather_monthly(T.weather_view(spark, sf)))


@query("weather_frequency")
def q_weather_frequency(spark, sf):
    return DV.weather_frequency(T.weather_view(spark, sf))


@query("weather_temp_range")
def q_weather_temp_range(spark, sf):
    return r6(DV.weather_temp_range(T.weather_view(spark, sf)))


@query("sales_by_productline")
def q_sales_by_productline(spark, sf):
    return r6(DV.sales_by_productline(T.sales_view(spark, sf)))


@query("sales_monthly_trend")
def q_sales_monthly_trend(spark, sf):
    return r6(DV.sales_monthly_trend(T.sales_view(spark, sf)))


@query("sales_deal_size")
def q_sales_deal_size(spark, sf):
    return r6(DV.sales_deal_size(T.sales_view(spark, sf)))


@query("asthma_box")
def q_asthma_box(spark, sf):
    return r6(DV.asthma_box(T.asthma_view(spark, sf)))


@query("asthma_crosstab")
def q_asthma_crosstab(spark, sf):
    return r6(DV.asthma_crosstab(T.asthma_view(spark, sf)))


@query("text_column_terms")
def q_text_column_terms(spark, sf):
    return DV.text_column_terms(T.table(spark, sf, "documents"), "text", 15)


@query("label_distribution")
def q_label_distribution(spark, sf):
    return DV.label_distribution(T.table(spark, sf, "documents"), "lang", 10)


# ---------------------------------------------------------------------------
# 2-E outliers
# ---------------------------------------------------------------------------

@query("anomaly_iqr")
def q_anomaly_iqr(spark, sf):
    return AN.anomaly_iqr(CL.clean_table(T.table(spark, sf, "events")).df)


@query("anomaly_iqr_health")
def q_anomaly_iqr_health(spark, sf):
    return AN.anomaly_iqr(CL.clean_table(T.stroke_view(spark, sf)).df)


@query("anomaly_severity")
def q_anomaly_severity(spark, sf):
    r = AN.anomaly_iqr(CL.clean_table(T.table(spark, sf, "events")).df)
    return r.select("anomaly_pct", AN.severity_expr(F.col("anomaly_pct"), 3.0, 8.0).alias("forest_scale"),
                    AN.severity_expr(F.col("anomaly_pct"), 3.0, 10.0).alias("iqr_scale"))


@query("anomaly_narrative")
def q_anomaly_narrative(spark, sf):
    li = CL.clean_table(T.table(spark, sf, "lineitem")).df
    r = AN.anomaly_iqr(li)
    dom = P.domain_from_names(li.columns)
    sev = AN.severity_expr(F.col("anomaly_pct"), 3.0, 8.0)
    return r.select(F.lit(dom).alias("domain"), AN.narrative_expr(
        F.col("n_anomalies"), F.col("total"), F.col("anomaly_pct"), sev, dom).alias("ml_result"))


@query("anomaly_iforest")
def q_anomaly_iforest(spark, sf):
    cl = CL.clean_table(T.table(spark, sf, "lineitem"), keep=True)
    prof = C.TableProfile.of(cl.df)
    feats = [c for c in prof.by_basic_role("numeric")]
    dom = P.domain_from_names(cl.df.columns)
    return AN.anomaly_iforest(cl.df, feats, domain=dom)


# ---------------------------------------------------------------------------
# 2-A sources and sinks
# ---------------------------------------------------------------------------

from quarry.operators import history as H  # noqa: E402
from quarry.operators import report as RP  # noqa: E402
from quarry.sources import files as FS  # noqa: E402
from quarry.sources import sinks as SK  # noqa: E402


@query("scan_csv")
def q_scan_csv(spark, sf):
    loc = SK.roundtrip_csv(T.table(spark, sf, "orders"), spark)
    return FS.scan_csv(spark, loc)


@query("scan_json_records")
def q_scan_json_records(spark, sf):
    loc = SK.roundtrip_json(T.table(spark, sf, "events"), spark)
    return FS.scan_json_records(spark, loc)


@query("json_flatten")
def q_json_flatten(spark, sf):
    return FS.json_flatten(T.table(spark, sf, "events"), "event_id", "props")


@query("report_sections")
def q_report_sections(spark, sf):
    a = D.text_analysis(_docs(spark, sf))
    return RP.report_sections(a, "Document")


@query("breakdown_serialize")
def q_breakdown_serialize(spark, sf):
    return RP.breakdown_serialize_pages(TS.page_breakdown(_pages(spark, sf)))


@query("breakdown_split")
def q_breakdown_split(spark, sf):
    s = RP.breakdown_serialize_pages(TS.page_breakdown(_pages(spark, sf)))
    return RP.breakdown_split(s)


@query("sink_chart_tables")
def q_sink_chart_tables(spark, sf):
    li = T.table(spark, sf, "lineitem")
    loc = SK.scratch_dir(spark, "charts")
    written = SK.sink_chart_tables({"numeric_histogram": r6(C.numeric_histogram(
        li, cols=LI_NUMERIC, prof=C.TableProfile.of(li.select(*LI_NUMERIC), distinct=False)))}, loc)
    return spark.read.parquet(written["numeric_histogram"])


@query("sink_history_append")
def q_sink_history_append(spark, sf):
    loc = SK.scratch_dir(spark, "history")
    SK.sink_history_append(T.history_view(spark, sf).drop("id"), loc)
    return spark.read.parquet(loc).groupBy("file_type").agg(F.count(F.lit(1)).alias("reports"))


# ---------------------------------------------------------------------------
# 2-G reports
# ---------------------------------------------------------------------------

@query("table_insights")
def q_table_insights(spark, sf):
    t = RP.table_insights(P.table_summary(CL.clean_table(T.table(spark, sf, "lineitem")).df))
    return t.select("executive_summary", F.array_join("key_insights", " || ").alias("key_insights"),
                    F.array_join("recommendations", " || ").alias("recommendations"))


@query("table_report_summary")
def q_table_report_summary(spark, sf):
    li = CL.clean_table(T.table(spark, sf, "lineitem")).df
    return RP.table_report(P.table_summary(li)).select("executive_summary")


@query("table_report_insights")
def q_table_report_insights(spark, sf):
    li = CL.clean_table(T.table(spark, sf, "lineitem")).df
    return RP.table_report(P.table_summary(li)).select(F.array_join("key_insights", " || ").alias("key_insights"))


@query("table_report_recs")
def q_table_report_recs(spark, sf):
    li = CL.clean_table(T.table(spark, sf, "lineitem")).df
    return RP.table_report(P.table_summary(li)).select(
        F.array_join("recommendations", " || ").alias("recommendations"))


@query("table_report_full")
def q_table_report_full(spark, sf):
    cl = CL.clean_table(T.table(spark, sf, "lineitem"), keep=True)
    prof = C.TableProfile.of(cl.df)
    an = AN.anomaly_iforest(cl.df, prof.by_basic_role("numeric"), domain=P.domain_from_names(cl.df.columns))
    r = RP.table_report(P.table_summary(cl.df, prof.stats(spark)), an)
    return r.select("executive_summary", F.array_join("key_insights", " || ").alias("key_insights"),
                    F.array_join("recommendations", " || ").alias("recommendations"))


@query("doc_report")
def q_doc_report(spark, sf):
    d = _docs(spark, sf)
    rep = RP.doc_report(D.text_analysis(d), D.linguistic_summary(d), TS.research_sections_clean(
        TP.doc_content(d).withColumnRenamed("content", "text")), TO.document_type(_prep(spark, sf), "cleaned_text"))
    return rep.select("doc_id", "executive_summary", F.array_join("key_insights", " || ").alias("key_insights"),
                      F.array_join("recommendations", " || ").alias("recommendations"))


@query("report_select")
def q_report_select(spark, sf):
    a = D.text_analysis(_docs(spark, sf))
    r = RP.report_select(a.select("doc_id", "executive_summary", "key_insights", "recommendations"),
                         ["Detailed Report"])
    return r.select("doc_id", F.array_join("key_insights", " || ").alias("key_insights"),
                    F.array_join("recommendations", " || ").alias("recommendations"))


# ---------------------------------------------------------------------------
# 2-H history
# ---------------------------------------------------------------------------

@query("history_list")
def q_history_list(spark, sf):
    return H.history_list(T.history_view(spark, sf)).select("user_id", "id", "position")


@query("history_search")
def q_history_search(spark, sf):
    return H.history_search(T.history_view(spark, sf), "urgent").select("user_id", "id", "file_name", "position")


@query("history_kpis")
def q_history_kpis(spark, sf):
    return H.history_kpis(T.history_view(spark, sf))


@query("history_get")
def q_history_get(spark, sf):
    h = T.history_view(spark, sf)
    return H.history_get(h, [1, 2, 3, 4, 5, 32, 33, 34, 35, 36, 37, 38, 39])


@query("history_duplicate")
def q_history_duplicate(spark, sf):
    return H.history_duplicate(T.history_view(spark, sf))


@query("settings_latest")
def q_settings_latest(spark, sf):
    return H.settings_latest(T.settings_view(spark, sf))


@query("settings_upsert")
def q_settings_upsert(spark, sf):
    import datetime
    return H.settings_upsert(T.settings_view(spark, sf), "full", "Detailed Report", "Enabled",
                             datetime.datetime(2024, 1, 1))
