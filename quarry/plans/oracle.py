"""DuckDB oracle SQL for the registered queries.

Each entry is plain SQL over the driver's views (region ... conversations).
Repetitive per-column parts are generated by the small helpers below from
the *known* input schemas; keyword lists come from the same fixed-value
module the Spark operators use, so both sides judge the same words.
"""

from __future__ import annotations

from quarry.functions import lexicons as L
from quarry.functions import wording as S
from quarry.functions.text import WS
from quarry.operators.clean import NUMERIC_TEXT

ORACLE: dict = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(expr: str, pats) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {q(p)})" for p in pats) + ")"


KIND = ("CASE WHEN data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT','HUGEINT','UTINYINT','USMALLINT',"
        "'UINTEGER','UBIGINT') THEN 'integral' WHEN data_type IN ('DOUBLE','FLOAT','REAL') "
        "OR data_type LIKE 'DECIMAL%' THEN 'fractional' WHEN data_type = 'BOOLEAN' THEN 'boolean' "
        "WHEN data_type = 'DATE' OR data_type LIKE 'TIMESTAMP%' THEN 'temporal' "
        "WHEN data_type = 'VARCHAR' THEN 'string' ELSE 'other' END")


def stats_cte(t: str) -> str:
    """Per-column kind, row count, null count, distinct count, mean text length."""
    return f"""
cols AS (SELECT column_name AS col, (ordinal_position - 1)::INTEGER AS ord, {KIND} AS kind
         FROM information_schema.columns WHERE table_name = '{t}'),
vals AS (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(*) INTO NAME col VALUE val),
agg AS (SELECT col, count(DISTINCT val) AS n_distinct, count(val) AS nn, avg(length(val)) AS avg_len
        FROM vals GROUP BY col),
tot AS (SELECT count(*) AS n FROM {t}),
st AS (SELECT c.col, c.ord, c.kind, tot.n, tot.n - coalesce(a.nn, 0) AS nulls,
              CASE WHEN c.kind = 'other' THEN NULL ELSE coalesce(a.n_distinct, 0) END AS n_distinct,
              CASE WHEN c.kind IN ('string','boolean') THEN a.avg_len END AS avg_len
       FROM cols c CROSS JOIN tot LEFT JOIN agg a ON a.col = c.col)"""


BASIC_ROLE = f"""CASE WHEN {contains_any('col', L.BASIC_ID_PATTERNS)} THEN 'id'
  WHEN {contains_any('col', L.BASIC_DATE_PATTERNS)} OR kind = 'temporal' THEN 'date'
  WHEN kind IN ('integral','fractional') THEN 'numeric'
  WHEN n_distinct < 20 THEN 'categorical' ELSE 'text' END"""

PROFILE_ROLE = f"""CASE WHEN kind = 'temporal' THEN 'datetime'
  WHEN {contains_any('col', L.PROFILE_ID_PATTERNS)} THEN 'id'
  WHEN kind IN ('integral','fractional') AND n_distinct = n AND n_distinct > 50 THEN 'id'
  WHEN kind IN ('integral','fractional') AND n_distinct = 2 THEN 'binary'
  WHEN kind IN ('integral','fractional') AND n_distinct <= 15 AND n_distinct / greatest(n, 1) < 0.05
       THEN 'categorical'
  WHEN kind IN ('integral','fractional') THEN 'numeric'
  WHEN kind = 'other' THEN 'text'
  WHEN avg_len > 60 OR n_distinct > 30 THEN 'text' ELSE 'categorical' END"""


def domain_case(names_expr: str, domains=L.DATASET_DOMAINS, default="generic") -> str:
    scores = [" + ".join(f"contains({names_expr}, {q(k)})::INTEGER" for k in kws) for _, kws in domains]
    best = "greatest(" + ", ".join(f"({s})" for s in scores) + ")"
    whens = " ".join(f"WHEN ({s}) = {best} THEN {q(d)}" for (d, _), s in zip(domains, scores))
    return f"(CASE WHEN {best} = 0 THEN {q(default)} {whens} END)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


NUM_RE = NUMERIC_TEXT
WS_CLASS = f"[{WS}]"


def parse_num(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({x}, {q(NUM_RE)}) "
            f"THEN TRY_CAST(regexp_replace({x}, {q(WS_CLASS)}, '', 'g') AS DOUBLE) END")


def title(name: str) -> str:
    return name.replace("_", " ").title()


# ---------------------------------------------------------------------------
# 2-B
# ---------------------------------------------------------------------------

ORACLE["dedup_rows"] = "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem"

DOC_LABELS = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, (l.toxic = 1) AS toxic_flag,
       CAST(l.toxic AS VARCHAR) AS toxic_text
FROM documents d LEFT JOIN labels l USING (doc_id)"""

ORACLE["bool_to_string"] = f"""WITH j AS ({DOC_LABELS})
SELECT doc_id, CASE WHEN coalesce(toxic_flag, false) THEN 'True' ELSE 'False' END AS toxic_flag FROM j"""

ORACLE["numeric_coerce"] = f"""WITH m AS (
  SELECT event_id, regexp_extract(props, '(\\d+)', 1) AS k_text,
         CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) ELSE event_type END AS mixed, value
  FROM events),
r AS (SELECT count(*) AS n, count({parse_num('k_text')}) AS pk, count({parse_num('mixed')}) AS pm FROM m)
SELECT event_id, CASE WHEN r.pk >= r.n * 0.5 THEN {parse_num('k_text')} END AS k_text,
       CASE WHEN r.pm < r.n * 0.5 THEN mixed END AS mixed, value
FROM m CROSS JOIN r"""

ORACLE["impute_mean"] = f"""WITH j AS ({DOC_LABELS})
SELECT doc_id, n_chars, round(coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM j)), 6) AS quality
FROM j"""

ORACLE["impute_label"] = f"""WITH j AS ({DOC_LABELS}),
r AS (SELECT count(*) AS n, count({parse_num('toxic_text')}) AS p FROM j)
SELECT doc_id, lang, CASE WHEN r.p < r.n * 0.5 THEN coalesce(toxic_text, 'Missing') END AS toxic_text
FROM j CROSS JOIN r"""

CLEAN_DOC_LABELS = f"""j AS (SELECT DISTINCT * FROM ({DOC_LABELS})),
c AS (SELECT doc_id, lang, source, n_chars,
             coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM j)) AS quality,
             CASE WHEN coalesce(toxic_flag, false) THEN 'True' ELSE 'False' END AS toxic_flag,
             coalesce(toxic_text, 'Missing') AS toxic_text
      FROM j)"""

ORACLE["clean_table"] = f"""WITH {CLEAN_DOC_LABELS}
SELECT doc_id, lang, source, n_chars, round(quality, 6) AS quality, toxic_flag, toxic_text FROM c"""

ORACLE["table_summary"] = f"""WITH {stats_cte('lineitem')}
SELECT max(n) AS rows, count(*)::INTEGER AS columns,
       string_agg(col, ',' ORDER BY ord) AS column_names,
       string_agg(col || ':' || nulls, ',' ORDER BY ord) AS missing,
       string_agg(col || ':' || ({BASIC_ROLE}), ',' ORDER BY ord) AS roles,
       {domain_case("string_agg(lower(col), ' ' ORDER BY ord)")} AS domain
FROM st"""

for key, t, role in [("roles_basic", "lineitem", BASIC_ROLE), ("roles_profile", "lineitem", PROFILE_ROLE),
                     ("roles_profile_customer", "customer", PROFILE_ROLE)]:
    ORACLE[key] = f"""WITH {stats_cte(t)}
SELECT col AS "column", ord, {role} AS role FROM st"""

ORACLE["dropna_subset"] = f"""WITH j AS ({DOC_LABELS})
SELECT doc_id, quality, lang FROM j WHERE quality IS NOT NULL"""

# ---------------------------------------------------------------------------
# 2-C column profile
# ---------------------------------------------------------------------------

LINEITEM_COLS = [("l_orderkey", "integral"), ("l_partkey", "integral"), ("l_suppkey", "integral"),
                 ("l_linenumber", "integral"), ("l_quantity", "fractional"), ("l_extendedprice", "fractional"),
                 ("l_discount", "fractional"), ("l_tax", "fractional"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "temporal")]
DOC_LABELS_CLEAN_COLS = [("doc_id", "integral"), ("lang", "string"), ("source", "string"),
                         ("n_chars", "integral"), ("quality", "fractional"), ("toxic_flag", "string"),
                         ("toxic_text", "string")]


def basic_role_py(name: str, kind: str, n_distinct_sql: str) -> str:
    lc = name.lower()
    if any(p in lc for p in L.BASIC_ID_PATTERNS):
        return "'ID'"
    if any(p in lc for p in L.BASIC_DATE_PATTERNS) or kind == "temporal":
        return "'DateTime'"
    if kind in ("integral", "fractional"):
        return "'Numeric'"
    return "'Categorical'"


def miss_sql(mp: str) -> str:
    return f"CASE WHEN {mp} = 0 THEN {q(S.MISSING['none'])} ELSE {S.said_sql(S.MISSING['some'], pct=f'CAST({mp} AS VARCHAR)')} END"



def breakdown_sql(src: str, raw: str, cols) -> str:
    """Column breakdown over a cleaned relation ``src`` (missing from ``raw``)."""
    parts = []
    for i, (c, kind) in enumerate(cols):
        typ = basic_role_py(c, kind, "")
        lab = q(title(c))
        mp = f"(SELECT round(CASE WHEN count(*) > 0 THEN count_if({c} IS NULL) * 100.0 / count(*) ELSE 0 END, 1) FROM {raw})"
        miss = miss_sql(mp)
        nd = f"count(DISTINCT {c})"
        if typ == "'ID'":
            summ = S.said_sql(S.COLUMN["id"], label=lab, distinct=nd, missing=miss)
        elif typ == "'DateTime'":
            days = f"floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000)::BIGINT"
            summ = S.said_sql(S.COLUMN["span"], label=lab, days=days, first=f"strftime(min({c}), '%Y-%m-%d')",
                              last=f"strftime(max({c}), '%Y-%m-%d')", missing=miss)
        elif typ == "'Numeric'":
            sk = f"skewness({c})"
            skt = f"CASE WHEN {sk} > 1 THEN {q(S.SHAPE['right'])} WHEN {sk} < -1 THEN {q(S.SHAPE['left'])} ELSE {q(S.SHAPE['even'])} END"
            summ = S.said_sql(S.COLUMN["numeric"], label=lab, min=f"printf('%.2f', min({c})::DOUBLE)", max=f"printf('%.2f', max({c})::DOUBLE)",
                              mean=f"printf('%.2f', avg({c})::DOUBLE)", std=f"printf('%.2f', stddev_samp({c}))", shape=skt, missing=miss)
        else:
            tops = (f"(SELECT string_agg(v, ', ' ORDER BY cnt DESC, v) FROM (SELECT CAST({c} AS VARCHAR) AS v, "
                    f"count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, v LIMIT 3))")
            topc = f"(SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}))"
            pct = f"round(CASE WHEN count(*) > 0 THEN {topc} * 100.0 / count(*) ELSE 0 END, 1)"
            summ = S.said_sql(S.COLUMN["text"], label=lab, distinct=nd, top=f"coalesce({tops}, '')",
                              share=f"CAST({pct} AS VARCHAR)", missing=miss)
        parts.append(f"SELECT {q(c)} AS \"column\", {i}::INTEGER AS ord, {typ} AS type, {mp} AS missing_percent, "
                     f"{nd} AS unique_values, {summ} AS summary FROM {src}")
    return union(parts)


ORACLE["column_breakdown"] = breakdown_sql("lineitem", "lineitem", LINEITEM_COLS)
ORACLE["column_breakdown_docs"] = (f"WITH {CLEAN_DOC_LABELS}, raw AS (SELECT DISTINCT * FROM ({DOC_LABELS}))\n"
                                   + breakdown_sql("c", "raw", DOC_LABELS_CLEAN_COLS))

DOC_LABELS_RAW_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic_flag", "toxic_text"]
ORACLE["col_missing_pct"] = f"WITH raw AS (SELECT DISTINCT * FROM ({DOC_LABELS}))\n" + union([
    f"SELECT {q(c)} AS \"column\", round(CASE WHEN count(*) > 0 THEN count_if({c} IS NULL) * 100.0 / count(*) "
    f"ELSE 0 END, 1) AS missing_percent FROM raw" for c in DOC_LABELS_RAW_COLS])

ORACLE["col_distinct"] = union([
    f"SELECT {q(c)} AS \"column\", count(DISTINCT {c}) AS unique_values FROM orders"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]])

ORACLE["col_numeric_stats"] = union([
    f"SELECT {q(c)} AS \"column\", round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, "
    f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem"
    for c, k in LINEITEM_COLS if k in ("integral", "fractional")])

ORACLE["col_skew"] = union([
    f"SELECT {q(c)} AS \"column\", round(skewness({c}), 6) AS skew, CASE WHEN skewness({c}) > 1 THEN "
    f"'right-skewed' WHEN skewness({c}) < -1 THEN 'left-skewed' ELSE 'normal' END AS skew_label FROM events"
    for c in ["event_id", "user_id", "value"]])

ORACLE["col_date_span"] = """SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS date_min,
  strftime(max(o_orderdate), '%Y-%m-%d') AS date_max,
  floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::BIGINT AS span_days
FROM orders"""

ORACLE["col_top_values"] = """WITH v AS (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT "column", value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value))::INTEGER AS rank
               FROM c) WHERE rank <= 3"""

# ---------------------------------------------------------------------------
# 2-C chart data
# ---------------------------------------------------------------------------

LI_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def histogram_sql(t: str, cols, bins: int = 25) -> str:
    rng = union([f"SELECT {q(c)} AS col, min({c})::DOUBLE AS lo0, max({c})::DOUBLE AS hi0 FROM {t}" for c in cols])
    vals = union([f"SELECT {q(c)} AS col, {c}::DOUBLE AS v FROM {t} WHERE {c} IS NOT NULL" for c in cols])
    return f"""WITH s AS ({rng}),
s2 AS (SELECT col, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo0,
              CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi0 FROM s),
e AS (SELECT col, b AS bin, b * ((hi0 - lo0) / {bins}) + lo0 AS lo,
             CASE WHEN b = {bins - 1} THEN hi0 ELSE (b + 1) * ((hi0 - lo0) / {bins}) + lo0 END AS hi
      FROM s2 CROSS JOIN range({bins}) t(b)),
v AS ({vals})
SELECT e.col AS "column", e.bin::INTEGER AS bin, round(e.lo, 6) AS lo, round(e.hi, 6) AS hi,
       count(v.v) AS count
FROM e LEFT JOIN v ON v.col = e.col AND v.v >= e.lo AND (v.v < e.hi OR (e.bin = {bins - 1} AND v.v <= e.hi))
GROUP BY e.col, e.bin, e.lo, e.hi"""


ORACLE["numeric_histogram"] = histogram_sql("lineitem", LI_NUMERIC)

ORACLE["numeric_kde"] = """WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi,
                  stddev_samp(value) AS sd FROM events),
p AS (SELECT *, sd * pow(n, -1.0 / 5.0) AS bw, ((hi - lo) / 25 + lo) - lo AS width,
             (hi - lo) / 199 AS step FROM s),
g AS (SELECT j, CASE WHEN j = 199 THEN hi ELSE j * step + lo END AS x, bw, width FROM p CROSS JOIN range(200) t(j))
SELECT 'value' AS "column", g.j::INTEGER AS point, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * ((g.x - e.value) / g.bw) * ((g.x - e.value) / g.bw)))
             * (max(g.width) / (max(g.bw) * sqrt(2 * pi()))), 6) AS density
FROM g CROSS JOIN (SELECT value FROM events WHERE value IS NOT NULL) e
GROUP BY g.j, g.x"""


def box_sql(t: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT {q(c)} AS "column", q1, med AS median, q3,
  (SELECT coalesce(min({c}), q1) FROM {t} WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS whislo,
  (SELECT coalesce(max({c}), q3) FROM {t} WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS whishi,
  (SELECT count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM {t}) AS n_fliers,
  (SELECT count({c}) FROM {t}) AS n
FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS med,
             quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t})""")
    inner = union(parts)
    return (f"SELECT \"column\", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
            f"round(whislo::DOUBLE, 6) AS whislo, round(whishi::DOUBLE, 6) AS whishi, n_fliers, n FROM ({inner})")


ORACLE["box_stats"] = box_sql("lineitem", LI_NUMERIC)

ORACLE["categorical_counts"] = """WITH v AS (
  SELECT 'l_discount' AS "column", CAST(l_discount AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'l_tax', CAST(l_tax AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem),
c AS (SELECT "column", value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY ALL),
t AS (SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value))::INTEGER AS rank FROM c)
SELECT "column", rank, value, count,
       round(count * 100.0 / sum(count) OVER (PARTITION BY "column"), 6) AS pct,
       CASE WHEN count(*) OVER (PARTITION BY "column") <= 6 THEN 'pie+bar' ELSE 'bar' END AS chart
FROM t WHERE rank <= 10"""

ORACLE["trend_granularity"] = """SELECT 'o_orderdate' AS "column", min(o_orderdate) AS start, max(o_orderdate) AS "end",
  floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::BIGINT AS span_days,
  CASE WHEN floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) > 730 THEN 'month'
       WHEN floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000) > 60 THEN 'week'
       ELSE 'day' END AS granularity
FROM orders"""

ORACLE["datetime_trend"] = """WITH b AS (SELECT CAST(last_day(o_orderdate) AS TIMESTAMP) AS bucket,
                 avg(o_custkey) AS m0, avg(o_totalprice) AS m1 FROM orders GROUP BY 1),
l AS (SELECT 'o_custkey' AS "column", bucket, m0 AS mean FROM b UNION ALL
      SELECT 'o_totalprice', bucket, m1 FROM b)
SELECT "column", bucket, round(mean, 6) AS mean FROM l WHERE mean IS NOT NULL"""

ORACLE["datetime_trend_day"] = """SELECT 'value' AS "column", date_trunc('day', ts)::TIMESTAMP AS bucket,
  round(avg(value), 6) AS mean FROM events GROUP BY 2"""

ORACLE["event_count_trend"] = """WITH c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS count
           FROM events GROUP BY 1),
r AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM c),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS bucket FROM r)
SELECT s.bucket, coalesce(c.count, 0) AS count FROM s LEFT JOIN c USING (bucket)"""

ORACLE["year_month_pivot"] = ("SELECT year(o_orderdate)::INTEGER AS year, " + ", ".join(
    f"round(coalesce(avg(CASE WHEN month(o_orderdate) = {m} THEN o_totalprice END), 0), 6) AS m{m:02d}"
    for m in range(1, 13)) + " FROM orders GROUP BY 1")


def corr_pairs(cols, lower: bool):
    return [(i, j) for i in range(len(cols)) for j in range(len(cols)) if (i > j if lower else i < j)]


ORACLE["correlation_matrix"] = union([
    f"SELECT {q(LI_NUMERIC[i])} AS row, {q(LI_NUMERIC[j])} AS col, "
    f"round(corr({LI_NUMERIC[i]}, {LI_NUMERIC[j]}), 6) AS r FROM lineitem"
    for i, j in corr_pairs(LI_NUMERIC, True)])

ORACLE["top_correlated_pairs"] = f"""WITH p AS ({union([
    f"SELECT {i} AS i, {j} AS j, {q(LI_NUMERIC[i])} AS c1, {q(LI_NUMERIC[j])} AS c2, "
    f"corr({LI_NUMERIC[i]}, {LI_NUMERIC[j]}) AS r FROM lineitem" for i, j in corr_pairs(LI_NUMERIC, False)])}),
t AS (SELECT *, (row_number() OVER (ORDER BY abs(r) DESC, i, j))::INTEGER AS rank FROM p WHERE r IS NOT NULL)
SELECT rank, c1, c2, round(r, 6) AS r, round(abs(r), 6) AS abs_r FROM t WHERE rank <= 3"""

ORACLE["linear_fit"] = """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope,
                  regr_intercept(l_extendedprice, l_quantity) AS intercept,
                  regr_r2(l_extendedprice, l_quantity) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n,
                  min(l_quantity) AS xmin, max(l_quantity) AS xmax FROM lineitem),
g AS (SELECT i, CASE WHEN i = 99 THEN xmax ELSE i * ((xmax - xmin) / 99) + xmin END AS x, f.*
      FROM f CROSS JOIN range(100) t(i))
SELECT 'distance_km' AS x_col, 'delivery_time_min' AS y_col, i::INTEGER AS i, round(x, 6) AS x,
       round(slope * x + intercept, 6) AS y, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(r2, 6) AS r2, n
FROM g"""

LABELLED = "SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang FROM labels l JOIN documents d USING (doc_id)"


def grouped_box_sql(src: str, group: str, cols) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT CAST(g AS VARCHAR) AS target, {q(c)} AS "column", q1, med AS median, q3,
  coalesce(min(CASE WHEN v >= q1 - 1.5 * (q3 - q1) THEN v END), q1) AS whislo,
  coalesce(max(CASE WHEN v <= q3 + 1.5 * (q3 - q1) THEN v END), q3) AS whishi,
  count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_fliers, count(v) AS n,
  min(v) AS min, max(v) AS max
FROM (SELECT s.{group} AS g, s.{c}::DOUBLE AS v, qq.q1, qq.med, qq.q3 FROM src s JOIN
      (SELECT {group} AS g2, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS med,
              quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM src WHERE {group} IS NOT NULL GROUP BY 1) qq
      ON s.{group} = qq.g2)
GROUP BY g, q1, med, q3""")
    body = union(parts)
    return (f"WITH src AS ({src})\nSELECT target, \"column\", round(q1, 6) AS q1, round(median, 6) AS median, "
            f"round(q3, 6) AS q3, round(whislo, 6) AS whislo, round(whishi, 6) AS whishi, n_fliers, n, "
            f"round(min, 6) AS min, round(max, 6) AS max FROM ({body})")


ORACLE["binary_vs_numeric"] = grouped_box_sql(LABELLED, "quality", ["n_chars"])

ORACLE["binary_vs_categorical"] = f"""WITH src AS ({LABELLED}),
c AS (SELECT 'lang' AS "column", lang AS value, CAST(quality AS VARCHAR) AS target, count(*) AS count
      FROM src WHERE lang IS NOT NULL AND quality IS NOT NULL GROUP BY ALL)
SELECT *, round(count / sum(count) OVER (PARTITION BY "column", value), 6) AS share FROM c"""

ORACLE["dataset_overview"] = f"""WITH raw AS ({DOC_LABELS}),
n AS (SELECT count(*) AS n FROM raw),
st AS (
  SELECT 'doc_id' AS col, count_if(doc_id IS NULL) AS nulls,
         CASE WHEN count(DISTINCT doc_id) = count(*) AND count(DISTINCT doc_id) > 50 THEN 'id' ELSE 'id' END AS role
  FROM raw
  UNION ALL SELECT 'lang', count_if(lang IS NULL),
         CASE WHEN avg(length(lang)) > 60 OR count(DISTINCT lang) > 30 THEN 'text' ELSE 'categorical' END FROM raw
  UNION ALL SELECT 'source', count_if(source IS NULL),
         CASE WHEN avg(length(source)) > 60 OR count(DISTINCT source) > 30 THEN 'text' ELSE 'categorical' END FROM raw
  UNION ALL SELECT 'n_chars', count_if(n_chars IS NULL),
         CASE WHEN count(DISTINCT n_chars) = count(*) AND count(DISTINCT n_chars) > 50 THEN 'id'
              WHEN count(DISTINCT n_chars) = 2 THEN 'binary'
              WHEN count(DISTINCT n_chars) <= 15 AND count(DISTINCT n_chars) / count(*) < 0.05 THEN 'categorical'
              ELSE 'numeric' END FROM raw
  UNION ALL SELECT 'quality', count_if(quality IS NULL),
         CASE WHEN count(DISTINCT quality) = count(*) AND count(DISTINCT quality) > 50 THEN 'id'
              WHEN count(DISTINCT quality) = 2 THEN 'binary'
              WHEN count(DISTINCT quality) <= 15 AND count(DISTINCT quality) / count(*) < 0.05 THEN 'categorical'
              ELSE 'numeric' END FROM raw
  UNION ALL SELECT 'toxic_flag', count_if(toxic_flag IS NULL),
         CASE WHEN avg(length(CAST(toxic_flag AS VARCHAR))) > 60 OR count(DISTINCT toxic_flag) > 30 THEN 'text'
              ELSE 'categorical' END FROM raw
  UNION ALL SELECT 'toxic_text', count_if(toxic_text IS NULL),
         CASE WHEN avg(length(toxic_text)) > 60 OR count(DISTINCT toxic_text) > 30 THEN 'text'
              ELSE 'categorical' END FROM raw)
SELECT 'missing' AS panel, col AS label, round(nulls * 100.0 / n, 6) AS value FROM st, n WHERE nulls > 0
UNION ALL SELECT 'roles', role, count(*)::DOUBLE FROM st GROUP BY role
UNION ALL SELECT 'summary', 'Rows', (SELECT n FROM n)::DOUBLE
UNION ALL SELECT 'summary', 'Columns', 7.0
UNION ALL SELECT 'summary', 'Numeric', count_if(role = 'numeric')::DOUBLE FROM st
UNION ALL SELECT 'summary', 'Categorical', count_if(role = 'categorical')::DOUBLE FROM st
UNION ALL SELECT 'summary', 'Binary', count_if(role = 'binary')::DOUBLE FROM st
UNION ALL SELECT 'summary', 'Datetime', count_if(role = 'datetime')::DOUBLE FROM st
UNION ALL SELECT 'summary', 'Missing cols', count_if(nulls > 0)::DOUBLE FROM st"""
