"""DuckDB oracle SQL for the assembled results: analyses, breakdowns, reports, file round trips.

They are put together from the oracle SQL of their parts, nested as
subqueries; sentences come from the templates the operators use.
"""

from __future__ import annotations

from quarry.functions import wording as S
from quarry.functions.text import WS
from quarry.operators.text_ops import HEADING
from quarry.plans import oracle_text as T
from quarry.plans.oracle import BASIC_ROLE, ORACLE, domain_case, q, stats_cte


def by_domain(table: dict, one) -> str:
    """``one(entry)`` of the row's domain, else of "general"."""
    return "CASE domain " + " ".join(f"WHEN {q(d)} THEN {one(e)}" for d, e in table.items()) + f" ELSE {one(table['general'])} END"


def listing(rows: str, value: str, order: str, key: str = "doc_id") -> str:
    return f"(SELECT {key}, list({value} ORDER BY {order}) AS xs FROM ({rows}) GROUP BY {key})"


# ---- headings of pages and of cleaned lines ----

HEADINGS = f"""WITH {T.DOCS},
ln AS (SELECT doc_id, page_no, {T.strip('unnest(string_split(page, chr(10)))')} AS line,
              unnest(range(0, len(string_split(page, chr(10))))) AS line_no FROM pages),
ok AS (SELECT doc_id, page_no, line_no, {T.strip(f"regexp_replace(line, {q(f'[{WS}]+')}, ' ', 'g')")} AS title
       FROM ln WHERE length(line) >= 5 AND length(line) <= 100 AND regexp_matches(line, {q(HEADING)})),
f AS (SELECT doc_id, title, min({{'p': page_no, 'l': line_no}}) AS first FROM ok WHERE length(title) > 8 GROUP BY doc_id, title),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first.p, first.l) AS ord FROM f)
SELECT doc_id, ord, title FROM r WHERE ord <= 20"""

TITLED = ("array_to_string(list_transform(string_split(l, ''), lambda ch, i: CASE WHEN i = 1 OR NOT "
          "regexp_matches(string_split(l, '')[i - 1], '^\\p{L}$') THEN upper(ch) ELSE lower(ch) END), '')")
HEADING_OF = f"""list_filter(list_transform(lines[1:8], lambda l: CASE WHEN length(l) < 5 THEN NULL
  WHEN regexp_matches(l, {q('^' + chr(92) + 'p{Nd}+[.' + chr(92) + 'p{Nd}]*[' + WS + ']+[A-Z]')}) AND length(l) < 80 THEN l
  WHEN {T.ISUPPER.format(x='l')} AND length(l) > 5 AND length(l) < 80 THEN {TITLED}
  WHEN regexp_matches(substring(l, 1, 1), '^\\p{{Lu}}$') AND NOT suffix(l, '.') AND length(l) > 10 AND length(l) < 70
       AND len(regexp_extract_all(l, '\\p{{Lu}}')) >= 2 THEN l END), lambda x: x IS NOT NULL)[1]"""

ORACLE["page_heading"] = f"""WITH {T.NUMBERED},
{T.pages_cte('np', 'nd', 8, 'chr(10)')},
{T.page_clean_sql('np')}
SELECT doc_id, page_no, {HEADING_OF} AS heading FROM pc"""

# ---- page breakdown ----

_KEYS = "doc_id, page_no"
_NONE = "CAST([] AS VARCHAR[])"
BREAKDOWN = f"""WITH {T.DOCS},
{T.page_clean_sql('pages')},
b AS (SELECT doc_id, page_no, {HEADING_OF} AS heading,
             len(list_filter(string_split_regex(clean_text, {q(f'[{WS}]+')}), lambda t: t <> ''))::INTEGER AS word_count FROM pc),
j AS (SELECT b.*, coalesce(k.xs, {_NONE}) AS kw, coalesce(s.xs, {_NONE}) AS ks
      FROM b LEFT JOIN {listing(ORACLE['page_keywords'], 'keyword', 'rank', _KEYS)} k USING ({_KEYS})
      LEFT JOIN {listing(ORACLE['key_sentences'], 'sentence', 'rank', _KEYS)} s USING ({_KEYS})),
m AS (SELECT *, concat_ws(' ', CASE WHEN heading IS NOT NULL THEN {S.said_sql(S.PAGE['heading'], heading='heading')} END,
        CASE WHEN len(ks) > 0 THEN array_to_string(ks, ' ') WHEN word_count > 0 THEN {S.said_sql(S.PAGE['words'], words='word_count')} END,
        CASE WHEN len(kw) > 0 THEN {S.said_sql(S.PAGE['keywords'], keywords="array_to_string(kw, ', ')")} END) AS told FROM j)
SELECT doc_id, page_no, heading, array_to_string(kw, ', ') AS keywords, word_count,
       CASE WHEN told = '' THEN {S.said_sql(S.PAGE['empty'], page='page_no', words='word_count')} ELSE told END AS summary FROM m"""
ORACLE["page_breakdown"] = BREAKDOWN
_SERIAL = f"""SELECT doc_id, string_agg('Page ' || page_no || ' - ' || summary, ' || ' ORDER BY page_no) AS breakdown
FROM ({BREAKDOWN}) GROUP BY doc_id"""
ORACLE["breakdown_serialize"] = _SERIAL
ORACLE["breakdown_split"] = f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(breakdown, '||'), lambda x: trim(x)),
                                        lambda x: x <> '') AS xs FROM ({_SERIAL}))
SELECT doc_id, unnest(range(0, len(xs)))::INTEGER AS item_ord, unnest(xs) AS item FROM s"""

# ---- document analysis ----

_GRADE = ORACLE["readability"].replace(T.az("content", 1, lower=False, upper_ok=True), T.az("text", 1, lower=False, upper_ok=True)).replace(
    "string_split_regex(content,", "string_split_regex(text,")
_SLOTS = {
    "pages": "page_count", "words": "format('{:,}', word_count)", "sections": "CASE WHEN len(titles) > 0 THEN len(titles)::VARCHAR ELSE 'several' END",
    "keywords": "array_to_string(kw[1:5], ', ')", "topics": "array_to_string(topics[1:3], ', ')", "readability": "readability", "level": "level",
    "density": "avg_words_per_page", "sentiment": "sentiment", "sentiment_desc": "sentiment_desc", "top3_keywords": "array_to_string(kw[1:3], ', ')",
    "top_topic": "coalesce(kw[1], 'main topic')", "top_section": "coalesce(titles[1], 'introduction')"}
_ALL = lambda ts: " || ' || ' || ".join(f"({S.said_sql(t, **_SLOTS)})" for t in ts)
_ANALYSIS = f"""WITH e AS (WITH {T.DOCS} SELECT doc_id, text = '' AS blank FROM prep),
j AS (SELECT e.doc_id, e.blank, st.*, d.domain, se.sentiment, se.sentiment_desc, g.grade, g.readability, g.level,
             coalesce(k.xs, {_NONE}) AS kw, coalesce(p.xs, {_NONE}) AS kp, coalesce(h.xs, {_NONE}) AS titles
      FROM e JOIN (SELECT * FROM ({ORACLE['text_statistics']})) st USING (doc_id) JOIN ({ORACLE['domain_detect']}) d USING (doc_id)
      JOIN ({ORACLE['sentiment']}) se USING (doc_id) JOIN ({_GRADE}) g USING (doc_id)
      LEFT JOIN {listing(ORACLE['tfidf_keywords'], 'keyword', 'rank')} k USING (doc_id)
      LEFT JOIN {listing(ORACLE['keyphrases'], 'phrase', 'rank')} p USING (doc_id)
      LEFT JOIN {listing(HEADINGS, 'title', 'ord')} h USING (doc_id)),
t AS (SELECT *, CASE WHEN len(kp) > 0 THEN kp[1:5] ELSE kw[1:5] END AS topics FROM j)
SELECT doc_id, blank, word_count, titles, kw, kp, topics,
       CASE WHEN blank THEN {q(S.EMPTY_DOC['document_type'])} ELSE domain END AS document_type,
       CASE WHEN blank THEN {q(S.EMPTY_DOC['executive_summary'])} ELSE {by_domain(S.DOC_SUMMARIES, lambda x: S.said_sql(x, **_SLOTS))} END AS executive_summary,
       CASE WHEN blank THEN {q(S.EMPTY_DOC['key_insights'])} ELSE {by_domain(S.DOC_INSIGHTS, _ALL)} END AS key_insights,
       CASE WHEN blank THEN {q(S.EMPTY_DOC['recommendations'])} ELSE {by_domain(S.DOC_RECOMMENDATIONS, _ALL)} END AS recommendations,
       CASE WHEN blank THEN {q(S.EMPTY_DOC['sentiment'])} ELSE sentiment END AS sentiment,
       CASE WHEN blank THEN {q(S.EMPTY_DOC['readability'])} ELSE readability END AS readability,
       CASE WHEN blank THEN 0.0 ELSE grade END AS readability_grade FROM t"""
ORACLE["text_analysis"] = f"""SELECT doc_id, document_type, executive_summary, key_insights, recommendations,
       CASE WHEN blank THEN '' ELSE array_to_string(kw[1:15], ', ') END AS keywords,
       CASE WHEN blank THEN '' ELSE array_to_string(kp, ', ') END AS keyphrases,
       CASE WHEN blank THEN '' ELSE array_to_string(topics, ', ') END AS topics,
       len(titles)::INTEGER AS n_sections, sentiment, readability, readability_grade, word_count FROM ({_ANALYSIS})"""
ORACLE["report_select"] = f"""SELECT doc_id, array_to_string(string_split(key_insights, ' || ')[1:5], ' || ') AS key_insights,
       array_to_string(string_split(recommendations, ' || ')[1:4], ' || ') AS recommendations FROM ({_ANALYSIS})"""


def _items(column: str, order: int, name: str) -> str:
    return f"""SELECT doc_id, {order} AS section_ord, {q(name)} AS section, unnest(range(0, len(xs)))::INTEGER AS item_ord, '• ' || unnest(xs) AS text
FROM (SELECT doc_id, string_split({column}, ' || ') AS xs FROM a)"""


ORACLE["report_sections"] = f"""WITH a AS ({_ANALYSIS})
SELECT doc_id, 0 AS section_ord, 'title' AS section, 0 AS item_ord, 'Document Analysis Report' AS text FROM a
UNION ALL SELECT doc_id, 1, 'Executive Summary', 0, executive_summary FROM a WHERE executive_summary <> ''
UNION ALL {_items('key_insights', 2, 'Key Insights')}
UNION ALL {_items('recommendations', 4, 'Recommendations')}
UNION ALL SELECT doc_id, 6, 'footer', 0, 'Generated report' FROM a"""

# ---- linguistic summary ----

_COMPLEX = ORACLE["sentence_complexity"].replace("string_split_regex(content,", "string_split_regex(cleaned_text,")
LINGUISTIC = f"""WITH b AS (WITH {T.DOCS} SELECT doc_id FROM prep WHERE cleaned_text <> ''),
j AS (SELECT b.doc_id, l.lex_diversity, l.vocabulary, c.avg_sentence_words, c.complexity, coalesce(t.coherence, 1.0) AS coherence,
             coalesce(k.xs, {_NONE}) AS terms, d.keyword AS term, d.density
      FROM b JOIN ({ORACLE['lexical_diversity']}) l USING (doc_id) JOIN ({_COMPLEX}) c USING (doc_id)
      LEFT JOIN ({ORACLE['topic_coherence']}) t USING (doc_id)
      LEFT JOIN {listing(f"SELECT * FROM ({ORACLE['tfidf_keywords']}) WHERE rank <= 5", 'keyword', 'rank')} k USING (doc_id)
      LEFT JOIN (SELECT * FROM ({ORACLE['term_density']}) WHERE rank = 1) d USING (doc_id))
SELECT doc_id, lex_diversity, vocabulary, avg_sentence_words, complexity, coherence, {S.said_sql(
    S.LINGUISTIC, terms="array_to_string(terms, ', ')", diversity="CAST(lex_diversity AS VARCHAR)", vocabulary="vocabulary", complexity="complexity",
    length="printf('%.0f', round(avg_sentence_words))", coherence="printf('%.2f', round(coherence, 2))",
    strength="CASE WHEN coherence > 0.5 THEN 'strong' ELSE 'moderate' END", term="coalesce(term, 'none')",
    density="coalesce(CAST(density AS VARCHAR), '0')")} AS dl_summary FROM j"""
ORACLE["linguistic_summary"] = LINGUISTIC

# ---- files and sinks ----

ORACLE["scan_csv"] = "SELECT * REPLACE (o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey) FROM orders"
ORACLE["scan_json_records"] = "SELECT * REPLACE (strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts) FROM events"
ORACLE["sink_chart_tables"] = ORACLE["numeric_histogram"]
ORACLE["sink_history_append"] = "SELECT o_orderstatus AS file_type, count(*) AS reports FROM orders GROUP BY ALL"

# ---- table reports on lineitem ----


def table_report_sql(columns: str) -> str:
    name = lambda role, n: (f"(SELECT string_agg(col, ', ' ORDER BY ord) FROM (SELECT col, ord FROM r WHERE role = '{role}' "  # noqa: E731
                            f"ORDER BY ord LIMIT {n}))")
    W = S.TABLE
    subject = lambda i: "CASE domain " + " ".join(f"WHEN {q(d)} THEN {q(v[i])}" for d, v in S.TABLE_SUBJECTS.items()) + " END"

    def facts(subj, groups):
        return [S.said_sql(W["size"], rows="format('{:,}', n)", columns="k", subject=subj),
                f"CASE WHEN num IS NULL THEN {q(W['no_measures'])} ELSE {S.said_sql(W['measures'], names='num')} END",
                f"CASE WHEN cat IS NULL THEN {S.said_sql(W['no_groups'], groups=groups)} ELSE {S.said_sql(W['groups'], names='cat')} END",
                f"CASE WHEN dat IS NULL THEN {q(W['no_time'])} ELSE {S.said_sql(W['time'], name='dat')} END"]

    steps = [f"CASE WHEN num IS NULL THEN {q(W['do_no_measures'])} ELSE {S.said_sql(W['do_measures'], names='num')} END",
             f"CASE WHEN cat IS NOT NULL THEN {S.said_sql(W['do_groups'], names='cat')} END",
             f"CASE WHEN dat IS NULL THEN {q(W['do_no_time'])} ELSE {S.said_sql(W['do_time'], name='dat')} END"]
    own = [f"CASE domain {' '.join(f'WHEN {q(d)} THEN {q(v[i])}' for d, v in S.TABLE_RECOMMENDATIONS.items())} END" for i in (0, 1)]
    size = f"CASE WHEN n > 5000 THEN {q(W['many'])} WHEN n < 200 THEN {q(W['few'])} END"
    join = lambda sep, xs: f"concat_ws({q(sep)}, {', '.join(xs)})"
    plain, told = facts(*[q(x) for x in S.TABLE_SUBJECTS["generic"]]), facts(subject(0), subject(1))
    out = {"early_summary": join(" ", plain), "early_insights": join(" || ", plain), "early_recs": join(" || ", steps),
           "summary": join(" ", [*told, q(W["cleaned"])]), "insights": join(" || ", [*told, q(W["cleaned"])]),
           "recs": join(" || ", [*steps, size, *own])}
    for k, v in out.items():
        columns = columns.replace("{" + k + "}", v)
    return f"""WITH {stats_cte('lineitem')},
r AS (SELECT col, ord, n, {BASIC_ROLE} AS role FROM st),
x AS (SELECT max(n) AS n, count(*) AS k, {domain_case("string_agg(lower(col), ' ' ORDER BY ord)")} AS domain,
             {name('numeric', 3)} AS num, {name('categorical', 2)} AS cat, {name('date', 1)} AS dat FROM r)
SELECT {columns} FROM x"""


ORACLE["table_insights"] = table_report_sql("{early_summary} AS executive_summary, {early_insights} AS key_insights, {early_recs} AS recommendations")
ORACLE["table_report_summary"] = table_report_sql("{summary} AS executive_summary")
ORACLE["table_report_insights"] = table_report_sql("{insights} AS key_insights")
ORACLE["table_report_recs"] = table_report_sql("{recs} AS recommendations")
