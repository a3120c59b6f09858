"""DuckDB oracle SQL for the text operators.

The same rules the Spark operators apply, written with DuckDB list lambdas:
lines are split on the same line breaks and stripped of the same whitespace
set; words are runs of ``[\\p{L}\\p{N}_]`` kept when they are all ASCII
letters; RE2 has no look-behind, so sentence splits after punctuation are
done by marking the break with ``chr(1)`` first.
"""

from __future__ import annotations

from quarry.functions import lexicons as L
from quarry.functions import wording as S
from quarry.functions.text import LINE_BREAK, NON_WORD, WS
from quarry.operators.text_ops import HEADING
from quarry.operators.text_pages import PAGE_NUMBER_LINE, PAGE_WORD_LINE
from quarry.plans.oracle import ORACLE, domain_case, q

STRIP = f"^[{WS}]+|[{WS}]+$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP)}, '', 'g')"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in dict.fromkeys(words)) + "]"


ENGLISH = lst(L.ENGLISH_STOPWORDS)
ENGINE = lst(L.ENGINE_STOPWORDS)
PAGE = lst(L.PAGE_STOPWORDS)
CHART = lst(L.CHART_STOPWORDS)


def lines_of(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({x}, {q(LINE_BREAK)}), lambda l: {strip('l')}), "
            f"lambda l: l <> '')")


def az(x: str, n: int, lower: bool = True, upper_ok: bool = False) -> str:
    src = f"lower({x})" if lower else x
    cls = "a-zA-Z" if upper_ok else "a-z"
    return (f"list_filter(regexp_split_to_array({src}, {q(NON_WORD)}), "
            f"lambda t: regexp_full_match(t, {q(f'[{cls}]{{{n},}}')}))")


def minus(arr: str, stop: str) -> str:
    return f"list_filter({arr}, lambda t: NOT list_contains({stop}, t))"


def pages_of(lines: str, per: int = 8, sep: str = "' '") -> str:
    return (f"list_transform(range(0, CAST(ceil(len({lines}) / {per}) AS BIGINT)), "
            f"lambda i: array_to_string({lines}[i * {per} + 1 : i * {per} + {per}], {sep}))")


def norm_tokens(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), {q(f'[^a-zA-Z0-9{WS}]')}, '', 'g'), "
            f"{q(f'[{WS}]+')}), lambda t: t <> '')")


# documents -> lines, content, pages, cleaned text, engine text
DOCS = f"""d0 AS (SELECT doc_id, {lines_of('text')} AS lines FROM documents),
d1 AS (SELECT doc_id, array_to_string(lines, chr(10)) AS content, {pages_of('lines')} AS pages FROM d0),
d2 AS (SELECT doc_id, content, pages, len(pages) AS n_pages, {norm_tokens('content')} AS toks FROM d1),
d3 AS (SELECT *, list_filter(toks, lambda t: NOT list_contains({ENGLISH}, t) AND length(t) > 1) AS kept FROM d2),
prep AS (SELECT doc_id, content, pages, n_pages, toks, kept, array_to_string(kept, ' ') AS cleaned_text,
                CASE WHEN array_to_string(kept, ' ') <> '' THEN array_to_string(kept, ' ')
                     ELSE array_to_string(pages, ' ') END AS text
         FROM d3),
pages AS (SELECT doc_id, unnest(range(1, len(pages) + 1))::INTEGER AS page_no, len(pages)::INTEGER AS n_pages,
                 unnest(pages) AS page FROM d1)"""


def pages_cte(name: str, src: str, per: int = 8, sep: str = "' '", text: str = "text", id_col: str = "doc_id"):
    return f"""{name}_l AS (SELECT {id_col} AS doc_id, {lines_of(text)} AS lines FROM {src}),
{name}_p AS (SELECT doc_id, {pages_of('lines', per, sep)} AS pages FROM {name}_l),
{name} AS (SELECT doc_id, unnest(range(1, len(pages) + 1))::INTEGER AS page_no, len(pages)::INTEGER AS n_pages,
                  unnest(pages) AS page FROM {name}_p)"""


ORACLE["scan_text_pages"] = f"WITH {DOCS}\nSELECT doc_id, page_no, n_pages, page FROM pages"

ORACLE["text_normalize"] = f"""WITH {DOCS}
SELECT doc_id, cleaned_text, len(toks)::INTEGER AS total_words, len(kept)::INTEGER AS filtered_words FROM prep"""


def stats_sql(text: str) -> str:
    return f"""WITH {DOCS},
s AS (SELECT doc_id, n_pages, {text} AS x,
             list_filter(regexp_split_to_array({text}, {q(NON_WORD)}),
                         lambda t: regexp_full_match(t, '[a-zA-Z]+')) AS words
      FROM prep),
s2 AS (SELECT doc_id, n_pages, len(words) AS wc,
              len(list_distinct(list_transform(words, lambda w: lower(w)))) AS uniq,
              len(list_filter(string_split_regex(x, '[.!?]+'), lambda z: length({strip('z')}) > 10)) AS sents,
              len(list_filter(string_split(x, chr(10) || chr(10)), lambda z: {strip('z')} <> '')) AS paras
       FROM s)
SELECT doc_id, wc::INTEGER AS word_count, uniq::INTEGER AS unique_words, sents::INTEGER AS sentence_count,
       paras::INTEGER AS paragraph_count, n_pages::INTEGER AS page_count,
       floor(wc / greatest(n_pages, 1))::INTEGER AS avg_words_per_page,
       floor(wc / greatest(sents, 1))::INTEGER AS avg_sentence_length,
       round(round(uniq / greatest(wc, 1), 3), 6) AS lexical_diversity
FROM s2"""


ORACLE["text_statistics"] = stats_sql("text")
ORACLE["text_statistics_raw"] = stats_sql("content")


def tfidf_ctes(pages_src: str, top: int) -> str:
    """CTEs ending in ``kw(doc_id, rank, keyword, score)``: the top TF-IDF terms per document."""
    return f"""pw AS (SELECT doc_id, page_no, n_pages, {minus(az('page', 4), ENGINE)} AS w FROM {pages_src}),
ex AS (SELECT doc_id, page_no, n_pages, len(w) AS total, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM pw),
pp AS (SELECT doc_id, page_no, word, count(*) AS cnt, min(pos) AS pos, any_value(total) AS total,
              any_value(n_pages) AS n_pages FROM ex GROUP BY doc_id, page_no, word),
pd AS (SELECT doc_id, word, sum(cnt / greatest(total, 1)) AS tf_sum, count(*) AS df,
              min({{'p': page_no, 'q': pos}}) AS first, any_value(n_pages) AS n_pages
       FROM pp GROUP BY doc_id, word),
sc AS (SELECT *, tf_sum * (ln((n_pages + 1) / (df + 1)) + 1) AS score FROM pd),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, first.p, first.q))::INTEGER
              AS rank FROM sc),
kw AS (SELECT doc_id, rank, word AS keyword, score FROM r WHERE rank <= {top})"""


def tfidf_sql(pages_src: str, top: int, prelude: str) -> str:
    return f"""WITH {prelude},
{tfidf_ctes(pages_src, top)}
SELECT doc_id, rank, keyword, round(score, 6) AS score FROM kw"""


ORACLE["tfidf_keywords"] = tfidf_sql("pages", 20, DOCS)
CONV_PAGES = """cpages AS (SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page_no,
                   (count(*) OVER (PARTITION BY conv_id))::INTEGER AS n_pages, text AS page FROM conversations)"""
ORACLE["tfidf_conversations"] = tfidf_sql("cpages", 20, CONV_PAGES)

ORACLE["keyphrases"] = f"""WITH {DOCS},
w AS (SELECT doc_id, {minus(az('text', 3), ENGINE)} AS w FROM prep),
g AS (SELECT doc_id, unnest(list_concat(
        list_transform(range(1, len(w)), lambda i: {{'kind': 0, 'pos': i, 'phrase': w[i] || ' ' || w[i + 1],
                        'ok': length(w[i]) >= 4 AND length(w[i + 1]) >= 4}}),
        list_transform(range(1, len(w) - 1), lambda i: {{'kind': 1, 'pos': i,
                        'phrase': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2],
                        'ok': length(w[i]) >= 4 AND length(w[i + 1]) >= 4 AND length(w[i + 2]) >= 4}}))) AS g
      FROM w),
c AS (SELECT doc_id, g.phrase AS phrase, count(*) AS count, min({{'k': g.kind, 'p': g.pos}}) AS first
      FROM g WHERE g.ok GROUP BY doc_id, g.phrase),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, first.k, first.p))::INTEGER AS rank
      FROM c)
SELECT doc_id, rank, phrase, count FROM r WHERE rank <= 10"""

NUMBERED = f"""nd AS (SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(text, {q(LINE_BREAK)}),
                       lambda l, i: i::VARCHAR || ' ' || l), chr(10)) AS text FROM documents)"""

ORACLE["headings"] = f"""WITH {NUMBERED},
{pages_cte('np', 'nd', 8, 'chr(10)')},
ln AS (SELECT doc_id, page_no, {strip('unnest(string_split(page, chr(10)))')} AS line,
              unnest(range(0, len(string_split(page, chr(10))))) AS line_no FROM np),
ok AS (SELECT doc_id, page_no, line_no, {strip(f"regexp_replace(line, {q(f'[{WS}]+')}, ' ', 'g')")} AS title
       FROM ln WHERE length(line) >= 5 AND length(line) <= 100 AND regexp_matches(line, {q(HEADING)})),
f AS (SELECT doc_id, title, min({{'p': page_no, 'l': line_no}}) AS first FROM ok WHERE length(title) > 8
      GROUP BY doc_id, title),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY first.p, first.l))::INTEGER AS ord FROM f)
SELECT doc_id, ord, title, first.p::INTEGER AS page FROM r WHERE ord <= 20"""

DOMAIN_LISTS = [(d, kws.split()) for d, kws in L.DOC_DOMAINS]
ORACLE["domain_detect"] = f"""WITH {DOCS}
SELECT doc_id, {domain_case('lower(text)', DOMAIN_LISTS, 'general')} AS domain FROM prep"""

ORACLE["document_type"] = f"""WITH {DOCS}
SELECT doc_id, {domain_case('lower(cleaned_text)', L.DOC_TYPES, 'general')} AS document_type FROM prep"""

POS = lst(L.POSITIVE_WORDS)
NEG = lst(L.NEGATIVE_WORDS)
DESC = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in S.TONE)


def sentiment_sql(src: str, text: str, prelude: str) -> str:
    return f"""WITH {prelude}
s AS (SELECT doc_id, {az(text, 1)} AS w FROM {src}),
c AS (SELECT doc_id, len(list_filter(w, lambda t: list_contains({POS}, t)))::INTEGER AS positive_hits,
             len(list_filter(w, lambda t: list_contains({NEG}, t)))::INTEGER AS negative_hits FROM s),
l AS (SELECT *, CASE WHEN positive_hits + negative_hits = 0 THEN 'Negative'
                     WHEN positive_hits / (positive_hits + negative_hits) > 0.6 THEN 'Positive'
                     WHEN positive_hits / (positive_hits + negative_hits) < 0.4 THEN 'Negative'
                     ELSE 'Neutral' END AS sentiment FROM c)
SELECT *, CASE sentiment {DESC} ELSE 'balanced tone' END AS sentiment_desc FROM l"""


ORACLE["sentiment"] = sentiment_sql("prep", "text", DOCS + ",")
ORACLE["sentiment_raw"] = sentiment_sql("documents", "text", "")

LEVELS = L.READABILITY_LEVELS
LABEL = ("CASE " + " ".join(f"WHEN grade < {u} THEN {q(lab)}" for lab, u, _ in LEVELS if u is not None)
         + f" ELSE {q(LEVELS[-1][0])} END")
AUD = "CASE readability " + " ".join(f"WHEN {q(lab)} THEN {q(a)}" for lab, _, a in LEVELS) + " ELSE 'general' END"


def syl(w: str) -> str:
    n = f"len(regexp_extract_all(lower({w}), '[aeiou]+'))"
    return f"greatest(1, CASE WHEN suffix(lower({w}), 'e') THEN greatest(1, {n} - 1) ELSE {n} END)"


ORACLE["readability"] = f"""WITH {DOCS},
s AS (SELECT doc_id, {az('content', 1, lower=False, upper_ok=True)} AS w,
             len(list_filter(string_split_regex(content, '[.!?]+'), lambda z: length({strip('z')}) > 10)) AS sc
      FROM prep),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 OR sc = 0 THEN 0.0
                          ELSE round(0.39 * (len(w) / sc) + 11.8 * (list_sum(list_transform(w, lambda t: {syl('t')}))
                                     / len(w)) - 15.59, 1) END AS grade FROM s),
l AS (SELECT doc_id, grade, {LABEL} AS readability FROM g)
SELECT doc_id, round(grade, 6) AS grade, readability, {AUD} AS level FROM l"""


def nlp_kw_sql(top: int, ngram) -> str:
    toks = (f"list_filter(regexp_split_to_array(lower(cleaned_text), {q(NON_WORD)}), lambda t: "
            f"regexp_full_match(t, '[\\p{{L}}\\p{{N}}_]{{2,}}') AND NOT list_contains({ENGLISH}, t))")
    parts = []
    if ngram[0] <= 1 <= ngram[1]:
        parts.append("list_transform(t, lambda x: x)")
    if ngram[0] <= 2 <= ngram[1]:
        parts.append("list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])")
    allg = parts[0] if len(parts) == 1 else f"list_concat({', '.join(parts)})"
    return f"""WITH {DOCS},
t AS (SELECT doc_id, {toks} AS t FROM prep),
g AS (SELECT doc_id, unnest({allg}) AS term FROM t),
c AS (SELECT doc_id, term, count(*) AS count FROM g GROUP BY doc_id, term),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) AS rk FROM c)
SELECT doc_id, term, count, (row_number() OVER (PARTITION BY doc_id ORDER BY term))::INTEGER AS ord
FROM r WHERE rk <= {top}"""


ORACLE["nlp_keywords"] = nlp_kw_sql(20, (1, 2))
ORACLE["nlp_bigrams"] = nlp_kw_sql(10, (2, 2))

ORACLE["nlp_word_stats"] = f"""WITH {DOCS},
w AS (SELECT doc_id, cleaned_text, list_filter(string_split_regex(cleaned_text, {q(f'[{WS}]+')}),
                                               lambda t: t <> '') AS w FROM prep)
SELECT doc_id, len(w)::INTEGER AS word_count, len(list_distinct(w))::INTEGER AS unique_words,
       round(round(coalesce(list_sum(list_transform(w, lambda t: length(t))), 0) / greatest(len(w), 1), 1), 6)
           AS avg_word_length,
       len(list_filter(string_split_regex(cleaned_text, '[.!?]'), lambda z: length({strip('z')}) > 20))::INTEGER
           AS sentence_count
FROM w"""


def first_line_sql(page: str, width: int) -> str:
    return f"substring({strip(f'string_split({strip(page)}, chr(10))[1]')}, 1, {width})"


ISUPPER = "(regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '\\p{{Ll}}|\\p{{Lt}}'))"

ORACLE["summary_sentences"] = f"""WITH {pages_cte('sp', 'documents', 8, 'chr(10)')},
fl AS (SELECT doc_id, page_no, {first_line_sql('page', 40)} AS h FROM sp),
hc AS (SELECT doc_id, h, count(*) AS n, min(page_no) AS fp FROM fl GROUP BY doc_id, h),
hr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fp) AS rk FROM hc),
hdr AS (SELECT doc_id, substring(h, 1, 25) AS skip FROM hr WHERE rk = 1 AND n > 2),
p AS (SELECT sp.doc_id, sp.page_no, hdr.skip,
             list_transform(string_split({strip('sp.page')}, chr(10)), lambda l: {strip('l')}) AS lines
      FROM sp LEFT JOIN hdr USING (doc_id) WHERE sp.page_no <= 5),
k AS (SELECT doc_id, page_no, list_filter(list_transform(lines, lambda l:
        CASE WHEN NOT (skip IS NOT NULL AND starts_with(l, skip)) AND length(l) >= 40
                  AND NOT {ISUPPER.format(x='l')}
                  AND len(regexp_extract_all(l, '\\p{{Nd}}')) <= length(l) * 0.4
                  AND length(CASE WHEN substring(l, 1, 1) IN ('•', '➢', '→', '-', '*', '►')
                                  THEN {strip('substring(l, 2)')} ELSE l END) > 40
             THEN substring(CASE WHEN substring(l, 1, 1) IN ('•', '➢', '→', '-', '*', '►')
                                 THEN {strip('substring(l, 2)')} ELSE l END, 1, 200) END),
        lambda x: x IS NOT NULL) AS c FROM p)
SELECT doc_id, page_no, c[1] AS sentence FROM k WHERE len(c) > 0"""

ORACLE["repeated_header"] = f"""WITH {pages_cte('p1', 'documents', 1)},
fl AS (SELECT doc_id, page_no, {first_line_sql('page', 60)} AS header FROM p1),
c AS (SELECT doc_id, header, count(*) AS n, min(page_no) AS fp FROM fl GROUP BY doc_id, header),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fp) AS rk FROM c)
SELECT doc_id, header, n AS pages_with_header FROM r WHERE rk = 1 AND n >= 3"""


def page_clean_sql(pages: str) -> str:
    """CTE chain ending in ``pc(doc_id, page_no, n_pages, lines, clean_text)`` from a pages CTE."""
    return f"""fl AS (SELECT doc_id, page_no, {first_line_sql('page', 60)} AS header FROM {pages}),
hc AS (SELECT doc_id, header, count(*) AS n, min(page_no) AS fp FROM fl GROUP BY doc_id, header),
hr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, fp) AS rk FROM hc),
hdr AS (SELECT doc_id, header FROM hr WHERE rk = 1 AND n >= 3),
pl AS (SELECT p.doc_id, p.page_no, p.n_pages, hdr.header,
              list_filter(list_transform(string_split({strip('p.page')}, chr(10)), lambda l: {strip('l')}),
                          lambda l: l <> '') AS lines0
       FROM {pages} p LEFT JOIN hdr USING (doc_id)),
pl2 AS (SELECT doc_id, page_no, n_pages, list_filter(lines0, lambda l: NOT (
          (header IS NOT NULL AND header <> '' AND contains(substring(l, 1, 80), header))
          OR regexp_matches(l, {q(PAGE_NUMBER_LINE)}) OR regexp_matches(l, {q(PAGE_WORD_LINE)}))) AS lines
        FROM pl),
pc AS (SELECT doc_id, page_no, n_pages, lines, {strip("array_to_string(lines, ' ')")} AS clean_text FROM pl2
       WHERE {strip("array_to_string(lines, ' ')")} <> '')"""


ORACLE["page_clean"] = f"""WITH {pages_cte('sp', 'documents', 8, 'chr(10)')},
{page_clean_sql('sp')}
SELECT doc_id, page_no, clean_text FROM pc"""

ORACLE["page_chunk_words"] = f"""WITH {DOCS},
w AS (SELECT doc_id, list_filter(string_split_regex(cleaned_text, {q(f'[{WS}]+')}), lambda t: t <> '') AS w
      FROM prep),
c AS (SELECT doc_id, list_transform(range(0, CAST(ceil(len(w) / 100) AS BIGINT)),
                                    lambda i: array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ')) AS pg FROM w)
SELECT doc_id, unnest(range(1, len(pg) + 1))::INTEGER AS page_no, len(pg)::INTEGER AS n_pages,
       unnest(pg) AS page FROM c"""

ORACLE["page_keywords"] = f"""WITH {DOCS},
{page_clean_sql('pages')},
w AS (SELECT doc_id, page_no, {minus(az('clean_text', 4), PAGE)} AS w FROM pc),
ex AS (SELECT doc_id, page_no, unnest(w) AS keyword, unnest(range(0, len(w))) AS pos FROM w),
c AS (SELECT doc_id, page_no, keyword, count(*) AS count, min(pos) AS first FROM ex GROUP BY ALL),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY count DESC, first))::INTEGER AS rank
      FROM c)
SELECT doc_id, page_no, rank, keyword, count FROM r WHERE rank <= 5"""

SENT_SPLIT = f"string_split(regexp_replace(clean_text, {q(f'([.!?])[{WS}]+')}, '\\1' || chr(1), 'g'), chr(1))"

ORACLE["key_sentences"] = f"""WITH {DOCS},
{page_clean_sql('pages')},
s0 AS (SELECT doc_id, page_no, list_filter(list_transform({SENT_SPLIT}, lambda z: {strip('z')}),
                                           lambda z: length(z) > 20 AND length(z) < 300) AS s FROM pc),
s AS (SELECT doc_id, page_no, unnest(s) AS sentence, unnest(range(0, len(s))) AS s_no FROM s0),
fw AS (SELECT doc_id, page_no, unnest({minus(az('clean_text', 4), PAGE)}) AS word FROM pc),
freq AS (SELECT doc_id, page_no, word, count(*) AS f FROM fw GROUP BY ALL),
sw AS (SELECT doc_id, page_no, s_no, sentence, unnest({minus(az('sentence', 4), PAGE)}) AS word FROM s),
sc AS (SELECT s.doc_id, s.page_no, s.s_no, s.sentence,
              coalesce((SELECT sum(f.f) FROM sw JOIN freq f USING (doc_id, page_no, word)
                        WHERE sw.doc_id = s.doc_id AND sw.page_no = s.page_no AND sw.s_no = s.s_no), 0)
              / greatest((SELECT count(*) FROM sw WHERE sw.doc_id = s.doc_id AND sw.page_no = s.page_no
                          AND sw.s_no = s.s_no), 1) AS score
       FROM s),
r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round(score, 9) DESC, sentence DESC))
                ::INTEGER AS rank FROM sc)
SELECT doc_id, page_no, rank, sentence, round(score, 6) AS score FROM r WHERE rank <= 2"""

ORACLE["lexical_diversity"] = f"""WITH {DOCS},
w AS (SELECT doc_id, {minus(az('cleaned_text', 3), ENGINE)} AS w FROM prep),
d AS (SELECT doc_id, len(w) AS n, round(len(list_distinct(w)) / greatest(len(w), 1), 3) AS d FROM w)
SELECT doc_id, n::INTEGER AS content_words, round(d, 6) AS lex_diversity,
       CASE WHEN d > 0.7 THEN 'rich' WHEN d > 0.4 THEN 'moderate' ELSE 'repetitive' END AS vocabulary FROM d"""

ORACLE["sentence_complexity"] = f"""WITH {DOCS},
s AS (SELECT doc_id, list_transform(list_filter(string_split_regex(content, '[.!?]+'),
                                                lambda z: length({strip('z')}) > 10), lambda z: {strip('z')}) AS s
      FROM prep),
a AS (SELECT doc_id, coalesce(list_sum(list_transform(s, lambda z: len(list_filter(
              string_split_regex(z, {q(f'[{WS}]+')}), lambda t: t <> '')))), 0) / greatest(len(s), 1) AS avg
      FROM s)
SELECT doc_id, round(avg, 6) AS avg_sentence_words,
       CASE WHEN avg > 25 THEN 'High' WHEN avg > 15 THEN 'Medium' ELSE 'Low' END AS complexity FROM a"""

KW_CTE = DOCS + ",\n" + tfidf_ctes("pages", 10)

ORACLE["term_density"] = f"""WITH {KW_CTE},
b AS (SELECT doc_id, lower(cleaned_text) AS low,
             greatest(len({minus(az('cleaned_text', 3), ENGINE)}), 1) AS total FROM prep)
SELECT kw.doc_id, kw.rank, kw.keyword,
       round(round(((length(b.low) - length(replace(b.low, kw.keyword, ''))) / length(kw.keyword))
                   / (b.total / 1000.0), 2), 6) AS density
FROM kw JOIN b USING (doc_id) WHERE kw.rank <= 5"""

ORACLE["topic_coherence"] = f"""WITH {KW_CTE},
pgw AS (SELECT doc_id, page_no, unnest(list_distinct({az('page', 4)})) AS word FROM pages),
hits AS (SELECT pgw.doc_id, count(*) AS hits FROM pgw JOIN kw ON kw.doc_id = pgw.doc_id AND kw.keyword = pgw.word
         GROUP BY pgw.doc_id),
nt AS (SELECT doc_id, count(*) AS n_terms FROM kw GROUP BY doc_id),
np AS (SELECT doc_id, max(n_pages) AS n_pages FROM pages GROUP BY doc_id)
SELECT np.doc_id, round(CASE WHEN np.n_pages <= 1 THEN 1.0 WHEN coalesce(nt.n_terms, 0) = 0 THEN 0.0
                             ELSE round(coalesce(hits.hits, 0) / (nt.n_terms * np.n_pages), 3) END, 6) AS coherence
FROM np LEFT JOIN nt USING (doc_id) LEFT JOIN hits USING (doc_id)"""


# ---------------------------------------------------------------------------
# 2-D domain views over the alias fixtures
# ---------------------------------------------------------------------------

from quarry.plans.oracle import grouped_box_sql  # noqa: E402

STROKE = ("SELECT l.toxic AS stroke, l.quality AS hypertension, d.n_chars::DOUBLE AS bmi, d.lang AS smoking_status "
          "FROM labels l JOIN documents d USING (doc_id)")
ASTHMA = ("SELECT l.toxic AS has_asthma, d.n_chars::DOUBLE AS bmi, l.quality::DOUBLE AS age, d.lang AS gender, "
          "d.lang AS smoking_status FROM labels l JOIN documents d USING (doc_id)")
DELIVERY = ("SELECT l_quantity AS distance_km, l_extendedprice AS delivery_time_min, l_returnflag AS traffic_level, "
            "l_linestatus AS weather, l_linestatus AS vehicle_type FROM lineitem")
WEATHER = ("SELECT o_orderdate AS date, o_totalprice AS temp_max, o_totalprice / 2 AS temp_min, "
           "o_orderstatus AS weather FROM orders")
SALES = ("SELECT p.p_type AS PRODUCTLINE, l.l_extendedprice AS SALES, l.l_shipdate AS ORDERDATE, "
         "CASE WHEN l.l_quantity < 10 THEN 'Small' WHEN l.l_quantity < 35 THEN 'Medium' ELSE 'Large' END AS DEALSIZE "
         "FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey")

ORACLE["health_counts"] = f"""WITH s AS ({STROKE}),
l AS (SELECT CAST(stroke AS VARCHAR) AS stroke, 'hypertension' AS field, CAST(hypertension AS VARCHAR) AS value FROM s
      UNION ALL SELECT CAST(stroke AS VARCHAR), 'smoking_status', smoking_status FROM s)
SELECT field, value, stroke, count(*) AS count FROM l WHERE value IS NOT NULL AND stroke IS NOT NULL GROUP BY ALL"""

ORACLE["health_distributions"] = grouped_box_sql(STROKE, "stroke", ["bmi"]).replace(
    "SELECT target,", "SELECT target AS stroke,", 1)

ORACLE["delivery_scatter_fit"] = ORACLE["linear_fit"]

ORACLE["delivery_by_traffic"] = f"""WITH b AS ({grouped_box_sql(DELIVERY, 'traffic_level', ['delivery_time_min'])})
SELECT q1, median, q3, whislo, whishi, n_fliers, n, min, max, target AS traffic_level,
       (row_number() OVER (ORDER BY median, target))::INTEGER AS "order" FROM b"""

ORACLE["delivery_by_weather"] = f"""WITH s AS ({DELIVERY}),
g AS (SELECT CAST(weather AS VARCHAR) AS key, avg(delivery_time_min::DECIMAL(38, 10))::DOUBLE AS value FROM s
      WHERE weather IS NOT NULL GROUP BY 1)
SELECT key, round(value, 6) AS value, (row_number() OVER (ORDER BY value DESC, key))::INTEGER AS "order" FROM g"""


def month_fill(src: str, date: str, value: str, how: str) -> str:
    agg = {"avg": f"avg({value})", "sum": f"sum({value})"}[how]
    fill = "0.0" if how == "sum" else "NULL"
    return f"""(WITH s AS ({src}),
per AS (SELECT CAST(last_day({date}) AS TIMESTAMP) AS bucket, {agg}::DOUBLE AS value FROM s
        WHERE {date} IS NOT NULL GROUP BY 1),
rng AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM per),
allb AS (SELECT CAST(last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi),
                                                     INTERVAL 1 MONTH))) AS TIMESTAMP) AS bucket FROM rng)
SELECT allb.bucket, coalesce(per.value, {fill}) AS value FROM allb LEFT JOIN per USING (bucket))"""


ORACLE["weather_monthly"] = f"""SELECT 'temp_max' AS measure, bucket, round(value, 6) AS mean
FROM {month_fill(WEATHER, 'date', 'temp_max', 'avg')}
UNION ALL SELECT 'temp_min', bucket, round(value, 6) FROM {month_fill(WEATHER, 'date', 'temp_min', 'avg')}"""

ORACLE["weather_frequency"] = f"""WITH s AS ({WEATHER}),
c AS (SELECT CAST(weather AS VARCHAR) AS value, count(*) AS count FROM s WHERE weather IS NOT NULL GROUP BY 1)
SELECT value, count, (row_number() OVER (ORDER BY count DESC, value))::INTEGER AS rank FROM c"""

ORACLE["weather_temp_range"] = f"""SELECT coalesce(a.bucket, b.bucket) AS bucket, round(a.value, 6) AS max_mean,
       round(b.value, 6) AS min_mean
FROM {month_fill(WEATHER, 'date', 'temp_max', 'avg')} a
FULL JOIN {month_fill(WEATHER, 'date', 'temp_min', 'avg')} b USING (bucket)"""

ORACLE["sales_by_productline"] = f"""WITH s AS ({SALES}),
g AS (SELECT CAST(PRODUCTLINE AS VARCHAR) AS key, sum(SALES::DECIMAL(38, 10))::DOUBLE AS value FROM s
      WHERE PRODUCTLINE IS NOT NULL GROUP BY 1)
SELECT key, round(value, 6) AS value, (row_number() OVER (ORDER BY value DESC, key))::INTEGER AS "order" FROM g"""

ORACLE["sales_monthly_trend"] = f"""SELECT bucket, round(value, 6) AS value
FROM {month_fill(SALES, 'ORDERDATE', 'SALES', 'sum')}"""

ORACLE["sales_deal_size"] = f"""WITH s AS ({SALES}),
c AS (SELECT DEALSIZE AS value, count(*) AS count FROM s WHERE DEALSIZE IS NOT NULL GROUP BY 1)
SELECT value, count, (row_number() OVER (ORDER BY count DESC, value))::INTEGER AS rank,
       round(count * 100.0 / sum(count) OVER (), 6) AS pct FROM c"""

ORACLE["asthma_box"] = grouped_box_sql(ASTHMA, "has_asthma", ["bmi", "age"])

ORACLE["asthma_crosstab"] = f"""WITH s AS ({ASTHMA}),
l AS (SELECT has_asthma, 'smoking_status' AS "column", smoking_status AS value FROM s
      UNION ALL SELECT has_asthma, 'gender', gender FROM s),
c AS (SELECT "column", value, CAST(has_asthma AS VARCHAR) AS target, count(*) AS count FROM l
      WHERE value IS NOT NULL AND has_asthma IS NOT NULL GROUP BY ALL)
SELECT *, round(count / sum(count) OVER (PARTITION BY "column", value), 6) AS share FROM c"""

ORACLE["text_column_terms"] = f"""WITH w AS (SELECT unnest({minus(az('text', 4), CHART)}) AS term FROM documents),
c AS (SELECT term, count(*) AS count FROM w GROUP BY term),
r AS (SELECT *, (row_number() OVER (ORDER BY count DESC, term))::INTEGER AS rank FROM c)
SELECT term, count, rank FROM r WHERE rank <= 15"""

ORACLE["label_distribution"] = """WITH c AS (SELECT lang AS value, count(*) AS count FROM documents
                 WHERE lang IS NOT NULL GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY count DESC, value))::INTEGER AS rank FROM c)
SELECT value, count, rank FROM r WHERE rank <= 10"""

# ---------------------------------------------------------------------------
# 2-E outliers
# ---------------------------------------------------------------------------


def iqr_sql(src: str, cols, health: bool) -> str:
    qs = ", ".join(f"quantile_cont({c}::DOUBLE, 0.25) AS a{i}, quantile_cont({c}::DOUBLE, 0.75) AS b{i}"
                   for i, c in enumerate(cols))
    flag = " OR ".join(f"({c}::DOUBLE < a{i} - 1.5 * (b{i} - a{i}) OR {c}::DOUBLE > b{i} + 1.5 * (b{i} - a{i}))"
                       for i, c in enumerate(cols))
    advice = f"CASE sev WHEN 'low' THEN {q(S.ADVICE['low'])} WHEN 'moderate' THEN {q(S.ADVICE['moderate'])} ELSE {q(S.ADVICE['high'])} END"
    summ = S.said_sql(S.IQR + (S.HEALTH_NOTE if health else ""), count="n_anomalies", total="format('{:,}', total)",
                      rate="CAST(pct AS VARCHAR)", severity="sev", advice=advice)
    return f"""WITH s AS ({src}), qq AS (SELECT {qs} FROM s),
a AS (SELECT count_if(coalesce({flag}, false)) AS n_anomalies, count(*) AS total FROM s CROSS JOIN qq),
b AS (SELECT *, round(n_anomalies * 100.0 / total, 2) AS pct FROM a),
c AS (SELECT *, CASE WHEN pct < 3 THEN 'low' WHEN pct < 10 THEN 'moderate' ELSE 'high' END AS sev FROM b)
SELECT n_anomalies, total, pct AS anomaly_pct, sev AS severity, {summ} AS summary FROM c"""


ORACLE["anomaly_iqr"] = iqr_sql("SELECT * FROM events", ["event_id", "user_id", "value"], False)
ORACLE["anomaly_iqr_health"] = iqr_sql(f"SELECT DISTINCT * FROM ({STROKE})", ["stroke", "hypertension", "bmi"], True)

ORACLE["anomaly_severity"] = f"""WITH r AS ({ORACLE['anomaly_iqr']})
SELECT anomaly_pct, CASE WHEN anomaly_pct < 3 THEN 'low' WHEN anomaly_pct < 8 THEN 'moderate' ELSE 'high' END
         AS forest_scale,
       CASE WHEN anomaly_pct < 3 THEN 'low' WHEN anomaly_pct < 10 THEN 'moderate' ELSE 'high' END AS iqr_scale
FROM r"""

_ENT, _LOW, _MID, _HIGH = S.ANOMALY_PHRASES["sales"]
_TOLD = S.said_sql(S.ANOMALY, count="n_anomalies", total="total", entity=q(_ENT), rate="CAST(anomaly_pct AS VARCHAR)", severity="sev2",
                   advice=f"CASE sev2 WHEN 'low' THEN {q(_LOW)} WHEN 'moderate' THEN {q(_MID)} ELSE {q(_HIGH)} END")
ORACLE["anomaly_narrative"] = f"""WITH r AS ({iqr_sql('SELECT * FROM lineitem', ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber',
                                                                     'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'], False)}),
s AS (SELECT *, CASE WHEN anomaly_pct < 3 THEN 'low' WHEN anomaly_pct < 8 THEN 'moderate' ELSE 'high' END AS sev2
      FROM r)
SELECT 'sales' AS domain, {_TOLD} AS ml_result FROM s"""


# ---------------------------------------------------------------------------
# 2-A, 2-H
# ---------------------------------------------------------------------------

ORACLE["json_flatten"] = """SELECT event_id AS doc_id, j.key AS path, j.key || ': ' || j.value AS line
FROM events, json_each(props) AS j"""

HISTORY = ("SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS file_name, "
           "floor(o_totalprice * 100)::BIGINT AS file_size, o_orderstatus AS file_type, "
           "'Report for order ' || o_orderkey AS insights, o_orderstatus = 'F' AS has_report, "
           "o_orderdate AS upload_date FROM orders")
SETTINGS = ("SELECT o_orderkey AS id, o_orderstatus AS analysis_type, o_orderpriority AS report_format, "
            "CASE WHEN o_totalprice > 100000 THEN 'Enabled' ELSE 'Disabled' END AS visual_charts, "
            "o_orderdate AS created_at FROM orders")

ORACLE["history_list"] = f"""WITH h AS ({HISTORY})
SELECT user_id, id, (row_number() OVER (PARTITION BY user_id ORDER BY id DESC))::INTEGER AS position FROM h"""

ORACLE["history_search"] = f"""WITH h AS ({HISTORY}),
m AS (SELECT * FROM h WHERE file_name ILIKE '%urgent%' OR file_type ILIKE '%urgent%' OR insights ILIKE '%urgent%')
SELECT user_id, id, file_name, (row_number() OVER (PARTITION BY user_id ORDER BY id DESC))::INTEGER AS position
FROM m"""

ORACLE["history_kpis"] = f"""WITH h AS ({HISTORY}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS rk FROM h)
SELECT user_id, count(*) AS total_uploads, count_if(has_report) AS total_reports,
       string_agg(CASE WHEN rk <= 5 THEN CAST(id AS VARCHAR) END, ',' ORDER BY rk) AS recent_ids
FROM r GROUP BY user_id"""

ORACLE["history_get"] = f"""WITH h AS ({HISTORY})
SELECT id, user_id, file_name, file_type, insights, upload_date FROM h
WHERE id IN (1, 2, 3, 4, 5, 32, 33, 34, 35, 36, 37, 38, 39)"""

ORACLE["history_duplicate"] = f"""WITH h AS ({HISTORY})
SELECT file_name, file_size, max(id) AS existing_id FROM h GROUP BY file_name, file_size"""

ORACLE["settings_latest"] = f"""WITH s AS ({SETTINGS})
SELECT * FROM s ORDER BY id DESC LIMIT 1"""

ORACLE["settings_upsert"] = f"""WITH s AS ({SETTINGS})
SELECT * FROM s WHERE id <> (SELECT max(id) FROM s)
UNION ALL SELECT max(id), 'full', 'Detailed Report', 'Enabled', TIMESTAMP '2024-01-01 00:00:00' FROM s"""


# ---------------------------------------------------------------------------
# research sections, report selection
# ---------------------------------------------------------------------------

from quarry.operators.text_structure import SECTION_PATTERNS  # noqa: E402

ORACLE["research_sections"] = "SELECT doc_id, " + ", ".join(
    f"{strip(f'regexp_extract(lower(replace(text, chr(10), {q(chr(32))})), {q(pat)}, {grp})')} AS {name}"
    for name, pat, grp in SECTION_PATTERNS) + " FROM documents"
