"""Texts are split once: no inferred filter builds an array a second time; the fast forms equal the plain ones."""

import re

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import report as RP
from quarry.operators import text_ops as TO
from quarry.operators import text_pages as TP
from quarry.operators import text_structure as TS
from quarry.plans import documents as D


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_arrays_are_built_once(spark):
    docs = spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string")
    prep = D.prepared(docs)
    once = [TP.scan_text_pages(docs), TP.page_chunk_words(prep), TO.keyphrases(prep), TO.nlp_keywords(prep, "cleaned_text"),
            D.linguistic_summary(docs), D.text_analysis(docs), TO.document_type(prep, "cleaned_text")]
    for df in once:
        assert plan(df).count(T.LINE_BREAKS) == 1, plan(df)
    pages = spark.createDataFrame([(1, 1, 1, "a b")], "doc_id long, page_no int, n_pages int, page string")
    assert plan(TP.page_clean(pages)).count(T.WS_CHARS) <= 5
    items = RP.breakdown_split(spark.createDataFrame([(1, "a || b || ")], "doc_id long, breakdown string"))
    assert plan(items).count("split(breakdown") == 1
    assert [(r.item_ord, r.item) for r in items.collect()] == [(0, "a"), (1, "b")]


def test_rows_of_empty_arrays(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "one\n\x85two ")], "doc_id long, text string")
    assert [tuple(r) for r in TP.scan_text_pages(docs).collect()] == [(4, 1, 1, "one two")]
    assert [r.doc_id for r in D.linguistic_summary(docs).collect()] == [4]


def test_strip_and_words_equal_the_regular_expressions(spark):
    texts = [f"{c}x{c}y {c}" for c in T.WS_CHARS] + ["", "a​b", "　", "é_1 ab cd", "𝒳abc abc𝒳 😀abc x9 ABC İk"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    plain = F.regexp_replace("t", rf"^[{T.WS}]+|[{T.WS}]+$", "")
    words = F.filter(F.split(F.lower("t"), T.NON_WORD), lambda w: w.rlike("^[a-z]{2,}$"))
    for r in df.select(T.strip_ws(F.col("t")), plain, T.az_words(F.col("t"), 2), words, T.spaced_words(F.col("t")), "t").collect():
        assert r[0] == r[1] and r[2] == r[3] and r[4] == r.t.split()


def test_syllables(spark):
    words = "the apple tree rhythm create movie e eye queue Area nth CAFE ae".split()

    def of(w):
        w, n = w.lower(), len(re.findall("[aeiou]+", w.lower()))
        return max(1, max(1, n - 1) if w.endswith("e") else n)
    rows = spark.createDataFrame([([w],) for w in words] + [(words,), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(TO.syllables(F.col("w"))).collect()] == [of(w) for w in words] + [sum(map(of, words)), 0]


def test_keywords_with_a_space_and_null_texts(spark):
    df = spark.createDataFrame([(1, "See HOW TO do"), (2, None), (3, ""), (4, "factory")], "doc_id long, t string")
    got = {r.doc_id: r.c for r in df.select("doc_id", TO.keyword_class(
        F.col("t"), [("x", ["act"]), ("y", ["how to", "see"])], "none").alias("c")).collect()}
    assert got == {1: "y", 2: "none", 3: "none", 4: "x"}


def test_page_without_a_sentence(spark):
    clean = spark.createDataFrame([(1, 1, "short"), (1, 2, "words words words again and again.")], "doc_id long, page_no int, clean_text string")
    assert [(r.page_no, r.sentence) for r in TS.key_sentences(clean).collect()] == [(2, "words words words again and again.")]


def test_plain_line_breaks_need_no_regular_expression(spark):
    texts = ["a\n\n b \nc", "", "\n", "a", None] + [f"x {c}{c} y\n{c}z" for c in "\r" + T.OTHER_BREAKS]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.stripped_lines(F.col("t"))).collect():
        assert r[1] == (None if r.t is None else [x.strip() for x in r.t.splitlines() if x.strip()])
    assert "split(t#" in plan(df.select(T.stripped_lines(F.col("t")))) and plan(df.select(T.stripped_lines(F.col("t")))).count("split(t#") == 2


def test_each_different_word_is_searched_once(spark):
    classes = [("x", ["act", "no way", "zz"]), ("y", ["or", "way", "a"])]
    rows = [(1, "FACTORY factory no  way"), (2, "no way act"), (3, "act\nno way zz"), (4, ""), (5, None), (6, "or\tway")]
    df = spark.createDataFrame(rows, "doc_id long, t string")
    cls = TO.keyword_class(F.col("t"), classes, "none")
    want = {}
    for i, t in rows:
        n = [sum(k in (t or "").lower() for k in ks) for _, ks in classes]
        want[i] = classes[n.index(max(n))][0] if max(n) else "none"
    assert {r.doc_id: r.c for r in df.select("doc_id", cls.alias("c")).collect()} == want
    assert "array_distinct" in plan(df.select(cls))
