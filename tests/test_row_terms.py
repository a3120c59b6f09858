"""Terms counted inside the row against plain Python, and plans without an exchange."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import lexicons as L
from quarry.operators import row_terms as R
from quarry.operators import text_ops as TO
from quarry.operators import text_structure as TS
from quarry.plans import documents as D

WORDS = "alpha beta gamma delta the and sun sea data model x1 ünder error errors a of".split()


def words(text, n, stop):
    return [w for w in re.findall(r"\w+", text.lower()) if re.fullmatch(f"[a-z]{{{n},}}", w) and w not in stop]


def texts(seed=7, n=40):
    rng = random.Random(seed)
    out = ["", " ", "the of and", "alpha", "Alpha alpha ALPHA"]
    return out + [" ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "!", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, "beta sun beta sun"), (901, "gamma")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_doc(df, *cols):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.asDict().get("rank") or r.asDict().get("ord"))):
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols))
    return out


def test_phrases(docs):
    want = {}
    for i, t in enumerate(texts()):
        w = words(t, 3, L.ENGINE_STOPWORDS)
        g = [" ".join(w[k:k + n]) for n in (2, 3) for k in range(len(w) - n + 1) if all(len(x) > 3 for x in w[k:k + n])]
        if g:
            want[i] = Counter(g).most_common(10)
    got = by_doc(TO.keyphrases(docs, "text", 10), "phrase", "count")
    assert {k: v for k, v in got.items() if k < 900} == want and 900 not in got


def test_tfidf_over_pages(docs):
    def best(pages):
        per = [words(p, 4, L.ENGINE_STOPWORDS) for p in pages]
        first, tf, df = {}, Counter(), Counter()
        for i, p in enumerate(per):
            for j, w in enumerate(p):
                first.setdefault(w, (i, j))
            for w, c in Counter(p).items():
                tf[w] += c / len(p)
                df[w] += 1
        score = {w: tf[w] * (math.log((len(pages) + 1) / (df[w] + 1)) + 1) for w in tf}
        return [(w, round(score[w], 6)) for w in sorted(score, key=lambda w: (-round(score[w], 9), first[w]))[:5]]
    got = by_doc(TO.tfidf_of_documents(docs, F.split("text", "\n"), 5).withColumn("score", F.round("score", 6)), "keyword", "score")
    want = {i: best(t.split("\n")) for i, t in enumerate(texts())}
    assert {k: v for k, v in got.items() if k < 900} == {k: v for k, v in want.items() if v}
    # rows that repeat an id count each for itself
    assert sorted(w for w, _ in got[901]) == ["beta", "gamma"]


def test_rows_of_pages_give_the_same_terms(docs):
    one = docs.where("doc_id < 900").withColumn("p", F.split("text", "\n"))
    pages = one.select("doc_id", F.size("p").alias("n_pages"), F.posexplode("p").alias("_i", "page")).withColumn("page_no", F.col("_i") + 1)
    fields = ("keyword", "score")
    a = by_doc(TO.tfidf_of_documents(one, F.col("p"), 20).withColumn("score", F.round("score", 9)), *fields)
    b = by_doc(TO.tfidf_keywords(pages, 20).withColumn("score", F.round("score", 9)), *fields)
    assert a == b
    a = by_doc(TO.headings_of_documents(one, F.col("p")), "title", "page")
    assert a == by_doc(TO.headings(pages), "title", "page")


def test_common_grams(docs):
    def best(t):
        w = [x for x in re.findall(r"\w+", t.lower()) if len(x) > 1 and x not in L.ENGLISH_STOPWORDS]
        c = Counter(w + [" ".join(p) for p in zip(w, w[1:])])
        return sorted(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:7])
    got = by_doc(TO.nlp_keywords(docs, "text", 7, (1, 2)), "term", "count")
    want = {i: best(t) for i, t in enumerate(texts())}
    assert {k: v for k, v in got.items() if k < 900} == {k: v for k, v in want.items() if v}


def test_key_sentences(docs):
    clean = docs.where("doc_id < 900").select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("clean_text"))

    def best(t):
        f = Counter(words(t, 4, L.PAGE_STOPWORDS))
        out = []
        for s in re.split(r"(?<=[.!?])\s+", t):
            s = s.strip()
            if 20 < len(s) < 300:
                w = words(s, 4, L.PAGE_STOPWORDS)
                out.append((round(sum(f[x] for x in w) / max(len(w), 1), 6), s))
        return [(s, v) for v, s in sorted(out, reverse=True)[:2]]
    got = by_doc(TS.key_sentences(clean, 2).withColumn("score", F.round("score", 6)), "sentence", "score")
    want = {i: best(t) for i, t in enumerate(texts())}
    assert got == {k: v for k, v in want.items() if v}


def test_no_exchange_of_documents(docs):
    plans = [TO.keyphrases(docs), TO.nlp_keywords(docs), TO.tfidf_of_documents(docs, F.split("text", "\n")),
             TO.headings_of_documents(docs, F.split("text", "\n")), TO.topic_coherence(docs, F.split("text", "\n")),
             TO.term_density(docs, F.array(F.lit("data"))), D.linguistic_summary(docs)]
    for df in plans:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    whole = D.text_analysis(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in whole and "SortMergeJoin" not in whole and whole.count("Scan ExistingRDD") <= 4


def test_long_text_is_linear(spark):
    n = 200_000
    one = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(
        F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word"), F.translate((i % 997).cast("string"), "0123456789", "abcdefghij"))), " ").alias("text"))
    top = TO.keyphrases(one, "text", 3).collect()
    assert len(top) == 3 and top[0]["count"] == n // 997 + 1


def test_frequent_terms_are_counted_without_a_lambda_over_all_of_them(spark, docs):
    for df in (TO.keyphrases(docs), TS.page_keywords(docs.select("doc_id", F.lit(1).alias("page_no"), F.col("text").alias("clean_text")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert R.REPEATED in plan and "pos, lambda" not in plan


def test_most_frequent_on_ties_and_few_terms(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice(["ab", "abc", "a b", "b", "ba", "c", "é", "ab c"]) for _ in range(rng.randrange(0, 30))], ) for i in range(200)]
    rows += [(900, []), (901, ["x"] * 30_000), (902, [f"w{i % 9000}" for i in range(9001)])]
    df = spark.createDataFrame(rows, "doc_id long, w array<string>")
    got = {r.doc_id: [(t.term, t["count"]) for t in r.a] for r in df.select("doc_id", R.top_words(F.col("w"), 4).alias("a")).collect()}
    assert got == {i: Counter(w).most_common(4) for i, w in rows}
    got = {r.doc_id: [(t.term, t["count"]) for t in r.a] for r in df.select("doc_id", R.common_grams(F.col("w"), 4, (1, 1)).alias("a")).collect()}
    assert got == {i: sorted(sorted(Counter(w).items(), key=lambda x: (-x[1], x[0]))[:4]) for i, w in rows}


def test_sentence_words_are_counted_as_lines(spark):
    """Words that begin or end like others, words of no page, many equal ones; the plan sorts no structs of words."""
    rows = [(1, ["ab abc", "zab ab ab", "q"], "ab ab abc zab"), (2, ["", "x y"], ""), (3, [], "ab"), (4, ["a " * 30_000], "a " * 20_000),
            (5, [f"w{'x' * i}" for i in range(12)], " ".join("w" + "x" * (i // 2) for i in range(24)))]
    df = spark.createDataFrame(rows, "doc_id long, s array<string>, p string")
    words_of = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    arr = R.scored_sentences(F.col("s"), words_of, words_of(F.col("p")), 12)
    for r in df.select("doc_id", "s", "p", arr.alias("a")).collect():
        f = Counter(r.p.split())
        want = sorted([(round(sum(f[w] for w in x.split()) / max(len(x.split()), 1), 9), x) for x in r.s], reverse=True)
        assert [(round(t.score, 9), t.sentence) for t in r.a or []] == want
    assert "struct(term, lambda" not in df.select(arr)._jdf.queryExecution().optimizedPlan().toString()
