"""TF-IDF inside a row: terms that repeat are scored one by one, those found once stand behind the first of their page."""

import math
import random

from pyspark.sql import functions as F

from quarry.operators import row_terms as R


def _expected(pages, k):
    split = [[w for w in p.split() if len(w) >= 4] for p in pages]
    terms = {}
    for i, words in enumerate(split):
        for j, w in enumerate(words):
            terms.setdefault(w, []).append((i, j))
    rows = []
    for w, places in terms.items():
        of_page = sorted({i for i, _ in places})
        tf = 0.0
        for i in of_page:
            tf += sum(p == i for p, _ in places) / len(split[i])
        score = tf * (math.log((len(pages) + 1) / (len(of_page) + 1)) + 1)
        rows.append((-round(score, 9), *places[0], w, len(of_page)))
    return [(r[3], r[1], r[2], r[4]) for r in sorted(rows)[:k]]


def test_tfidf_equals_a_plain_count(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    docs = [[], [""], ["one two"], ["same same same same"], ["alpha beta gamma delta"], ["alpha beta", "", "beta gamma zeta"],
            ["gamma gamma alpha", "alpha alpha gamma"]]
    docs += [[" ".join(word(r.randint(3, 6)) for _ in range(r.choice((0, 5, 40)))) for _ in range(r.randint(1, 4))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, pages array<string>")
    for k in (1, 5, 20):
        got = {x.id: x.t for x in df.select("id", R.tfidf(F.col("pages"), k, ["unused"]).alias("t")).collect()}
        for i, pages in enumerate(docs):
            assert [(t.keyword, t.page, t.pos, t.df) for t in got[i] or []] == _expected(pages, k), (i, k)


def test_only_repeated_terms_meet_the_scoring_lambda(spark):
    # each term found once costs no more than its line: the run pattern leaves it out
    lines = F.array(F.lit("bb\x011000000000\naa\x011000000000\nbb\x011000000001"))
    df = spark.range(1).select(R.runs_of_lines(lines, R.REPEATED_WORD).alias("r"))
    assert df.first().r == ["bb\x011000000000\nbb\x011000000001"]
