"""Ranked lexical search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import ranked_search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS, ITEMS = "doc_id long, text string, rank int, score long, `a.b` string", "item_id long, text string, doc_id string"


def _terms(text):
    return TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, top=20):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_all, l_all = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in counts:
            m = 100 - 25 + (25 * n * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in _terms(text) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


def _run(spark, docs, items, parts=4):
    d = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in ranked_search.query(d, q).collect()), key=repr)


def _corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)] + ["Ünder", "ünder", "été", "K", "x1", "日本"]
    text = lambda size: " ".join(words[min(int(r.expovariate(1 / 40)), len(words) - 1)] for _ in range(size))
    docs = [(i, text(r.choice([1, 5, 40, 200]))) for i in range(n)]
    return docs, [(k, text(12)) for k in range(15)] + [(100, docs[3][1]), (101, docs[3][1])]


@pytest.mark.parametrize("segment, run", [(8192, 1024), (40, 3)])
def test_matches_brute_force(spark, monkeypatch, segment, run):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(ranked_search, "_RUN", run)
    docs, items = _corpus(700)
    docs += [(1000 + k, docs[3][1]) for k in range(60)]  # ties beyond k
    docs += [(2000, None), (2001, ""), (2002, "-- --"), (None, docs[3][1]), (5, "w1 w2"), (5, "w1 w2"), (3000, "w5 " * 400_000 + "w250")]
    items += [(200, None), (201, "... ?"), (202, "nowhere"), (203, "w1 W1 w1 w250 K k")]
    assert _run(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 5)
    docs, items = _corpus(200)
    assert _run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = _corpus(20)
    assert _run(spark, [], items) == [] and _run(spark, docs, []) == [] and _run(spark, [(1, None)], items) == []


def test_long_texts_are_split_between_terms(monkeypatch):
    text = ("Abc, déf-ghi " * 50 + "x" * 300 + " end").encode()
    whole = [w for p in ranked_search.terms_of(text) for w in p]
    monkeypatch.setattr(ranked_search, "_PIECE", 7)
    assert [w for p in ranked_search.terms_of(text) for w in p] == whole == [t.encode() for t in _terms(text.decode())]


def test_best_positions_stop_early():
    r = np.random.default_rng(0)
    n, lists = 5000, 6
    term, doc = np.repeat(np.arange(lists), n), np.tile(np.arange(n), lists)
    count = r.zipf(1.5, n * lists).clip(1, 10_000)
    count[doc < 30] = 100_000  # the same documents lead every list
    segment = ranked_search.Segment(term, doc, count, np.full(n, 100), n, n * 100)
    docs, scores = segment.search(np.arange(lists), np.full(lists, 7), 20)
    assert len(docs) < 200 and set(range(30)) & set(docs.tolist())
    whole = np.zeros(n, np.int64)
    np.add.at(whole, segment.doc, 7 * segment.impact)
    assert sorted(scores.tolist())[-20:] == sorted(whole.tolist())[-20:]
