"""Exact top-k against brute force."""

import numpy as np
import pytest

from quarry.llm import exact_topk as tk


def _brute(ids, vectors, queries, top):
    out = {}
    for q in queries:
        s = sorted((-int(v @ vectors[q]), int(i)) for i, v in zip(ids, vectors) if i != ids[q])
        out[int(ids[q])] = [(i, -x) for x, i in s[:top]]
    return out


@pytest.mark.parametrize("seed,n,d,spread", [(0, 3000, 64, 90), (1, 2000, 40, 3), (2, 20, 7, 100), (3, 9000, 64, 2000), (4, 4, 3, 5)])
def test_search_matches_brute_force(seed, n, d, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(0, spread, (8, d))
    v = np.floor(centres[r.integers(0, 8, n)] + r.normal(0, spread / 4, (n, d)))
    v[n // 2:n // 2 + n // 10] = v[0]  # ties
    ids = r.permutation(n * 3)[:n].astype(np.int64)
    queries = np.arange(0, n, max(1, n // 300))
    s = tk.Search(ids[queries], v[queries], 5)
    for part in np.array_split(np.arange(n), 7):
        if len(part):
            s.add(ids[part], v[part])
    want = _brute(ids, v, queries, 5)
    for k, q in enumerate(queries):
        have = [(int(i), int(x)) for i, x in zip(s.found[k], s.score[k]) if np.isfinite(x)]
        assert have == want[int(ids[q])]


def test_pruning_leaves_most_candidates_out():
    r = np.random.default_rng(5)
    v = np.floor(r.normal(0, 60, (20, 64))[r.integers(0, 20, 9000)] * 4 + r.normal(0, 20, (9000, 64)))
    s = tk.Search(np.arange(50), v[:50], 5)
    s.add(np.arange(9000), v)
    assert np.isfinite(s.score).all()


def test_rows_without_part(spark):
    rows = [(0, [1.0, 2.0], "x"), (50, [1.0, None], "x"), (1, [0.5, 0.25], "y"), (1, [0.5, 0.25], "y"), (2, None, "z"), (3, [float("nan"), 1.0], "z"),
            (4, [float("inf"), 1.0], "z"), (None, [1.0, 1.0], "z"), (5, [1.0, 2.0, 3.0], "z"), (100, [], "z"), (6, [-1.0, 0.0], "w")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in tk.query(df).collect())
    near = int(np.floor(256 * 0.5) * 256 + np.floor(256 * 0.25) * 512)
    assert got == [(0, 1, 1, near), (0, 2, 1, near), (0, 3, 6, -65536)]
    assert tk.query(df.limit(0)).count() == 0


def test_query_blocks(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(400)], "vec_id long, embedding array<double>")
    ask = df.filter("vec_id % 3 = 0")
    one, many = tk.top_k(df, ask, 4), tk.top_k(df, ask, 4, query_block=20)
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(one) == key(many) and one.count() == 134 * 4
