"""MinHash dedup and connected components against brute force."""

import random

import pytest

from quarry.llm import minhash_dedup as mh
from quarry.llm.components import components


def _brute(rows, threshold, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def _corpus(seed):
    """Groups of copies with growing numbers of edits, short texts, copies and empty texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    rows, i = [], 0
    for size in (40, 25, 3, 2, 1, 1, 1):
        base = [word() for _ in range(r.randint(60, 160))]
        for k in range(size):
            text = list(base)
            for _ in range(r.randint(0, 8)):
                at = r.randrange(len(text))
                what = r.random()
                if what < 0.5:
                    text[at] = word()
                elif what < 0.75:
                    del text[at]
                else:
                    text.insert(at, word())
            rows.append((i, r.choice([" ", "\n", "  "]).join(text).upper() if k % 3 == 0 else " ".join(text)))
            i += 1
    rows += [(i, "one two"), (i + 1, "ONE  two"), (i + 2, "one"), (i + 3, None), (i + 4, ""), (i + 5, " \n"), (i + 6, rows[0][1]), (i + 7, "two one"),
             (i + 8, "é É"), (i + 9, "é é"), (i + 10, "x y z " * 5000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,threshold,width", [(1, 85, 3), (2, 80, 5)])
def test_near_duplicates_match_brute_force(spark, seed, threshold, width):
    rows = _corpus(seed)
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, node int, digest string")
    got = sorted(tuple(r) for r in mh.near_duplicates(df, threshold, width=width).collect())
    assert got == _brute(rows, threshold, width)


def test_edit_keys_meet_every_link():
    """Whatever is linked without a link to the hub shares a key."""
    import numpy as np
    r = random.Random(3)
    for _ in range(30):
        hub = np.array(sorted(r.sample(range(10_000), 120)), np.uint64)
        sets = []
        for _ in range(25):
            keep = [x for x in hub.tolist() if r.random() > r.random() * 0.25]
            sets.append(np.array(sorted({*keep, *r.sample(range(10_000, 10_060), r.randint(0, 18))}), np.uint64))
        to_hub = [mh._linked(x, hub, 85) for x in sets]
        keys = [mh.edit_keys(x, hub, 85, l) for x, l in zip(sets, to_hub)]
        for a in range(len(sets)):
            for b in range(len(sets)):
                if a != b and not to_hub[a] and mh._linked(sets[a], sets[b], 85):
                    flipped = {(t, p, o) for t, o, p in keys[b]}
                    assert flipped & set(keys[a])


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert mh.query(empty).count() == 0
    rows = [(5, "a b c d e f g", "x"), (5, "a b c d e f g", "x"), (6, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (None, "p q r", "z"), (7, None, "z")]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in mh.query(df).collect())
    assert got == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (6, 5, False), (7, 7, True)]
    kept = mh.filter_stage(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "a b c d e f g"), (0, "p q r"), (5, "a b c d e f g"), (7, "")]


def test_components_match_union_find(spark):
    r = random.Random(9)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2000, 2300)]
    edges += [(5, 5), (1, 2), (2, 1)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {x.node: x.component for x in components(df).collect()}
    assert got == {n: find(n) for n in list(root)}
    assert components(df.limit(0)).count() == 0


def test_families_around_a_foreign_hub_are_not_paired(spark, monkeypatch):
    """Two families that share most of a text: the smaller one is not joined pair by pair."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    common = [word() for _ in range(240)]
    rows = []
    for family, size in ((0, 180), (1, 60)):
        own = [word() for _ in range(45)]
        for _ in range(size):
            text = common + own
            text[r.randrange(240)] = word()
            rows.append((len(rows), " ".join(text)))
    pairs, confirm = [], mh._confirmed

    def counted(docs, candidates, *more):
        pairs.append(candidates.count())
        return confirm(docs, candidates, *more)

    monkeypatch.setattr(mh, "_confirmed", counted)
    got = sorted(tuple(x) for x in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == _brute(rows, 85, 3)
    assert len({c for *_, c, _ in got}) == 2
    assert pairs[0] <= len(rows) and sum(pairs[1:]) <= 2 * len(rows)


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Texts that share much with each other, too little for a link, and more than with their hub are not joined pair by pair."""
    r = random.Random(6)
    words = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    first, second = words(200), words(40)
    rows = [(i, " ".join(first + (second if i >= 120 else []) + words(40))) for i in range(180)]
    pairs, compare = [], mh._similar_signatures

    def counted(candidates, *more):
        pairs.append(candidates.count())
        return compare(candidates, *more)

    monkeypatch.setattr(mh, "_similar_signatures", counted)
    got = sorted(tuple(x) for x in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == _brute(rows, 85, 3)
    assert pairs[0] <= len(rows) and sum(pairs[1:]) <= len(rows)


def test_rare_keys_meet_every_link(spark):
    """Sets of different parts that are linked share a key, with the size classes exchanged."""
    import numpy as np
    r = random.Random(5)
    base, rows = range(120), []
    for i in range(120):
        keep = [x for x in base if r.random() > r.random() * 0.3]
        s = sorted({*keep, *r.sample(range(120, 170), r.randint(0, 20))})[:r.choice([1, 2, 5, 200, 200, 200, 200, 200])]
        rows.append((i, i, i // 2, len(s), s))
    keys = mh.rare_keys(spark.createDataFrame(rows, "_r long, node long, part long, size long, shingles array<long>"), 80).collect()
    at = {}
    for k in keys:
        at.setdefault((k.shingle, k.own, k.partner), set()).add(k.node)
    met = {(a, b) for (t, o, p), nodes in at.items() for a in nodes for b in at.get((t, p, o), ())}
    links = {(a, b) for a, _, pa, _, x in rows for b, _, pb, _, y in rows if pa != pb and mh._linked(np.array(x), np.array(y), 80)}
    assert len(links) > 200 and links <= met
