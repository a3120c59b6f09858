"""Merkle manifest: leaves, levels, proofs and tampering against hashlib."""

import hashlib
import string
import zlib

import pytest

from quarry.llm import merkle_manifest

SCHEMA = "source string, doc_id long, text string, lang string, n_chars long, pos int, `up.level` string"
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def _climb(levels, pos, h, proof):
    for level in levels[:-1]:
        run, o = level[pos // 8 * 8:pos // 8 * 8 + 8], pos % 8
        proof += run[:o] + run[o + 1:]
        h, pos = _h("".join(run[:o]) + h + "".join(run[o + 1:])), pos // 8
    return h


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[0]), _leaf(*r))) for g in langs}
    trees = {g: _tree([_leaf(*r) for r in groups[g]]) for g in langs}
    outer = _tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            h, proof = _leaf(*r[:4], r[4].translate(_LOWER)) if hit else _leaf(*r), []
            h = _climb(outer, k, _climb(trees[g], i, h, proof), proof)
            out.append((r[0], _leaf(*r), trees[g][-1][0], outer[-1][0], _h("".join(proof)), h, h == outer[-1][0]))
    return sorted(out, key=repr)


def _run(spark, rows, parts=5):
    data = [(s, i, t, g, n, 7, "x") for i, s, g, n, t in rows]
    docs = spark.createDataFrame(data, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in merkle_manifest.query(docs).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"s{i % 3}", "en", i, f"Text ÄÉ {i}\n" * (i % 5)) for i in range(150)]
    out += [(1000 + i, None, ["de", "fr", "", "é", "z"][i % 5], None, "Ab" * i) for i in range(43)]
    out += [(7, "s", None, 1, None), (None, "s", None, 1, "Null Id"), (5000, "s", "alone", 0, "")]
    out += [(5001, "s", "it", 3, "REPEATED")] * 20 + [(5002, "s", "it", 3, "Long " * 200_000)]
    return out


def test_matches_hashlib(spark, rows):
    assert _run(spark, rows) == brute(rows)


def test_levels_by_shuffle_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "BROADCAST_NODES", 4)
    assert _run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 9, 65])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", i, "Some Text") for i in range(n)]
    assert _run(spark, rows, 2) == brute(rows)


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 90:03d}", i, "Some Text") for i in range(200)]
    assert _run(spark, rows) == brute(rows)


def test_tampering_shows(spark, rows):
    got = _run(spark, rows)
    changed = [r for r in got if r[5] != r[3]]
    assert changed and all(not r[6] for r in changed) and all(r[6] for r in got if r[5] == r[3])


def test_the_limit_on_recursive_rows_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    _run(spark, [(1, "s", "en", 1, "a")], 1)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
