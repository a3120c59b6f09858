"""SentencePiece codec against the library, packing against plain tokenizing."""

import os
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm import sentencepiece_codec as spc
from quarry.llm.common import TOKENIZER_DIR

MODEL = os.path.join(TOKENIZER_DIR, spc.MODEL)
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = spc.codec(MODEL)
TOK = Tokenizer.from_file(os.path.join(TOKENIZER_DIR, packing.VOCABULARY))
TOK.encode_special_tokens = True
ENC = packing.encoder(os.path.join(TOKENIZER_DIR, packing.VOCABULARY))

HARD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "▁x", "x▁ y", "héllo\n\x00 x\t", "<s> </s> <unk> <0x41>", "ﬁ Ａ", "😀 \n\n  😀",
        "\n", "a\n", "\na", "a \nb", "a\n b", "don't we'll go", "　x y", "a" * 300, "ab " * 500, "\x1c!\x1d a",
        "<|endoftext|> x", "日本語 テキスト\r\n次", "é" * 200, "x́ ﻿q", " " * 100, "=" * 150 + "\n" * 7]


@pytest.mark.parametrize("text", HARD)
def test_codec_matches_library(text):
    check_codec(text)


def check_codec(text):
    ids, spans = CODEC.encode(text.encode())
    want = SP.encode(text, add_bos=True, add_eos=True)
    assert ids.tolist() == want
    assert CODEC.decode(ids).decode() == SP.decode(want)
    # spans are gapless, in order and end with the text
    src = text.encode()
    inner = spans[1:-1]
    assert (inner[1:, 0] == inner[:-1, 1]).all() and (inner[:, 0] <= inner[:, 1]).all()
    if len(inner):
        assert inner[0, 0] == 0 and inner[-1, 1] == len(src)


ALPHABET = st.text(st.sampled_from("ab tionhe \n\t▁.,é😀日'1  "), max_size=80)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ALPHABET, st.text(max_size=40)))
def test_codec_matches_library_on_any_text(text):
    check_codec(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ALPHABET, st.text(max_size=40)))
def test_packing_ids_match_tokenizer(text):
    ids = TOK.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENC.encode(text), "<u4").tolist() == ids


@pytest.mark.parametrize("text", HARD)
def test_packing_ids_hard(text):
    assert np.frombuffer(ENC.encode(text), "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_normalizer_with_charsmap():
    """A compiled map with 'ab' -> 'X', 'a' -> ' ' and longest match first."""
    m = CODEC.m
    norm = spc.Normalizer(m)
    keys = {b"ab": b"X", b"a": b" ", "é".encode(): b"e"}
    pool, place = b"", {}
    for k, v in keys.items():
        place[k] = len(pool)
        pool += v + b"\0"
    norm.pool = pool
    norm._longest = lambda text, at: max(((len(k), place[k]) for k in keys if text.startswith(k, at)), default=(0, 0))
    out, origin = norm.normalize("éabac".encode())
    assert out.decode() == "▁eX▁c"
    assert origin.tolist() == [0, 0, 0, 0, 2, 4, 4, 4, 5, 6]


def _trie(keys):
    """A double array (one node per 4096 slots, ample) for a few keys."""
    units = {0: 0}
    slots = [4096]

    def build(node, at):
        kids = {}
        for k, v in node.items():
            kids.setdefault(k[:1], {})[k[1:]] = v
        leaf = kids.pop(b"", {}).get(b"")
        base = slots[0] | at & 255
        slots[0] += 4096
        units[at] |= (at ^ base) >> 8 << 10 | 1 << 9 | (1 << 8 if leaf is not None else 0)
        if leaf is not None:
            units[base] = 1 << 31 | leaf
        for c, sub in kids.items():
            units[base ^ c[0]] = c[0]
            build(sub, base ^ c[0])

    build(keys, 0)
    out = np.zeros(max(units) + 1, "<u4")
    for i, u in units.items():
        out[i] = u
    return out


def test_compiled_trie_longest_match():
    n = spc.Normalizer(CODEC.m)
    n.units = _trie({b"ab": 7, b"a": 3, b"abcd": 9})
    assert n._longest(b"xabcx", 1) == (2, 7)
    assert n._longest(b"abcd", 0) == (4, 9)
    assert n._longest(b"b", 0) == (0, 0)
    assert n._longest(b"ac", 0) == (1, 3)


def test_lengths_are_binary_digits():
    assert packing.lengths_of(5000) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 5000, 37):
        got = packing.lengths_of(n)
        assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got)


def _odd(spark):
    return spark.createDataFrame([(1, "a b\nc", "x"), (1, "a b\nc", "x"), (None, None, "y"), (3, "", "z"), (4, "w " * 30000, "z")],
                                 "doc_id long, text string, ids string")


def test_encode_rows(spark):
    rows = spc.query(_odd(spark)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted(
        (i or 0, len(SP.encode(t or "", add_bos=True, add_eos=True))) for i, t, _ in _odd(spark).collect())
    back = spc.decode(spc.encode(_odd(spark))).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in back) == sorted((i or 0, t or "") for i, t, _ in _odd(spark).collect())
    assert spc.query(_odd(spark).limit(0)).count() == 0


def test_pack_rows(spark):
    rows = packing.query(_odd(spark)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset))
    ids = np.array(TOK.encode("w " * 30000, add_special_tokens=False).ids + [1], "<u4")
    assert sorted(by[4]) == [(s, n, zlib.crc32(ids[s:s + n].tobytes()), len(ids), 0) for s, n in
                             zip(np.cumsum([0] + packing.lengths_of(len(ids))[:-1]).tolist(), packing.lengths_of(len(ids)))]
    assert [x[:2] for x in by[3]] == [(0, 1)] and [x[:2] for x in by[None]] == [(0, 1)]
    assert len(by[1]) % 2 == 0
    assert packing.query(_odd(spark).limit(0)).count() == 0
