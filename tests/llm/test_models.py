"""Learned operators: held-out accuracy, gradients, exact base scores, odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from quarry.llm import lm_mixing as lm
from quarry.llm import quality_knn as knn
from quarry.llm import toxicity_gru as gru
from quarry.llm.labels import labelled_sample

ODD = [(1, "Some Words here.\nAnd more", "c"), (2, None, "c"), (3, "", "c"), (None, "null id", "c"), (1, "Some Words here.\nAnd more", "c"),
       (5, "long " * 30_000, "c"), (6, "\x00 é日😀 \t\n", "c")]


def _docs(spark, extra=()):
    return spark.createDataFrame([*ODD, *extra], "doc_id long, text string, label string")


def _corpus(n, seed=4):
    """Documents whose label 1 (toxic) ones hold words of a stem with changing ends."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "ti", "or", "es", "lu", "ma"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(100, 100 + n):
        words = [word() for _ in range(r.randint(5, 150))]
        toxic = int(i % 3 == 0)
        for _ in range(toxic * r.randint(2, 5)):
            words.insert(r.randrange(len(words)), "zork" + word())
        bad = int(i % 4 == 0)
        if bad:
            words = [w + "###" for w in words]
        docs.append((i, " ".join(words), "c"))
        labels.append((i, 1 - bad, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def corpus(spark):
    docs, labels = _corpus(600)
    return _docs(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _held_out(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    pick = [r for r in rows if r.held_out and r.doc_id in truth]
    assert pick and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in pick)
    return sum(r.predicted == truth[r.doc_id] for r in pick) / len(pick)


def test_toxicity(corpus, spark):
    docs, labels = corpus
    rows = gru.query(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert _held_out(rows, labels, "toxic") > 0.93
    kept = gru.filter_stage(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in rows)
    none = gru.query(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert gru.query(docs.limit(0), labels).count() == 0


def test_quality(corpus):
    docs, labels = corpus
    rows = knn.query(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert _held_out(rows, labels, "quality") > 0.95
    assert {r.score for r in knn.query(docs, labels.limit(0)).collect()} == {0.5}
    assert knn.query(docs.limit(0), labels).count() == 0


def test_votes_are_exact_nearest_neighbours():
    r = np.random.default_rng(0)
    m = knn.Model([(int(i % 2), np.unique(r.integers(0, knn.FEATURES, 30)).astype(np.int32).tobytes(), b"") for i in range(0)])
    m.labels, m.vectors, m.prior = r.integers(0, 2, 900).astype(np.float32), knn.Model.unit(r.normal(size=(900, 12))), 0.5
    x = r.normal(size=(1100, 12)).astype(np.float32)
    cosine = knn.Model.unit(x) @ m.vectors.T
    near = np.argsort(-cosine, axis=1)[:, :knn.NEIGHBOURS]
    w = np.clip(np.take_along_axis(cosine, near, 1), 0, 1) ** knn.POWER
    assert np.allclose(m.votes(x), (w * m.labels[near]).sum(1) / w.sum(1), atol=1e-6)


def test_network_gradients():
    net = gru.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [b"alpha", b"b", b"gamma!", b"d\xc3\xa9"]
    r = np.random.default_rng(2)
    number = r.integers(0, 4, (3, gru.WINDOW))
    mask = (np.arange(gru.WINDOW) < np.array([[gru.WINDOW], [5], [1]])).astype(np.float64)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(net.gates(words), number, mask).astype(np.float64)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    grads = net.gradients(words, number, mask, y, 1.0)
    for name, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        p, h = net.p[name], 1e-2
        keep = p[at]
        p[at] = keep + h
        up = loss()
        p[at] = keep - h
        down = loss()
        p[at] = keep
        assert math.isclose((up - down) / (2 * h), g[at], rel_tol=0.05, abs_tol=2e-4), name


def test_windows_cover_every_word():
    for n in range(0, 300):
        covered = {i for s in gru.window_starts(n) for i in range(s, min(n, s + gru.WINDOW))}
        assert covered == set(range(n))


def test_language_model(spark):
    docs, _ = _corpus(300)
    df = _docs(spark, docs)
    rows = lm.query(df).collect()
    tokens = collections.Counter()
    texts = [(r.doc_id, (r.text or "").encode().lower().split() + [b""]) for r in df.collect()]
    trains = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    for i, ws in texts:
        if trains(i):
            tokens.update(ws)
    n = sum(tokens.values())
    total = n + 0.1 * (len(tokens) + 1)
    want = collections.defaultdict(list)
    for i, ws in texts:
        want[i].append((not trains(i), len(ws), sum(w in tokens for w in ws), n, sum(math.log10((tokens[w] + 0.1) / total) for w in ws)))
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert len({(r.score) for r in rows if r.doc_id == 1}) == 1
    assert lm.query(df.limit(0)).count() == 0


def test_language_model_is_a_distribution():
    """The probabilities of all words, spelled or not, that the code can express in few bits add up to at most one."""
    words, counts = [b"the", b"", b"of", b"and"], [50, 30, 10, 10]
    code = lm.Code(words, counts, 20)
    for lo, hi in ((0, code.bytes_from), (code.bytes_from, len(code.offsets) - 1)):
        length = np.diff(code.offsets)[lo:hi]
        assert math.isclose((0.5 ** length).sum(), 1.0)  # Kraft: a complete prefix code
        paths = {tuple(code.bits[a:b]) for a, b in zip(code.offsets[lo:hi], code.offsets[lo + 1:hi + 1])}
        assert len(paths) == hi - lo
    r = random.Random(0)
    texts = [[r.choice([b"the", b"of", b"and", b"xyzzy", b"foo"]) for _ in range(40)] for _ in range(60)]
    m = lm.Mixer()
    first = last = 0
    for k in range(0, 60, 10):
        slots, bits, _, level, _, _ = lm._bits(code, texts[k:k + 10])
        p = m.predict(slots, level)[0]
        last = -np.log2(np.where(bits, p, 1 - p)).mean()
        first = first or last
        m.learn(slots, bits, level)
    assert last < first  # it learns as it goes


def test_language_model_keeps_four_predictors():
    """Four contexts: none, one word, two words, the word before last; spelled words by the last one to four bytes."""
    code = lm.Code([b"a", b"b", b"c", b""], [9, 8, 7, 6], 5)
    symbol, _, c, level, _, _ = code.stream([[b"a", b"b", b"c"], [b"c", b"b", b"c"], [b"a", b"c", b"c"], [b"xyzzyzz"]])
    assert len(c) == lm.PREDICTORS == 4
    third = [2, 6, 10]  # the third words: the same, the word before, and the word before last differ in turn
    same = lambda k, i, j: c[k][third[i]] == c[k][third[j]]
    assert same(0, 0, 1) and same(1, 0, 1) and not same(2, 0, 1) and not same(3, 0, 1)
    assert same(0, 0, 2) and not same(1, 0, 2) and not same(2, 0, 2) and same(3, 0, 2)
    spelled = c[:, level == 1]
    z = [3, 6]  # after xyz and xyzzyz: the same last two bytes
    assert [spelled[k][z[0]] == spelled[k][z[1]] for k in range(4)] == [True, True, False, False]


def _model_tables(spark, texts):
    """The code, the slices and their pairs' counts as score_documents builds them, for training texts."""
    words = [lm.tokens(t.encode()) + [lm.END] for t in texts]
    n = collections.Counter(w for ws in words for w in ws)
    known = sorted((w for w in n if n[w] >= lm.LEAST or w == lm.END), key=lambda w: (-n[w], w))
    code = lm.Code(known, [n[w] for w in known], sum(c for w, c in n.items() if w not in known))
    sent = spark.sparkContext.broadcast(code)
    ids = [i for i in range(1, 10 * len(texts)) if zlib.crc32(str(i).encode()) % 10]
    own = lm.sliced(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").coalesce(2), 10, 2_000)
    return code, sent, own, lm.pair_table(own, sent), sum(n.values())


def test_language_model_contexts_never_share_counts():
    """More contexts than any fixed table had slots: each keeps its own."""
    r = random.Random(1)
    vocabulary = [b"w%d" % i for i in range(20_000)]
    code = lm.Code([*vocabulary, b""], [9] * 20_001, 0)
    text = [r.choice(vocabulary) for _ in range(60_000)]
    slots, *_ = lm._bits(code, [text])
    number = [code.index[w] for w in (*text, b"")]
    want = {(a, b, x) for a, b, w in zip([-1, -1, *number], [-1, *number], number) for x in code.nodes[code.offsets[w]:code.offsets[w + 1]].tolist()}
    assert len(np.unique(slots[2])) == len(want) > 1 << 19


def test_language_model_counts_of_the_corpus(spark):
    """Each slice gets, for each of its pairs, the counts along the path over the whole corpus."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "b", "c", "dd", f"rare{r.randrange(40)}"]) for _ in range(r.randrange(90))) for _ in range(80)]
    code, sent, own, table, _ = _model_tables(spark, texts)
    symbol, _, contexts, *_ = code.stream([lm.tokens(t.encode()) for t in texts])
    pairs = collections.Counter((contexts << lm.SYMBOL | symbol).ravel().tolist())
    at = collections.Counter()  # what came to each node in each context
    path = lambda p: code.nodes[code.offsets[p & 0x7FFFF]:code.offsets[(p & 0x7FFFF) + 1]].tolist()
    for p, n in pairs.items():
        for x in path(p):
            at[p >> lm.SYMBOL, x] += n
    rows = table.collect()
    assert {x.pair for x in rows} == set(pairs) and len({x._s for x in rows}) > 5
    for x in rows:
        assert np.frombuffer(x.counts, np.int32).tolist() == [at[x.pair >> lm.SYMBOL, k] for k in path(x.pair)] + [pairs[x.pair]]


def test_language_model_learns_weights_in_small_steps(spark):
    """A few kilobytes of text move the weights and fill the map, by counts of other slices only."""
    r = random.Random(8)
    texts = [" ".join(f"w{(k + i) % 7} x{r.randrange(30)}" for k in range(60)) for i in range(120)]
    code, sent, own, table, n = _model_tables(spark, texts)
    m = lm.learn(lm.packed(own, table), sent, n)
    moved = np.abs(m.weights - lm.START).max(1)
    assert (moved > 0.05).sum() >= 3 and (m.seen.reshape(lm.GATES, lm.BINS, 2).sum((0, 2)) > 0).sum() > 6
    assert m.seen.sum() == sum(len(lm._bits(code, [lm.tokens(t.encode())])[1]) for t in texts)
    # texts of which nothing recurs elsewhere: their own counts must not make the longer contexts look known
    lone = [" ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(20) for _ in range(5)) + " q" * 900 for i in range(8)]
    code, sent, own, table, n = _model_tables(spark, [t.replace("q", chr(97 + i) * 3) for i, t in enumerate(lone)])
    m = lm.learn(lm.packed(own, table), sent, n)
    gates = m.seen.reshape(lm.LEVELS, lm.KNOWN, lm.KNOWN, -1).sum(-1)
    assert gates[0, 0, 0] > 0.9 * gates[0].sum()


def test_sample_has_one_row_for_an_id_that_repeats(spark):
    """A labelled id on very many rows is one sample row, whatever their order."""
    rows = [(1, f"text {i % 3}") for i in range(500)] + [(i, None if i == 7 else f"own {i}") for i in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, y int")
    got = [sorted(map(tuple, labelled_sample(d, marks, "y", 100, 5).collect())) for d in (df, df.orderBy("text"), df.repartition(7))]
    want = {i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5}
    assert 1 in want and got[0] == got[1] == got[2] and [r[0] for r in got[0]] == sorted(want)
