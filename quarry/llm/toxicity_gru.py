"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Input per word: an embedding of the word and the summed embeddings of its
character 3- to 5-grams (with word ends), both hashed.  Two GRUs read a window
forwards and backwards, attention pools their states, a logistic unit scores
the window.  A document's score is that of its worst window, over all
overlapping windows (``WINDOW`` words, one every ``STRIDE``).

Training is in numpy on the driver, on a bounded sample: ``SAMPLE`` labelled
documents of each label and at most ``WINDOWS_PER_DOC`` windows of each.  Labels
belong to documents, so after a first round on all windows only the window that
scores highest stands for its document, with a random one of clean documents.

Scoring is one map over the documents, no shuffle.  The network is broadcast
(its size is fixed by the parameters); each worker keeps, per word met, the
word's contribution to the gates (bounded table), so a step costs a look-up and
one small product per window.

Null text counts as empty; an empty text has one window without words, whose
score is that of the bias.  Rows repeat as they come; other columns are ignored.
Without labels of both kinds the network stays untrained at the share of label
1 (0.5 when there are no labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fold_of, held, map_arrow, slices, text_bytes
from .labels import labelled_sample

FOLDS = 5  # documents of fold 0 are held out
SAMPLE = 1000  # labelled documents of each label
WINDOWS_PER_DOC = 40
WINDOW, STRIDE = 48, 24
BUCKETS = 1 << 13
WORD_DIMS, CHAR_DIMS, HIDDEN, ATTENTION = 8, 12, 8, 8
GRAMS = (3, 4, 5)
THRESHOLD = 0.5
MEMO_WORDS = 120_000
_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def word_inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, and character-gram buckets with the word number of each gram (in order)."""
    marked = [b"^" + w + b"$" for w in words]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word_of = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(flat))  # bytes from here to the word's end
    place = (np.arange(len(flat)) - np.repeat(starts, lengths) + 1).astype(np.uint64)
    whole = _hashed(np.add.reduceat(_hashed64(flat * _PRIMES[0] + place * _PRIMES[1]), starts)) if len(words) else np.zeros(0, np.int64)
    grams, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h += (flat[at + k] + np.uint64(1)) * _PRIMES[k]
        grams.append(_hashed(h))
        owners.append(word_of[at])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return whole, grams[order], owners[order]


def _hashed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_starts(n: int) -> range:
    """Starts of the windows that cover n words (one empty window for none)."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = WORD_DIMS + CHAR_DIMS, HIDDEN
        draw = lambda *shape, s=0.3: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"words": draw(BUCKETS, WORD_DIMS, s=0.1), "chars": draw(BUCKETS, CHAR_DIMS), "out": draw(2 * h), "bias": np.zeros(1, np.float32),
                  "att": draw(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION)}
        for k in "fb":
            self.p |= {f"W{k}": draw(d, 3 * h), f"U{k}": draw(h, 3 * h), f"b{k}": np.zeros(3 * h, np.float32)}

    def inputs(self, words: list[bytes]):
        """Input vectors of words, with what the way back needs."""
        whole, grams, owners = word_inputs(words)
        counts = np.sqrt(np.bincount(owners, minlength=len(words))).astype(np.float32)
        starts = np.searchsorted(owners, np.arange(len(words)))
        x = np.concatenate([self.p["words"][whole], np.add.reduceat(self.p["chars"][grams], starts) / counts[:, None]], 1)
        return x, (whole, grams, owners, counts)

    def gates(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        x, _ = self.inputs(words)
        return np.concatenate([x @ self.p[f"W{k}"] + self.p[f"b{k}"] for k in "fb"], 1)

    def forward(self, gates: np.ndarray, number: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. number: word numbers (windows x WINDOW), mask: 1 where there is a word."""
        p, h3, (n, steps) = self.p, 3 * HIDDEN, number.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        saved = []
        for k, part, times in (("f", slice(0, HIDDEN), range(steps)), ("b", slice(HIDDEN, 2 * HIDDEN), range(steps - 1, -1, -1))):
            own = np.ascontiguousarray(gates[:, :h3] if k == "f" else gates[:, h3:])
            h = np.zeros((n, HIDDEN), np.float32)
            for t in times:
                g, u = own[number[:, t]], h @ p[f"U{k}"]
                zr = _sigmoid(g[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
                if keep:
                    saved.append((k, t, h, z, r, new, u[:, 2 * HIDDEN:]))
                h = (new + z * (h - new)) * mask[:, t, None]
                states[t, :, part] = h
        hidden = np.tanh(states @ p["att"] + p["att_b"])
        raw = hidden @ p["att_v"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(raw - raw.max(0)) * mask.T
        weight = weight / np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        logits = pooled @ p["out"] + p["bias"][0]
        return (logits, (states, hidden, weight, pooled, saved)) if keep else logits

    def gradients(self, words, number, mask, labels, scale) -> dict:
        p, g = self.p, {}
        x, (whole, grams, owners, counts) = self.inputs(words)
        gates = np.concatenate([x @ p[f"W{k}"] + p[f"b{k}"] for k in "fb"], 1)
        logits, (states, hidden, weight, pooled, saved) = self.forward(gates, number, mask, keep=True)
        d = ((_sigmoid(logits) - labels) * scale / len(labels)).astype(np.float32)
        g["bias"], g["out"] = np.array([d.sum()]), d @ pooled
        d_pooled = d[:, None] * p["out"]
        d_weight = np.einsum("nd,tnd->tn", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_raw = weight * (d_weight - (weight * d_weight).sum(0))
        g["att_v"] = np.einsum("tn,tna->a", d_raw, hidden)
        d_hidden = d_raw[:, :, None] * p["att_v"] * (1 - hidden ** 2)
        g["att"], g["att_b"] = np.einsum("tnd,tna->da", states, d_hidden), d_hidden.sum((0, 1))
        d_states += d_hidden @ p["att"].T
        d_gates = np.zeros_like(gates)
        for k, part, cols in (("f", slice(0, HIDDEN), slice(0, 3 * HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN), slice(3 * HIDDEN, 6 * HIDDEN))):
            g[f"U{k}"] = np.zeros_like(p[f"U{k}"])
            dh = np.zeros((len(labels), HIDDEN), np.float32)
            of_words = d_gates[:, cols]
            for kind, t, h, z, r, new, un in reversed(saved):
                if kind != k:
                    continue
                dh = (dh + d_states[t][:, part]) * mask[:, t, None]
                d_new = dh * (1 - z) * (1 - new ** 2)
                d_z, d_r = dh * (h - new) * z * (1 - z), d_new * un * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r], 1)
                np.add.at(of_words, number[:, t], np.concatenate([d_z, d_r, d_new], 1))
                g[f"U{k}"] += h.T @ d_u
                dh = dh * z + d_u @ p[f"U{k}"].T
            d_gates[:, cols] = of_words
        d_x = np.zeros_like(x)
        for k, cols in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, 6 * HIDDEN))):
            g[f"W{k}"], g[f"b{k}"] = x.T @ d_gates[:, cols], d_gates[:, cols].sum(0)
            d_x += d_gates[:, cols] @ p[f"W{k}"].T
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], whole, d_x[:, :WORD_DIMS])
        np.add.at(g["chars"], grams, (d_x[:, WORD_DIMS:] / counts[:, None])[owners])
        return g


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, net: Network, rate: float = 0.01):
        self.net, self.rate, self.steps = net, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, words, number, mask, labels, scale) -> None:
        self.steps += 1
        for k, g in self.net.gradients(words, number, mask, labels, scale).items():
            m, s = self.mean[k], self.square[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.net.p[k] -= self.rate * (m / (1 - 0.9 ** self.steps)) / (np.sqrt(s / (1 - 0.999 ** self.steps)) + 1e-8)


def _windows_of(words: list[bytes]) -> list[list[bytes]]:
    starts = list(window_starts(len(words)))
    if len(starts) > WINDOWS_PER_DOC:  # evenly over the document
        starts = [starts[i * len(starts) // WINDOWS_PER_DOC] for i in range(WINDOWS_PER_DOC)]
    return [words[s:s + WINDOW] for s in starts]


def _sample_windows(sample: DataFrame) -> list[tuple[int, list[bytes]]]:
    """(label, windows as blank-separated words) of the sample documents, cut on the executors."""

    def run(batches):
        for b in slices(batches):
            cut = [[b" ".join(w) for w in _windows_of(t.lower().split())] for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("label"), pa.array(cut, pa.list_(pa.binary()))],
                                             ["id", "label", "windows"])

    rows = map_arrow(sample.select("doc_id", "label", "text"), run, "id string, label int, windows array<binary>").collect()
    return [(r.label, [bytes(w) for w in r.windows]) for r in sorted(rows, key=lambda r: (r.label, r.id))]


def _matrix(windows: list[bytes], index: dict) -> tuple[np.ndarray, np.ndarray]:
    number = np.zeros((len(windows), WINDOW), np.int32)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for i, text in enumerate(windows):
        w = text.split()
        number[i, :len(w)] = [index[x] for x in w]
        mask[i, :len(w)] = 1
    return number, mask


def train(sample: list[tuple[int, list[bytes]]], rounds: int = 6, batch: int = 256, first: int = 6000) -> Network:
    """Fit a network to (label, windows) of documents."""
    net, rng = Network(), np.random.default_rng(5)
    labels = np.array([x for x, _ in sample], np.float32)
    if not len(labels) or labels.min() == labels.max():
        share = labels.mean() if len(labels) else 0.5
        net.p["bias"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
        net.p["out"][:] = 0
        return net
    windows = [w for _, ws in sample for w in ws]
    doc = np.repeat(np.arange(len(sample)), [len(ws) for _, ws in sample])
    vocabulary = sorted({x for w in windows for x in w.split()})
    number, mask = _matrix(windows, {w: i for i, w in enumerate(vocabulary)})
    trainer = Trainer(net)
    for k in range(rounds):
        if k == 0:
            chosen = rng.permutation(len(windows))[:first]
        else:
            logits = predict(net, net.gates(vocabulary) if vocabulary else np.zeros((1, 6 * HIDDEN), np.float32), number, mask)
            order = np.lexsort((logits, doc))
            top = order[np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)]  # the last of each document
            clean = np.flatnonzero(labels[doc] == 0)
            chosen = rng.permutation(np.concatenate([top, rng.choice(clean, min(len(clean), len(top) // 2), replace=False)]))
            while len(chosen) < 16 * batch and len(chosen) < 8 * len(top):  # few documents: more steps
                chosen = np.concatenate([chosen, rng.permutation(chosen)])
        for at in range(0, len(chosen), batch):
            rows = chosen[at:at + batch]
            used, local = np.unique(number[rows], return_inverse=True)
            own = [vocabulary[i] for i in used] if vocabulary else []
            if own:
                y = labels[doc[rows]]
                trainer.step(own, local.reshape(len(rows), WINDOW), mask[rows], y, 1.0)
    return net


def predict(net: Network, gates: np.ndarray, number: np.ndarray, mask: np.ndarray, at_once: int = 2048) -> np.ndarray:
    out = np.empty(len(number), np.float32)
    for at in range(0, len(number), at_once):
        out[at:at + at_once] = net.forward(gates, number[at:at + at_once], mask[at:at + at_once])
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE) -> Network:
    return train(_sample_windows(labelled_sample(docs, labels, label_col, sample, FOLDS)))


def _scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Each text's highest window score."""
    known = held(("gru", id(net)), lambda: Words(MEMO_WORDS, 6 * HIDDEN, net.gates))  # holds on to the network
    split = [t.lower().split() for t in texts]
    numbers = known.numbers([w for ws in split for w in ws])
    lengths = np.array([len(ws) for ws in split])
    counts = np.array([len(window_starts(n)) for n in lengths])
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    start = (np.arange(len(doc)) - first[doc]) * STRIDE  # in the document
    place = start[:, None] + np.arange(WINDOW)
    mask = place < lengths[doc][:, None]
    offset = np.cumsum(lengths) - lengths
    at = np.where(mask, place + offset[doc][:, None], 0)
    number = numbers[at] if len(numbers) else np.zeros_like(at)
    logits = predict(net, known.table, number, mask.astype(np.float32))
    return _sigmoid(np.maximum.reduceat(logits.astype(np.float64), first))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in slices(batches, 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(sent.value, text_bytes(b.column("text"))), pa.float64())],
                                             ["doc_id", "score"])

    x = docs.select("doc_id", "text")
    return map_arrow(x, run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_stage(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""
    net = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.schema

    def run(batches):
        for b in slices(batches, 1 << 20):
            yield b.filter(pa.array(_scores(sent.value, text_bytes(b.column("text"))) < threshold))

    return map_arrow(docs, run, schema)
