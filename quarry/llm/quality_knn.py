"""Quality by nearest-neighbour voting in a latent-semantic space.

Fit: a bounded sample of labelled documents (``SAMPLE`` of each label, those
with the smallest id hashes) is hashed to term features on the executors; the
driver weighs them by inverse document frequency and factors the matrix (SVD),
which gives ``DIMS`` latent axes.  Terms are the words, their endings and their
shapes (case, symbols, digits), and marks for words that repeat the word before
them and for lines that repeat an earlier line.

Score: the projection and the sample's latent vectors (sizes fixed by the
parameters) are broadcast; every document is projected, its exact cosines with
all sample vectors come from blocked matrix products, and the ``NEIGHBOURS``
nearest vote with their similarity.  The score is label 1's share of the vote.

One map over the documents, no shuffle.  Null text counts as empty; a text
without words scores the share of label 1 in the sample.  Rows repeat as they
come; other columns are ignored.  Without labels of both kinds the score is
that share, or 0.5 when there are none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fold_of, held, map_arrow, slices, text_bytes
from .labels import labelled_sample

FOLDS = 5  # documents of fold 0 are held out
SAMPLE = 1500  # labelled documents of each label
FEATURES = 1 << 13
DIMS = 48
NEIGHBOURS = 15
POWER = 4  # of the similarity, in the vote
THRESHOLD = 0.3
MEMO_WORDS = 200_000
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")


def _bucket(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + value) % FEATURES


REPEAT, DUP_LINE = _bucket(b"mark", b"repeat"), _bucket(b"mark", b"line")


def word_features(word: bytes) -> tuple[int, int, int]:
    """Buckets of a word, its ending and its shape."""
    shape = _DIGITS.sub(b"0", _CAPITALS.sub(b"A", _LETTERS.sub(b"a", word)))[:24]
    return _bucket(b"word", word.lower()), _bucket(b"end", word[-3:]), _bucket(b"shape", shape)


def _marks(text: bytes, words: list[bytes]) -> tuple[int, int]:
    """Words equal to the word before; words in lines equal to an earlier line."""
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    doubled = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                doubled += len(line.split())
            seen.add(line)
    return repeats, doubled


def _term_counts(docs: DataFrame) -> DataFrame:
    """label and the sparse feature counts of sample documents, as binary index and count arrays."""

    def run(batches):
        for b in slices(batches):
            index, counts = [], []
            for t in text_bytes(b.column("text")):
                words = t.split()
                repeats, doubled = _marks(t, words)
                flat = [f for w in words for f in word_features(w)] + [REPEAT] * repeats + [DUP_LINE] * doubled
                i, n = np.unique(np.array(flat, np.int32), return_counts=True)
                index.append(i.tobytes())
                counts.append(n.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(index, pa.binary()), pa.array(counts, pa.binary())], ["label", "i", "n"])

    return map_arrow(docs.select("label", "text"), run, "label int, i binary, n binary")


class Model:
    """Latent axes per feature, and the sample's unit vectors with their labels."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], dims: int = DIMS):
        self.labels = np.array([r[0] for r in rows], np.float32)
        self.prior = float(self.labels.mean()) if len(rows) else 0.5
        m = np.zeros((len(rows), FEATURES), np.float32)
        for k, (_, i, n) in enumerate(rows):
            m[k, np.frombuffer(i, np.int32)] = np.frombuffer(n, np.float32)
        idf = np.log((1 + len(rows)) / (1 + (m > 0).sum(0))).astype(np.float32) + 0.1
        m *= idf
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        axes = self._axes(m, min(dims, *m.shape)) if len(rows) else np.zeros((FEATURES, 1), np.float32)
        self.weights = (idf[:, None] * axes).astype(np.float32)
        self.vectors = self.unit(m @ axes)

    @staticmethod
    def _axes(m: np.ndarray, dims: int) -> np.ndarray:
        """Leading right singular vectors, by subspace iteration from a fixed start."""
        q = np.random.default_rng(7).standard_normal((m.shape[1], dims + 8)).astype(np.float32)
        for _ in range(6):
            q, _ = np.linalg.qr(m.T @ (m @ q))
        _, s, v = np.linalg.svd(m @ q, full_matrices=False)
        return (q @ v.T)[:, :dims] if dims else q

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def votes(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Label 1's share of the similarity-weighted vote of the nearest sample documents."""
        if not len(self.labels):
            return np.full(len(vectors), self.prior)
        out = np.empty(len(vectors))
        for at in range(0, len(vectors), 512):
            cosine = self.unit(vectors[at:at + 512]) @ self.vectors.T
            k = min(neighbours, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(np.float64) ** POWER
            total = weight.sum(1)
            out[at:at + 512] = np.where(total > 1e-12, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12), self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    rows = _term_counts(labelled_sample(docs, labels, label_col, sample, FOLDS)).collect()  # at most 2 * sample, FEATURES entries each
    return Model(sorted((r.label, bytes(r.i), bytes(r.n)) for r in rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value

        def rows(words):
            f = np.array([word_features(w) for w in words])
            return m.weights[f[:, 0]] + m.weights[f[:, 1]] + m.weights[f[:, 2]]

        # word vectors live as long as the model, which ``rows`` holds on to
        known = held(("knn", id(m)), lambda: Words(MEMO_WORDS, m.weights.shape[1], rows))
        for b in slices(batches, 2 << 20):
            texts = text_bytes(b.column("text"))
            split = [t.split() for t in texts]
            numbers = known.numbers([w for ws in split for w in ws])
            vectors, at = np.zeros((len(texts), m.weights.shape[1]), np.float32), 0
            for k, (t, ws) in enumerate(zip(texts, split)):
                if ws:
                    kinds, n = np.unique(numbers[at:at + len(ws)], return_counts=True)
                    repeats, doubled = _marks(t, ws)
                    vectors[k] = n.astype(np.float32) @ known.table[kinds] + repeats * m.weights[REPEAT] + doubled * m.weights[DUP_LINE]
                    at += len(ws)
            scores = np.where([bool(ws) for ws in split], m.votes(vectors), m.prior)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    x = docs.select("doc_id", "text")
    return map_arrow(x, run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
