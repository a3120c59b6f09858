"""Exact top-k by inner product: columnar branch and bound.

Vectors are quantised to integers (``floor(256 * x)``).  A task lays its
candidates out by dimension, accumulates the products block of dimensions by
block, and after each block drops the candidates that cannot reach a query's
k-th best score any more: what the remaining dimensions can add is bounded by
the product of the remaining masses (Cauchy-Schwarz on the suffixes).  Once few
are left, only the surviving (query, candidate) pairs are carried on.  Scores
of survivors are complete, so the result is exact.

Distribution: the stated queries go out in blocks of at most ``QUERY_BLOCK``
vectors, each block as one broadcast of bounded size; candidates are scanned
where they lie.  A task returns its best k per query; a window that keeps k per
query merges them.

Rows with a null id or vector, or with a null or non-finite component, take no
part.  Vectors of another length than a query's have no score with it.  Repeated
query rows are asked once; repeated candidates each take a rank.  Empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

SCALE = 256
EVERY = 50
TOP = 5
QUERY_BLOCK = 16_384
_QUERIES_AT_ONCE, _FIRST, _CANDIDATES_AT_ONCE, _DIMS_AT_ONCE = 256, 512, 8192, 16


def quantised(column: pa.Array, ids: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors of an Arrow column by their length: (ids, integers as float64)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
    lengths[np.asarray(ids.is_null())] = -1
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        good = np.isfinite(flat).all(1)
        out[n] = (np.asarray(ids.take(pa.array(at[good]))).astype(np.int64), np.floor(SCALE * flat[good]))
    return out


def _suffix_mass(x: np.ndarray, edges: list[int]) -> np.ndarray:
    """Norms of the components from each edge on, rounded up; one row per edge."""
    return np.stack([np.sqrt((x[:, e:].astype(np.float64) ** 2).sum(1)) * (1 + 1e-9) for e in edges])


class Search:
    """The k best of the candidates seen so far, for queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: int):
        self.ids, self.top = ids, top
        # dimensions with much mass first: their sums separate candidates early
        self.order = np.argsort(-(vectors ** 2).sum(0), kind="stable")
        self.vectors = vectors[:, self.order]
        d = vectors.shape[1]
        self.edges = [*range(0, d, _DIMS_AT_ONCE), d]
        self.rest = _suffix_mass(self.vectors, self.edges[1:])
        self.score = np.full((len(ids), top), -np.inf)
        self.found = np.full((len(ids), top), np.iinfo(np.int64).max)
        self.peak = np.abs(vectors).max(initial=0)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        d = vectors.shape[1]
        most = d * self.peak * np.abs(vectors).max(initial=0)
        if most >= 2.0 ** 53:
            raise ValueError("inner products beyond 2 ** 53 are not exact")
        kind = np.float32 if most < 2 ** 24 else np.float64  # integers are exact in both
        at = 0
        while at < len(ids):
            # the first few set a bar for the others
            size = _CANDIDATES_AT_ONCE if np.isfinite(self.score[:, -1]).all() else _FIRST
            part = vectors[at:at + size][:, self.order]
            columns = np.ascontiguousarray(part.T.astype(kind))  # a row for each dimension
            rest = _suffix_mass(part, self.edges[1:])
            for q in range(0, len(self.ids), _QUERIES_AT_ONCE):
                self._block(slice(q, q + _QUERIES_AT_ONCE), kind, ids[at:at + size], columns, rest)
            at += size

    def _block(self, rows: slice, kind, ids, columns, rest) -> None:
        queries, bar = self.vectors[rows].astype(kind), self.score[rows, -1]
        alive, partial = np.arange(len(ids)), np.zeros((len(queries), len(ids)), kind)
        pairs = None
        for b, (lo, hi) in enumerate(zip(self.edges, self.edges[1:])):
            if pairs is None:
                partial += queries[:, lo:hi] @ columns[lo:hi, alive]
                if not np.isfinite(bar).any():
                    continue
                may = partial + self.rest[b][rows][:, None] * rest[b][alive] >= bar[:, None]
                if may.mean() < 0.05:
                    i, j = np.nonzero(may)
                    pairs = i, alive[j], partial[i, j].astype(np.float64)
                elif (some := may.any(0)).mean() < 0.7:
                    alive, partial = alive[some], partial[:, some]
            else:
                i, j, s = pairs
                s = s + (queries[i, lo:hi] * columns[lo:hi, j].T).sum(1)
                keep = s + self.rest[b, rows][i] * rest[b, j] >= bar[i]
                pairs = i[keep], j[keep], s[keep]
        if pairs is None:
            partial[ids[alive] == self.ids[rows][:, None]] = -np.inf
            if len(alive) > self.top:  # of this block's scores, only the best can count
                bar = np.maximum(bar, np.partition(partial, -self.top, axis=1)[:, -self.top])
            i, j = np.nonzero((partial >= bar[:, None]) & np.isfinite(partial))
            pairs = i, alive[j], partial[i, j].astype(np.float64)
        i, j, s = pairs
        own = ids[j] == self.ids[rows][i]
        self._merge(rows, i[~own], ids[j[~own]], s[~own])

    def _merge(self, rows: slice, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(i):
            return
        n, k = self.score[rows].shape
        i = np.concatenate([np.repeat(np.arange(n), k), i])
        ids = np.concatenate([self.found[rows].ravel(), ids])
        scores = np.concatenate([self.score[rows].ravel(), scores])
        order = np.lexsort((ids, -scores, i))
        i, ids, scores = i[order], ids[order], scores[order]
        rank = np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i]
        best = rank < k
        self.score[rows], self.found[rows] = scores[best].reshape(n, k), ids[best].reshape(n, k)


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``top`` candidates of each query, ties to the smaller id.

    Both inputs have columns vec_id and embedding; a query never meets candidates with its own id.
    """
    spark = vectors.sparkSession
    candidates = vectors.select(F.col("vec_id").cast("long"), "embedding")
    queries = queries.select(F.col("vec_id").cast("long"), "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    blocks = max(1, math.ceil(queries.count() / query_block * 1.2))  # 1.2: hashing deals out unevenly
    schema = "query_id long, vec_id long, score long"
    parts = []
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        asked = {}
        for n, (ids, v) in quantised(own.column("embedding"), own.column("vec_id").combine_chunks()).items():
            ids, first = np.unique(ids, return_index=True)
            asked[n] = (ids, v[first])
        sent = spark.sparkContext.broadcast(asked)

        def run(batches, sent=sent):
            searches, held = {n: Search(ids, v, top) for n, (ids, v) in sent.value.items()}, {}
            for b in batches:
                for n, (ids, v) in quantised(b.column("embedding"), b.column("vec_id")).items():
                    if n in searches and len(ids):
                        held.setdefault(n, []).append((ids, v))
                        if sum(len(x) for x, _ in held[n]) >= _CANDIDATES_AT_ONCE:
                            searches[n].add(*(np.concatenate(x) for x in zip(*held.pop(n))))
            for n, kept in held.items():
                searches[n].add(*(np.concatenate(x) for x in zip(*kept)))
            for s in searches.values():
                i, j = np.nonzero(np.isfinite(s.score))
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[i]), pa.array(s.found[i, j]), pa.array(s.score[i, j].astype(np.int64))],
                                                 ["query_id", "vec_id", "score"])

        parts.append(map_arrow(candidates, run, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


def oracle_sql() -> str:
    return f"""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
          FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP}"""
