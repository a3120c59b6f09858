"""Ranked lexical search by the Best Position Algorithm.

Every item of a query table gets its best documents under an integer BM25-like
score: a term's weight times an impact of its count in the document and of the
document's length, summed over the item's terms, repeats included.

* **Impact lists.**  One pass over the documents writes an index, cut into segments
  of at most ``SEGMENT_DOCS`` documents and about ``SEGMENT_BYTES`` of text: rows
  (segment, term, documents, counts) for the terms that some item asks for, besides
  the length of every document.  Document frequencies, N and L are sums over the index.
* **Best positions.**  Each segment is one group.  Its lists are sorted by impact; an item
  reads all of its lists block by block.  A document seen in one list is looked up in all
  others (direct access through a document-ordered copy), which gives its whole score and
  marks its place in each list.  The best position of a list is the last one before which
  all are marked, often beyond what was read; unseen documents score at most the sum of the
  impacts there.  The search stops when that sum is strictly below the k-th best score, so ties stay whole.
* **Merge.**  Each segment sends an item's best k (ties by id); a grouped top-k over them is the result.

Items are taken in blocks of at most ``BLOCK_ITEMS`` rows and ``BLOCK_BYTES`` of text (or one
longer item), which pass through the driver one after the other; a block's result is written
and its broadcast released before the next.  Documents are never collected.  An index is a
written table, a segment a small group, so lost executors cost single tasks.

Defined results: null texts, and texts without a term, are neither documents nor queries; a null
doc_id ranks after others of equal score; rows that repeat are documents (items) of their own;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.topk import top_k

from .common import map_arrow, ship, slices, stored, text_bytes

TOP = 20
SEGMENT_DOCS, SEGMENT_BYTES = 8192, 16 << 20
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
_PIECE = 1 << 20  # bytes of a text that are split at a time
_RUN = 1024  # postings in an index row
_FIRST = 16  # positions read of each list in the first round; doubled each round

#: Terms are ASCII letters and digits and all characters beyond ASCII; A-Z lower-cased.
_TO_TERMS = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()
_LENGTHS = -1  # in place of a term: the documents' ids and lengths


def terms_of(text: bytes):
    """The terms of a UTF-8 text, in lists of bounded size."""
    text = text.translate(_TO_TERMS)
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= _PIECE else text.find(b" ", at + _PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def index(docs: DataFrame, vocabulary) -> DataFrame:
    """The written index of ``docs`` for a broadcast dictionary from term to number."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        terms = vocabulary.value
        find, part, made = terms.get, TaskContext.get().partitionId(), 0
        ids, lengths, postings, size = [], [], [], 0

        def rows(out_ids):
            name = f"{part}-{made}"
            t, d, c = (np.concatenate(x) for x in zip(*postings)) if postings else (np.zeros(0, np.int64),) * 3
            order = np.argsort(t, kind="stable")
            t, d, c = t[order], d[order], c[order]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
            # a term's postings in runs of bounded length
            cuts = np.unique(np.concatenate([np.arange(a, b, _RUN) for a, b in zip(starts, np.r_[starts[1:], len(t)])] or [starts]))
            own = np.arange(0, len(lengths), _RUN)
            offsets = lambda c, n: pa.array(np.r_[c, n], pa.int32())
            lists = lambda c, n, values: pa.ListArray.from_arrays(offsets(c, n), pa.array(values, pa.int32()))
            none = pa.ListArray.from_arrays(pa.array([0] * (len(cuts) + 1), pa.int32()), out_ids.slice(0, 0))
            own_lists = lists(own, len(lengths), lengths)
            columns = [pa.array([name] * (len(own) + len(cuts))),
                       pa.concat_arrays([pa.array([_LENGTHS] * len(own), pa.int32()), pa.array(t[cuts], pa.int32())]),
                       pa.concat_arrays([lists(own, len(lengths), np.arange(len(lengths))), lists(cuts, len(t), d)]),
                       pa.concat_arrays([own_lists, lists(cuts, len(t), c)]),
                       pa.concat_arrays([pa.ListArray.from_arrays(offsets(own, len(lengths)), out_ids), none])]
            return pa.RecordBatch.from_arrays(columns, ["segment", "term", "docs", "counts", "ids"])

        for batch in slices(batches, most=SEGMENT_BYTES // 4):
            column, texts = batch.column("doc_id"), text_bytes(batch.column("text"))
            for k, text in enumerate(texts):
                n, met = 0, Counter()
                for words in terms_of(text):
                    n += len(words)
                    met.update(words)
                if not n:
                    continue
                # the terms that some item asks for
                hits = [(i, c) for w, c in met.items() if (i := find(w)) is not None]
                if hits:
                    h = np.array(hits, np.int64)
                    postings.append((h[:, 0], np.full(len(h), len(lengths)), h[:, 1]))
                ids.append(column.slice(k, 1))
                lengths.append(n)
                size += len(text)
                if len(ids) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield rows(pa.concat_arrays(ids))
                    made += 1
                    ids, lengths, postings, size = [], [], [], 0
        if ids:
            yield rows(pa.concat_arrays(ids))

    return stored(map_arrow(docs.select("doc_id", "text"), run,
                            f"segment string, term int, docs array<int>, counts array<int>, ids array<{id_type}>"))


class Segment:
    """The impact lists of one segment, and the same postings by document."""

    def __init__(self, term, doc, count, lengths, n_docs: int, n_terms: int):
        top = int(lengths.max(initial=1))
        if 25 * top * n_docs < 2 ** 63:
            m = 75 + (25 * lengths * n_docs) // n_terms
        else:
            m = np.array([75 + 25 * x * n_docs // n_terms for x in lengths.tolist()], np.int64)
        impact = 1_000_000_000 * count // (1000 * count + 12 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.impact, self.doc, term = impact[order], doc[order], term[order]
        self.terms, self.start = np.unique(term, return_index=True)
        self.end = np.r_[self.start[1:], len(term)]
        self.list_of = np.repeat(np.arange(len(self.terms)), self.end - self.start)
        # direct access: places in the lists, by document
        self.place = np.argsort(self.doc, kind="stable")
        self.first = np.searchsorted(self.doc[self.place], np.arange(len(lengths) + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int):
        """(documents, scores) that hold the ``top`` best, all ties of the last included."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        lists, weights = at[here], weights[here]
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, length = self.start[lists], self.end[lists] - self.start[lists]
        own = np.r_[0, np.cumsum(length)]  # the item's lists laid end to end
        column = np.full(len(self.terms), -1)
        column[lists] = np.arange(len(lists))
        seen = np.zeros(own[-1], bool)
        best = np.zeros(len(lists), np.int64)  # so many positions from the start are all seen
        docs, scores, bar, step = [], [], 0, _FIRST
        while True:
            # sorted access: the next positions of every list
            take = np.minimum(step, length - best)
            k = np.repeat(np.arange(len(lists)), take)
            pos = best[k] + np.arange(len(k)) - np.repeat(np.cumsum(take) - take, take)
            new = np.unique(self.doc[(start[k] + pos)[~seen[own[k] + pos]]])
            if len(new):
                # direct accesses: all places of these documents
                size = self.first[new + 1] - self.first[new]
                edge = np.cumsum(size) - size
                place = self.place[np.repeat(self.first[new] - edge, size) + np.arange(size.sum())]
                c = column[self.list_of[place]]
                asked = c >= 0
                value = np.zeros(len(place), np.int64)
                value[asked] = weights[c[asked]] * self.impact[place[asked]]
                seen[own[c[asked]] + place[asked] - start[c[asked]]] = True
                docs.append(new)
                scores.append(np.add.reduceat(value, edge))
                bound = 0
                for i in np.flatnonzero(best < length).tolist():
                    rest = seen[own[i] + best[i]:own[i + 1]]
                    stop = int(rest.argmin())
                    best[i] += len(rest) if rest[stop] else stop
            unread = best < length
            # what a document not yet seen can reach
            bound = int((weights[unread] * self.impact[(start + best - 1)[unread]]).sum())
            if len(scores):
                every = np.concatenate(scores)
                docs, scores = [np.concatenate(docs)], [every]
                if len(every) >= top:
                    bar = int(np.partition(every, -top)[-top])
                    keep = every >= bar  # the bar only rises
                    docs, scores = [docs[0][keep]], [every[keep]]
            if not unread.any() or bound < bar:
                break
            step *= 2
        good = scores[0] > 0
        return docs[0][good], scores[0][good]


def _best(questions, n_docs: int, n_terms: int, top: int):
    """For a segment's rows: (q, doc_id, score) of each item's best ``top``."""
    def run(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("term")) == _LENGTHS
        flat = lambda name, rows: table.column(name).combine_chunks().take(pa.array(np.flatnonzero(rows))).flatten()
        place = np.asarray(flat("docs", own)).astype(np.int64)
        lengths = np.empty(len(place), np.int64)
        lengths[place] = np.asarray(flat("counts", own))
        ids = flat("ids", own).take(pa.array(np.argsort(place)))
        sizes = np.asarray(pa.compute.list_value_length(table.column("docs")))[~own]
        term = np.repeat(np.asarray(table.column("term"))[~own], sizes).astype(np.int64)
        segment = Segment(term, np.asarray(flat("docs", ~own)).astype(np.int64), np.asarray(flat("counts", ~own)).astype(np.int64),
                          lengths, n_docs, n_terms)
        out = [[], [], []]
        for q, (terms, weights) in enumerate(questions.value):
            docs, scores = segment.search(terms, weights, top)
            if len(docs):
                keys = ids.take(pa.array(docs))
                null = np.asarray(keys.is_null())
                rank = np.empty(len(keys), np.int64)
                rank[np.asarray(pa.compute.sort_indices(keys, null_placement="at_end"))] = np.arange(len(keys))
                pick = np.lexsort((rank, null, -scores))[:top]
                out[0].append(np.full(len(pick), q))
                out[1].append(keys.take(pa.array(pick)))
                out[2].append(scores[pick])
        q, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out[0], out[2]))
        found = pa.concat_arrays(out[1]) if out[1] else ids.slice(0, 0)
        return pa.table([pa.array(q, pa.int32()), found, pa.array(s, pa.int64())], ["q", "doc_id", "score"])
    return run


def _blocks(items: DataFrame):
    """Items (id, counted terms) in blocks of bounded size, read partition by partition."""
    block, size = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        asked = Counter()
        for words in terms_of((text or "").encode()):
            asked.update(words)
        if not asked:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(text) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((item_id, asked))
        size += len(text)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents of each item."""
    spark = docs.sparkSession
    ship(spark)
    id_type, item_type = (x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (items, "item_id")))
    result = None
    for block in _blocks(items):
        words = sorted(set().union(*(asked for _, asked in block)))
        number = {w: i for i, w in enumerate(words)}
        sent = spark.sparkContext.broadcast(number)
        lists = index(docs, sent)
        sums = lists.groupBy("term").agg(F.sum(F.size("counts")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)))
        stats = {t: (n, s) for t, n, s in sums.collect()}  # one row per term of the block
        n_docs, n_terms = stats.get(_LENGTHS, (0, 0))
        asked_for = []
        for _, asked in block:
            at = np.array([number[w] for w in asked], np.int64)
            w = [weight(n_docs, stats[t][0]) * r if t in stats else 0 for t, r in zip(at.tolist(), asked.values())]
            asked_for.append((at, np.array(w, np.int64)))
        questions = spark.sparkContext.broadcast(asked_for)
        best = lists.groupBy("segment").applyInArrow(_best(questions, n_docs, n_terms, top), f"q int, doc_id {id_type}, score long")
        best = stored(top_k(best, "q", [F.desc("score"), F.col("doc_id").asc_nulls_last()], top))
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {item_type}")
        found = best.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        result = found if result is None else result.unionByName(found)
        sent.unpersist()
        questions.unpersist()
    if result is None:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    return result


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


def oracle_sql() -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = lambda table, key: f"SELECT {key}, unnest(regexp_extract_all({lower}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) t FROM {table}"
    return f"""
    WITH docs AS (SELECT row_number() OVER () r, doc_id, text FROM documents), items AS (SELECT row_number() OVER () q, item_id, text FROM benchmark),
    d AS ({terms("docs", "r, doc_id")}), i AS (SELECT q, item_id, t, count(*) c FROM ({terms("items", "q, item_id")}) GROUP BY ALL),
    p AS (SELECT r, doc_id, t, count(*) tf FROM d GROUP BY ALL), l AS (SELECT r, sum(tf)::BIGINT n FROM p GROUP BY r),
    g AS (SELECT count(*) AS n_all, sum(n)::BIGINT AS l_all FROM l), m AS (SELECT r, 75 + (25 * n * n_all) // l_all m FROM l, g),
    w AS (SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT w FROM p, g WHERE t IN (SELECT t FROM i) GROUP BY t, n_all),
    s AS (SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT score
          FROM i JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL)
    SELECT item_id, rank::INT AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
