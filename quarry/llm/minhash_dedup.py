"""MinHash near-duplicates: universal hash minima, banding, verification, components.

1. One map turns each text into its set of word shingles (64-bit hashes), a
   digest of the set, ``bands * rows`` minima under random multiply-add hashes,
   one bucket key per band and a byte of every minimum as signature.
2. Documents with equal sets form one class (a grouped minimum), so copies cost
   one row from here on.
3. Classes that share a bucket are candidates.  Each first meets only the
   bucket's most central member, its hub, and of its hubs the one with which it
   shares most buckets; a group of n near copies costs n verifications, not n * n / 2.
4. Candidates whose signatures agree enough are confirmed on their full sets.
   Confirmed links give components (large-star, small-star).
5. What the hubs did not connect is settled exactly, for the members of buckets
   that still hold several components.  Sets that are linked share one of their
   rarest shingles (``rare_keys``), where shingles of a single component don't
   count.  Under each key sets first meet one of them, then, across the components
   that are left, all that share a key; they are confirmed on full sets too.

A pair at the threshold shares no bucket with probability
``(1 - threshold ** rows) ** bands``; the number of bands is chosen so that this
is at most ``MISS``.  The signature bound lies seven standard deviations below
the threshold.

Texts are read again only for candidates: the wanted ids are broadcast when at
most ``BROADCAST_IDS``, else joined by a shuffle.

Null text, or one without words, has no set and links with nothing.  Rows with
one id count as one document.  A null id links like any other but never names a
component.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, slices, stored, text_bytes
from .components import components

SHINGLE = 3
THRESHOLD = 85  # of 100
ROWS = 6
MISS = 4e-8  # chance that a pair exactly at the threshold shares no bucket
BROADCAST_IDS = 2_000_000
CLASS = 1.1  # sizes of one class differ by this factor at most
_SEED = 20240601
_CUT = 1 << 15  # shingles hashed at a time


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; A-Z is lower-cased."""
    words = text.lower().split()  # bytes: only A-Z, only space and \x09-\x0D
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width_now = min(n, width)
    total = np.full(n - width_now + 1, width_now, np.uint64)  # a short sequence never equals a full shingle
    for k, factor in enumerate(_odd(width, _SEED)[:width_now]):
        total += h[k:n - width_now + 1 + k] * factor
        total = _mixed(total)
    return np.unique(total)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (documents x bands) and signature bytes (documents x bands * rows)."""
    k = bands * rows
    a, b = _odd(k, _SEED + 1), _odd(k, _SEED + 2)
    minima = np.empty((len(sets), k), np.uint64)
    at = 0
    while at < len(sets):  # some documents at a time, so that the hashed values stay in the cache
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= _CUT:
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
        for i in range(k):
            minima[at:end, i] = np.minimum.reduceat(x * a[i] + b[i], starts)
        at = end
    keys = np.zeros((len(sets), bands), np.uint64)
    by_band = minima.reshape(len(sets), bands, rows)
    for r in range(rows):
        keys = _mixed(keys + by_band[:, :, r])
    keys = _mixed(keys + np.arange(1, bands + 1, dtype=np.uint64))
    return keys.view(np.int64), (_mixed(minima) >> np.uint64(56)).astype(np.uint8)


def bands_for(threshold: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold / 100) ** rows))


def sketches(docs: DataFrame, bands: int, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest (binary), keys (array), signature (binary)."""

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t, width) for t in text_bytes(b.column("text"))]
            full = [s for s in sets if len(s)]
            keys, sig = signatures(full, bands, rows) if full else (np.zeros((0, bands), np.int64), np.zeros((0, 0), np.uint8))
            counts = pa.array([len(s) for s in sets], pa.int64())
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            ends = np.cumsum([bands * (len(s) > 0) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            packed = iter(sig)
            sigs = pa.array([next(packed).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, digests, lists, sigs],
                                             ["doc_id", "n_shingles", "digest", "keys", "signature"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, digest binary, keys array<long>, signature binary")


def _agreeing(rows: int, bands: int, threshold: int) -> int:
    """Signature bytes that must agree: seven standard deviations under the threshold."""
    k, s = rows * bands, threshold / 100
    return max(0, int(k * s - 7 * (k * s * (1 - s)) ** 0.5))


def _similar_signatures(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``least`` bytes; adds ``agree``."""
    sig = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"_{x}"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("_a", "_b"))
                agree = (x == y).sum(1)
                keep = pa.array(agree >= least)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(agree, pa.int64())], ["a", "b", "agree"]).filter(keep)

    return map_arrow(pairs.join(sig("a"), "a").join(sig("b"), "b"), run, "a long, b long, agree long")


def _with_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, and what else they hold) with the texts x of a and y of b."""
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    side = lambda i, x: texts.select(F.col("id").alias(i), F.col("text").alias(x))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")


def _sets(batch, width: int):
    """(a, b, set of a, set of b) for the rows of a batch; rows of one b follow each other."""
    last, of_last = None, None
    for i, j, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                          text_bytes(batch.column("x")), text_bytes(batch.column("y"))):
        if last != y:
            last, of_last = y, shingles(y, width)
        yield i, j, shingles(x, width), of_last


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _confirmed(docs: DataFrame, pairs: DataFrame, threshold: int, width: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for b in slices(batches, column="x"):
            links = [(i, j) for i, j, x, y in _sets(b, width) if _linked(x, y, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_arrow(_with_texts(docs, pairs), run, "a long, b long")


def edit_keys(x: np.ndarray, hub: np.ndarray, threshold: int, linked: bool) -> list[tuple[int, int, int]]:
    """(shingle, own size class, partner's size class) under which a document can meet partners of its hub's group.

    Documents are compared by their edits against the hub: x and y differ where their edits differ, so a link means
    edits that overlap in at least ``c`` shingles, with c from the sizes alone.  Then the first ``edits - c + 1``
    shingles of both, in one common order, share one.  What the hub lacks comes first: such shingles are the rarest.
    """
    own = np.setdiff1d(x, hub, assume_unique=True)
    lost = np.setdiff1d(hub, x, assume_unique=True)
    edits = np.concatenate([own, lost]).view(np.int64)
    n, size, base = len(edits), len(x), len(hub)
    most = lambda total: total * (100 - threshold) // (100 + threshold)  # noqa: E731  shingles in which linked sets of this total size differ
    step = max(1, most(2 * base) // 6)
    out = []
    for k in range((n + most(size + base + n)) // step + 2):
        low, high = k * step, (k + 1) * step - 1
        # a partner that is linked to the hub itself is met by those that are not, and these have many edits
        if linked and high * 200 <= (100 - threshold) * 2 * base:
            continue
        c = max(1, -((most(size + base + high) - n - low) // 2))
        if c <= min(n, high):
            out += [(t, n // step, k) for t in edits[:n - c + 1].tolist()]
    return out


def _open_sets(docs: DataFrame, parts: DataFrame, width: int) -> DataFrame:
    """(node, part, size, shingles) and a row number _r for the different texts of ``parts`` (node, part), a checkpoint."""

    def run(batches):
        for b in slices(batches):
            sets = [shingles(t, width) for t in text_bytes(b.column("text"))]
            ends = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                b.column("node"), b.column("part"), pa.array(np.diff(ends)), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "part", "size", "digest", "shingles"])

    n = parts.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(F.broadcast(parts) if n <= BROADCAST_IDS else parts, "node")
    numbered = lambda x: stored(x.withColumn("_r", F.monotonically_increasing_id()))
    sets = numbered(map_arrow(texts, run, "node long, part long, size long, digest binary, shingles array<long>").filter("size > 0"))
    return sets if sets.count() <= n else numbered(sets.dropDuplicates(["node", "digest"]))  # rows that repeat an id


def rare_keys(sets: DataFrame, threshold: int) -> DataFrame:
    """node, part, size, shingle, its place (from 0), own size class and partner's size class: sets of different parts that
    are linked share a key, with the classes exchanged.

    Shingles are ordered by rarity: first those of a single part, which no pair needs, then by the number of sets.  Sets of
    n and m shingles are linked if they share at least ``threshold * (n + m) / (100 + threshold)``.  The first one they share
    has at least as many behind it in both, itself included, so it lies early in both.
    """
    rows = sets.select("_r", "part", F.explode("shingles").alias("shingle"))
    shared = (rows.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("n"))
              .filter("lo < hi").select("shingle", "n"))
    order = rows.join(shared, "shingle").groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    x = order.join(sets.select("_r", "node", "part", "size"), "_r")
    size_class = lambda n: F.floor(F.log(n) / math.log(CLASS)).cast("int")
    least = f"size * {threshold} / 100"  # shingles of a partner
    x = x.withColumns({"own": size_class(F.col("size")), "partner": F.explode(F.sequence(
        size_class(F.expr(least)) - 1, size_class(F.expr(f"size * 100 / {threshold}")) + 1))})
    x = x.filter(f"pow({CLASS}, partner + 1) * 1.000001 >= {least}")
    low = f"greatest(floor(pow({CLASS}, partner) * 0.999999), ceil({least}))"
    both = f"ceil({threshold} * (size + {low}) / {100 + threshold} - 0.000001)"  # what is shared with a partner, at least
    x = x.withColumn("most", F.expr(f"cast(size(common) - {both} + 1 as int)")).filter("most > 0")
    return x.select("node", "part", "size", "own", "partner", (F.col("size") - F.size("common")).alias("alone"),
                    F.posexplode(F.slice("common", 1, F.col("most"))).alias("at", "x")).select(
        "node", "part", "size", "own", "partner", (F.col("alone") + F.col("at")).alias("place"), "x.shingle")


def _by_most(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), with repeats, each a's most frequent one."""
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))


def _joined(first: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b)."""
    part = lambda i: first.select(F.col("node").alias(i), F.col("component").alias(f"p{i}"))
    merged = checkpointed(components(links.join(part("a"), "a", "left").join(part("b"), "b", "left").select(
        F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))))
    whole = first.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "node", F.coalesce("to", "component").alias("component"))
    return checkpointed(whole.unionByName(merged.join(first, "node", "left_anti")))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    bands = bands_for(threshold, rows)
    sketch = checkpointed(sketches(docs, bands, rows, width))
    linked = sketch.filter("digest IS NOT NULL")
    classes = checkpointed(linked.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"),
        F.first("keys").alias("keys"), F.first("signature").alias("signature")))
    # of rows with one id and different texts, any class may stand for the id
    nodes = classes.filter("node IS NOT NULL").select("node", "keys", "signature")
    least = _agreeing(rows, bands, threshold)

    rows_of = nodes.select(F.explode("keys").alias("key"), "node")
    shared = rows_of.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = checkpointed(rows_of.join(shared, "key"))
    # a bucket's hub is its most central member: the one that shares most buckets with most others
    weight = members.groupBy("node").agg(F.sum("c").alias("w"))
    hubs = members.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("w", -F.col("node"))).alias("hub"))
    members = checkpointed(members.select("key", "node").join(hubs, "key"))
    signed = checkpointed(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "signature"))

    checked = lambda pairs: checkpointed(_confirmed(docs, checkpointed(_similar_signatures(pairs, signed, least)), threshold, width))
    # of its hubs a node meets the one with which it shares most buckets
    links = checked(_by_most(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    component = checkpointed(components(links))

    # buckets whose members are still apart
    part = lambda x: x.join(component, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    here = part(members.select("key", "node"))
    split = here.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key")
    open_ = checkpointed(here.join(split, "key", "left_semi").select("node", "part").distinct())
    keyed = checkpointed(rare_keys(_open_sets(docs, open_, width), threshold))
    # sets under one key meet one of them first, so that what is linked there is not paired
    alike = keyed.filter("own = partner").select("shingle", "own", "node", "part")
    one = alike.groupBy("shingle", "own").agg(F.min(F.struct("part", "node")).alias("one"))
    links = checked(_by_most(alike.join(one, ["shingle", "own"]).filter("part <> one.part").select(F.col("node").alias("a"), F.col("one.node").alias("b"))))
    if not links.isEmpty():
        component = _joined(component, links)
        keyed = checkpointed(part(keyed.drop("part")))
    # what is connected already needs no pair
    side = lambda x, own, partner: keyed.select(
        "shingle", F.col(own).alias("own"), F.col(partner).alias("partner"), *[F.col(c).alias(c + x) for c in ("node", "part", "size", "place")])
    behind = f"least(sizea - placea, sizeb - placeb) * {100 + threshold} >= (sizea + sizeb) * {threshold}"
    apart = side("a", "own", "partner").join(side("b", "partner", "own"), ["shingle", "own", "partner"]).filter(f"parta < partb AND {behind}").select(
        F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct()
    links = checked(apart)
    if not links.isEmpty():
        component = _joined(component, links)

    named = (classes.join(component, "node", "left").filter("n > 1 OR component IS NOT NULL")
             .select("digest", F.coalesce("component", "node").alias("component")))
    out = sketch.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def filter_stage(docs: DataFrame, threshold: int = 80, width: int = 5) -> DataFrame:
    """One document of each group of near duplicates, with its own columns; of repeated rows one stays.
    Rows without an id count as one document: they stay if any of them does."""
    kept = checkpointed(near_duplicates(docs, threshold, rows=5, width=width).filter("kept").select("doc_id"))
    ids = kept.distinct()
    n, different = kept.count(), ids.count()
    wanted = F.broadcast(ids) if different <= BROADCAST_IDS else ids
    out = docs.join(wanted, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    return out if n == different else out.dropDuplicates(["doc_id", "text"])
