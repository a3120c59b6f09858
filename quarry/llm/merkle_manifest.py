"""Merkle manifest of a dataset, with a proof per row climbed by recursive queries.

A row's leaf is the SHA-256 of its columns, each written as byte count, colon and
value (``-`` for null).  The leaves of a group (language) ascend by id; every eight
consecutive nodes hash to their parent until one remains, the group's subroot.
The subroots, ordered by group, form a tree of their own up to the root.

* **Built levels** are written as node rows that name their parent:
  (tree, level, pos), the digests of the node's run of children, its own digest,
  and ``up_tree, up_level, up_pos, ordinal``: the parent and the place in its run.
  Trees are numbered by group; the tree of the subroots is tree -1.
* **Ranks** come from range partitions: rows are sorted inside their partition, and
  each partition starts after what earlier ones hold of its group.  No group is sorted in one task.
* **The climb** is a recursive query: from each leaf a row ascends by its parent link and folds the tampered
  hash with the siblings of its run.  A second one appends the siblings themselves.  From the first parent on they
  are the same for the eight leaves of a run, so it climbs once for each run, and each leaf puts the siblings of
  its own run before; the long proofs (224 bytes a level) thus pass the steps of the recursion for an eighth of the rows.
  Nodes of one level are as many as the rows' distinct keys there.  Levels of at most
  ``BROADCAST_NODES`` nodes, whose few keys every row shares, are broadcast (their size
  is counted before: about 400 bytes a node, at most some twenty levels); the levels
  below are joined by shuffle, where no node has more than its share of leaves.

Defined results: a null id or group comes first and is ``-`` in the hash; repeated
rows are leaves of their own, next to each other; equal ids are ordered by their hash;
an empty table has an empty manifest without a root; other columns of the table are ignored.
Tampering replaces A-Z of the text by a-z where 3 divides the CRC-32 of the id; a null id is never tampered with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_NODES = 8192
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """``leaves`` (with ranks and parent links), ``nodes`` (built levels), ``root`` (hex or None)."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    levels: list  # (in the tree of subroots, level, number of nodes), from the leaves up


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """The digest (binary) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[_field(c) for c in fields]), 256))


def _hash(digests: Column) -> Column:
    """Digest of digests laid end to end (binary); they enter as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def _ranked(leaves: DataFrame, group: str, key: str) -> DataFrame:
    """Adds ``tree`` (rank of the group, null first), ``pos`` (rank in the group) and ``n`` (the group's rows).

    The id of a scanned row comes last in the order, so that rows which repeat can lie in several partitions.
    """
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), "leaf", "_row"]
    rows = leaves.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # rows keep their order inside a partition, and the id counts them
    rows = stored(rows.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33)))
    parts = stored(rows.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first")))
    # at most one row per partition and one more per group
    of_group = Window.partitionBy(group)
    parts = parts.withColumn("_start", F.sum("_c").over(of_group.orderBy("_p")) - F.col("_c")) \
        .withColumn("n", F.sum("_c").over(of_group)).withColumn("_p0", F.min("_p").over(of_group))
    groups = parts.filter("_p = _p0").select(F.col(group).alias("_g"), "_p0")
    born = groups.groupBy("_p0").agg(F.count(F.lit(1)).alias("_b"))  # at most one row per partition
    born = born.select("_p0", (F.sum("_b").over(Window.orderBy("_p0")) - F.col("_b")).alias("_before"))
    numbered = groups.join(F.broadcast(born), "_p0").select(
        "_g", (F.col("_before") + F.row_number().over(Window.partitionBy("_p0").orderBy(F.col("_g").asc_nulls_first())) - 1).alias("tree"))
    parts = parts.join(numbered, F.col(group).eqNullSafe(F.col("_g"))).select(
        F.col(group).alias("_g"), F.col("_p").alias("_q"), "tree", "n", (F.col("_start") - F.col("_first")).alias("_shift"))
    on = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))
    return rows.join(parts, on).select(*leaves.columns, "tree", (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def _links(tree: Column, level: Column, pos: Column, n: Column, trees: int) -> list[Column]:
    """The parent of a node: the run above it, from a subroot the tree of subroots, from the root none."""
    top, sub = n == 1, tree >= 0
    into = F.when(~top, tree).when(sub & F.lit(trees > 1), F.lit(-1))
    at = F.when(~top, pos).when(sub & F.lit(trees > 1), tree)
    above = F.when(~top, level + 1).when(sub & F.lit(trees > 1), F.lit(1))
    return [into.cast("long").alias("up_tree"), above.cast("int").alias("up_level"),
            F.floor(at / FANOUT).alias("up_pos"), (at % FANOUT).cast("int").alias("ordinal")]


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """All levels above ``nodes`` (tree, pos, n, digest), each written before the next."""
    out = []
    while most > 1:
        runs = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct((F.col("pos") % FANOUT).alias("o"), "digest"))).alias("_run"))
        children = F.aggregate("_run", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
        nodes = stored(runs.select("tree", "pos", F.ceil(F.col("n") / FANOUT).alias("n"), children.alias("children"))
                       .withColumn("digest", _hash(F.col("children"))))
        out.append(nodes)
        most = -(-most // FANOUT)
    return out


def build(docs: DataFrame, fields=FIELDS, key: str = "doc_id", group: str = "lang", text: str = "text") -> Manifest:
    """Leaves (untampered and tampered hash), all levels and the root."""
    cols = [F.col(c) for c in fields]
    lowered = [F.translate(c, _UPPER, _LOWER) if f == text else c for f, c in zip(fields, cols)]
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf_hash(cols).alias("leaf"),
                         F.when(hit & F.col(text).isNotNull(), leaf_hash(lowered)).alias("tampered"))
    ranked = stored(_ranked(stored(leaves), "group", "key"))
    # one row: the groups, the rows of the largest, and the nodes of each level (19 levels hold 8 ** 19 leaves)
    width = lambda k: F.ceil(F.col("n") / FANOUT ** k)
    trees, most, *widths = ranked.filter("pos = 0").agg(
        F.count(F.lit(1)), F.max("n"), *[F.sum(F.when(width(k - 1) > 1, width(k))) for k in range(1, 20)]).first()
    ground = ranked.select("tree", "pos", "n", F.col("leaf").alias("digest"))
    inner = _levels(ground, most or 0)
    subroots = None
    for level in [ground, *inner]:
        tops = level.filter("n = 1").select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("n"), "digest")
        subroots = tops if subroots is None else subroots.unionByName(tops)
    subroots = stored(subroots)
    outer = _levels(subroots, trees)
    nodes, counts = None, [(False, k, widths[k - 1]) for k in range(1, len(inner) + 1)]
    counts += [(True, k, -(-trees // FANOUT ** k)) for k in range(1, len(outer) + 1)]
    for is_outer, levels in ((False, inner), (True, outer)):
        for k, level in enumerate(levels, 1):
            x = level.select("tree", F.lit(k).alias("level"), "pos", "children", "digest", ((F.col("n") == 1) & F.lit(not is_outer)).alias("is_subroot"),
                             *_links(F.col("tree"), F.lit(k), F.col("pos"), F.col("n"), trees))
            nodes = x if nodes is None else nodes.unionByName(x)
    if nodes is None:  # no row, or a single one
        nodes = ground.limit(0).select("tree", F.lit(1).alias("level"), "pos", F.col("digest").alias("children"), "digest", F.lit(False).alias("is_subroot"),
                                       *_links(F.col("tree"), F.lit(1), F.col("pos"), F.col("n"), trees))
    nodes = stored(nodes)
    top = (outer[-1] if outer else subroots).select(F.lower(F.hex("digest"))).first()
    links = _links(F.col("tree"), F.lit(0), F.col("pos"), F.col("n"), trees)
    ranked = ranked.select("*", *links)
    return Manifest(ranked, nodes, top[0] if top else None, counts)


_FOLD = """
WITH RECURSIVE climb(key, at_tree, at_level, at_pos, at_ordinal, alone, folded, up_tree, up_level, up_pos, ordinal) AS (
  SELECT key, at_tree, at_level, at_pos, at_ordinal, alone, folded, up_tree, up_level, up_pos, ordinal FROM {rows}
  UNION ALL
  SELECT c.key, c.at_tree, c.at_level, c.at_pos, c.at_ordinal, c.alone,
         unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.ordinal), c.folded, substring(n.children, 32 * c.ordinal + 33)))), 256)),
         n.up_tree, n.up_level, n.up_pos, n.ordinal
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos)
SELECT * FROM climb"""

_PROVE = """
WITH RECURSIVE climb(tree, level, pos, subroot, proof, up_tree, up_level, up_pos, ordinal) AS (
  SELECT tree, level, pos, subroot, proof, up_tree, up_level, up_pos, ordinal FROM {rows}
  UNION ALL
  SELECT c.tree, c.level, c.pos, CASE WHEN n.is_subroot THEN n.digest ELSE c.subroot END,
         concat(c.proof, substring(n.children, 1, 32 * c.ordinal), substring(n.children, 32 * c.ordinal + 33)),
         n.up_tree, n.up_level, n.up_pos, n.ordinal
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos)
SELECT * FROM climb"""


def _ascend(m: Manifest, rows: DataFrame, levels: list, query: str) -> DataFrame:
    """``rows`` at the end of their way up through ``levels``, by a recursive query per run of levels of one size class."""
    spark = rows.sparkSession
    phases = []  # consecutive levels of one kind: (broadcast them, their (is_outer, level))
    for is_outer, level, n in levels:
        small = n <= BROADCAST_NODES
        if not (phases and phases[-1][0] == small):
            phases.append((small, []))
        phases[-1][1].append((is_outer, level))
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")  # as many rows as leaves
    try:
        for small, part in phases:
            inside = lambda tree, level: F.coalesce(F.concat_ws("/", (tree < 0).cast("string"), level).isin(
                [f"{str(o).lower()}/{k}" for o, k in part]), F.lit(False))
            nodes = m.nodes.filter(F.col("level").isin(sorted({k for _, k in part}))).filter(inside(F.col("tree"), F.col("level")))
            nodes = F.broadcast(nodes) if small else nodes
            steps = spark.sql(query, rows=rows, nodes=nodes)
            # of all steps the last in these levels
            rows = stored(steps.filter(F.col("up_tree").isNull() | ~inside(F.col("up_tree"), F.col("up_level"))))
    finally:
        spark.conf.set(_ROW_LIMIT, before)
    return rows


def climb(m: Manifest) -> DataFrame:
    """Every leaf's way to the root: key, leaf, subroot, folded (from the tampered hash), proof (siblings end to end), as digests."""
    up = ["up_tree", "up_level", "up_pos", "ordinal"]
    rows = m.leaves.select("key", *[F.col(c).alias(f"at_{c.removeprefix('up_')}") for c in up], F.when(F.col("up_tree").isNull(), F.col("leaf")).alias("alone"),
                           F.coalesce("tampered", "leaf").alias("folded"), *up)
    folded = _ascend(m, rows, m.levels, _FOLD)
    parents = m.nodes.filter("level = 1")  # of leaves: every such node but some of the few among the subroots
    rows = parents.select("tree", "level", "pos", F.when(F.col("is_subroot"), F.col("digest")).alias("subroot"), F.lit(b"").alias("proof"), *up)
    above = _ascend(m, rows, [x for x in m.levels if x[:2] != (False, 1)], _PROVE)
    above = above.select("tree", "level", "pos", "subroot", "proof").join(parents.select("tree", "level", "pos", "children"), ["tree", "level", "pos"])
    on = (F.col("at_tree") == F.col("tree")) & (F.col("at_level") == F.col("level")) & (F.col("at_pos") == F.col("pos"))
    leaf = F.coalesce("alone", F.expr("substring(children, 32 * at_ordinal + 1, 32)"))
    run = F.expr("concat(substring(children, 1, 32 * at_ordinal), substring(children, 32 * at_ordinal + 33), proof)")
    return folded.join(above, on, "left").select(
        "key", leaf.alias("leaf"), F.coalesce("subroot", leaf).alias("subroot"), "folded", F.coalesce(run, F.lit(b"")).alias("proof"))


def query(docs: DataFrame) -> DataFrame:
    m = build(docs)
    text = lambda c: F.lower(F.hex(c))
    root = F.lit(m.root).cast("string")
    return climb(m).select(
        F.col("key").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
        F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))


def oracle_sql() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c if c != "text" else text) for c in FIELDS) + ")"
    return f"""
    WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) t FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM range(256) r(i))),
    x AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS hit FROM documents, tab),
    leaves AS (SELECT *, {leaf("text")} leaf, CASE WHEN hit THEN {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END bad FROM x),
    r AS (SELECT doc_id, leaf, coalesce(bad, leaf) bad, row_number() OVER () rid, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 g,
          row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY lang) n FROM leaves),
    t AS (SELECT g, 0 lvl, pos, n, leaf d, NULL::VARCHAR[] run FROM r UNION ALL
          SELECT g, lvl + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)), list(d ORDER BY pos) FROM t WHERE n > 1 GROUP BY g, lvl, pos // 8),
    s AS (SELECT g, d, count(*) OVER () n FROM t WHERE n = 1),
    u AS (SELECT 0 lvl, g pos, n, d, NULL::VARCHAR[] run FROM s UNION ALL
          SELECT lvl + 1, pos // 8, (max(n) + 7) // 8, sha256(string_agg(d, '' ORDER BY pos)), list(d ORDER BY pos) FROM u WHERE n > 1 GROUP BY lvl, pos // 8),
    runs AS (SELECT g, lvl, pos, run FROM t WHERE lvl > 0 UNION ALL SELECT -1, lvl, pos, run FROM u WHERE lvl > 0),
    c AS (SELECT rid, CASE WHEN n > 1 THEN g ELSE -1 END tree, 1 lvl, CASE WHEN n > 1 THEN pos ELSE g END pos, CASE WHEN n > 1 THEN n ELSE (SELECT count(*) FROM s) END n,
                 g, bad f, '' p FROM r UNION ALL
          SELECT rid, CASE WHEN (c.n + 7) // 8 > 1 THEN tree ELSE -1 END, CASE WHEN tree >= 0 AND (c.n + 7) // 8 = 1 THEN 1 ELSE c.lvl + 1 END,
                 CASE WHEN tree >= 0 AND (c.n + 7) // 8 = 1 THEN c.g ELSE c.pos // 8 END,
                 CASE WHEN tree >= 0 AND (c.n + 7) // 8 = 1 THEN (SELECT count(*) FROM s) ELSE (c.n + 7) // 8 END, c.g,
                 sha256(array_to_string(run[1:c.pos % 8], '') || f || array_to_string(run[c.pos % 8 + 2:], '')),
                 p || array_to_string(run[1:c.pos % 8], '') || array_to_string(run[c.pos % 8 + 2:], '')
          FROM c JOIN runs ON runs.g = tree AND runs.lvl = c.lvl AND runs.pos = c.pos // 8 WHERE c.n > 1),
    w AS (SELECT rid, arg_max(f, strlen(p)) f, max(p) p FROM c WHERE tree = -1 AND n = 1 GROUP BY rid)
    SELECT doc_id, leaf, s.d AS subroot, (SELECT d FROM u WHERE n = 1) AS root, sha256(p) AS proof_sha256, f AS folded_root,
           f = (SELECT d FROM u WHERE n = 1) AS verified
    FROM r JOIN w USING (rid) JOIN s ON s.g = r.g"""
