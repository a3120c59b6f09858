"""Connected components by alternating large-star and small-star.

Every round is two grouped minima and two joins on the edge table; no
neighbour list is ever gathered, so a node with a third of all edges is only a
skewed join (AQE splits it) over a partially aggregated minimum.  The lineage
is cut after each round by a checkpoint in the shared folder.  A table of edges
has partitions in proportion to its rows (``EDGES``), whatever it was dealt over
before: few edges make few tasks and files, and within one partition no exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

EDGES = 50_000  # edges to a partition


def _rows(*pairs) -> list:
    """Columns u and v with a row for each pair; unlike a union it keeps how the table is dealt out."""
    return [F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs]))]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select(*_rows(("u", "v"), ("v", "u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(*_rows(("u", "m"), ("v", "m"))).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    edges: columns ``a`` and ``b`` (long); direction, repeats and loops don't matter, nulls are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e, before = checkpointed(e), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        parts = max(1, math.ceil(state[0] / EDGES))  # a round makes no more edges than it had
        if before is None:
            e = e.coalesce(parts)
        if state == before or not state[0]:
            break
        before = state
        large = _large_star(e).coalesce(parts)
        e = checkpointed(_small_star(large).coalesce(parts).distinct().coalesce(parts))
    # every edge now runs from a node to the smallest of its component
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
