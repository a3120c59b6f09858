"""Line dedup by distinct-site spread.

A line is boilerplate when it stands on at least ``min_sites`` distinct sites; for
a passage, a line of more than ``LONG_WORDS`` words, ``long_sites`` are enough
where the caller gives them (the pipeline does; the query keeps to its SQL).
A HyperLogLog sketch of the sites is kept per line hash and merged by
aggregation, so a line on a billion pages costs one sketch per task, not a list
of sites.  Sketches are uncertain near the threshold: lines whose estimate lies
within ``band`` standard errors of it get an exact distinct count, so the
outcome is that of exact counting.  Boilerplate is then removed everywhere but
at its first occurrence (smallest doc_id, then position), so that no text is
lost from the corpus as a whole.

Shuffles: line keys with sketches (combined inside each task), the positions of
boilerplate lines, and the texts once for the rebuild.  A hot line is collapsed
by partial aggregation; joins on lines are sort-merge joins that AQE splits.

A line is keyed by its 64-bit hash and its length.  Lines without a word are
never boilerplate.  A null site is a site of its own.  Null text stays null and
has no lines; rows that repeat (same doc_id and text) are treated alike; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed

MIN_SITES = 10
LONG_WORDS, LONG_SITES = 50, 2  # passages repeat by copying, not by chance
LG_K = 10  # registers: 2 ** LG_K, standard error 1.04 / sqrt(2 ** LG_K)
BAND = 5.0
_KEY = ["_h", "_n"]


def _lines(docs: DataFrame, site_col: str) -> DataFrame:
    """Lines with a word: document key, id, position, line key, site, whether it is long."""
    x = docs.select(_doc_key().alias("_k"), F.col("doc_id").alias("_id"), F.col(site_col).alias("_site"),
                    F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
    return x.filter(F.col("_line").rlike(f"[^{SPACE}]")).select(
        "_k", "_id", "_pos", F.xxhash64("_line").alias("_h"), F.length("_line").alias("_n"), "_site", _long("_line").alias("_long"))


def _long(line: str):
    words = F.filter(F.split(line, f"[{SPACE}]+"), lambda w: w != "")
    # so many words and the blanks between them take at least twice as many characters
    return F.when(F.length(line) > 2 * LONG_WORDS, F.size(words) > LONG_WORDS).otherwise(False)


def _doc_key():
    """128 bits of a document's id and text; rows equal in both share it."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def spread(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", lg_k: int = LG_K,
           band: float = BAND, long_sites: int | None = None) -> DataFrame:
    """Boilerplate lines: key, first occurrence (``_first``), ``n_sites`` (estimate, or exact near the threshold)."""
    lines = _lines(docs, site_col)
    site = F.coalesce(F.xxhash64(F.lit(0), "_site"), F.lit(0))
    est = lines.groupBy(*_KEY).agg(
        F.hll_sketch_agg(site, lg_k).alias("_s"), F.count(F.lit(1)).alias("_c"),
        F.min(F.struct("_id", "_pos")).alias("_first"), F.max("_long").alias("_long"))
    need = F.when(F.col("_long"), F.lit(min_sites if long_sites is None else min(long_sites, min_sites))).otherwise(F.lit(min_sites))
    width = band * 1.04 / 2 ** (lg_k / 2)
    low, high = F.floor(F.col("_need") * (1 - width)), F.ceil(F.col("_need") * (1 + width))
    est = checkpointed(est.withColumn("_need", need).drop("_long").filter(F.col("_c") >= F.col("_need"))
                       .withColumn("_e", F.hll_sketch_estimate("_s")).drop("_s").filter(F.col("_e") >= low))
    near = est.filter(F.col("_e") <= high)
    # exact counts, one row per (line, site) and task before any shuffle
    pairs = lines.select(*_KEY, "_site").join(near.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY, "_site").agg(F.lit(1).alias("_one"))
    exact = pairs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_x"))
    sure = est.filter(F.col("_e") > high).select(*_KEY, "_first", F.col("_e").alias("n_sites"))
    checked = near.join(exact, _KEY).filter(F.col("_x") >= F.col("_need")).select(*_KEY, "_first", F.col("_x").alias("n_sites"))
    return sure.unionByName(checked)


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", long_sites: int | None = None) -> DataFrame:
    """The documents with boilerplate lines removed; adds ``n_lines`` and ``n_removed``."""
    bad = checkpointed(spread(docs, min_sites, site_col, long_sites=long_sites))
    hit = _lines(docs, site_col).join(bad, _KEY).filter(
        ~(F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_pos") == F.col("_first._pos"))))
    drops = hit.groupBy("_k").agg(F.array_distinct(F.collect_list("_pos")).alias("_drop"))
    rows = docs.select(F.struct("*").alias("_row"), _doc_key().alias("_k"))
    lines = F.split("_row.text", "\n", -1)
    x = rows.join(drops, "_k", "left").withColumn("_lines", lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    rebuilt = F.when(F.col("_drop").isNull(), F.col("_row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    cols = [rebuilt.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return x.select(*cols, F.greatest(F.lit(0), F.size("_lines")).cast("long").alias("n_lines"),
                    F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_removed"))


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


def oracle_sql() -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () rid, doc_id, source, text, string_split(text, chr(10)) ls FROM documents),
    l AS (SELECT rid, doc_id, source, i, ls[i] l FROM (SELECT *, unnest(range(1, len(ls) + 1)) i FROM d)),
    b AS (SELECT l, min((doc_id, i)) f FROM l WHERE regexp_matches(l, '[^ \\t-\\r]') GROUP BY l
          HAVING count(DISTINCT coalesce(source, chr(0))) >= {MIN_SITES}),
    k AS (SELECT l.*, b.l IS NOT NULL AND (l.doc_id, l.i) <> b.f AS gone FROM l LEFT JOIN b ON l.l = b.l),
    r AS (SELECT rid, count(*) n, count(*) FILTER (gone) g, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') t FROM k GROUP BY rid)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_removed, CASE WHEN text IS NOT NULL THEN t END AS text
    FROM d LEFT JOIN r USING (rid)"""
