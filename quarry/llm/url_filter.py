"""URL filter: written rules first, link-graph propagation for the rest.

A rule names a host and a path prefix and says allow or block; it fits the host
and all its subdomains, and the longest fitting rule decides.  Pages that no
rule fits are judged by their host: trust flows from hosts with allowed pages
along the links (personalised PageRank), distrust flows from hosts with blocked
pages against the links (whoever links to them).  A host's seed is the share of
its pages that rules allow or block.  A host is blocked when its distrust
reaches ``min_distrust`` and exceeds its trust.

Scores are fixed-point integers (``SCALE`` = 1.0), so sums do not depend on the
order of tasks and a recomputed partition gives the same digits.  Everything is
DataFrame work.  Host edges are deduplicated by a grouped aggregate before any
join; the joins on hosts are plain sort-merge joins, which AQE splits for a hot
host.  Lineage is cut by checkpoints in the shared folder.  Tables of hosts and
edges have partitions in proportion to their rows (``ROWS``), whatever the pages
are dealt over, so that few hosts make few files and few tasks that read them.

A null url, or one without ``://``, has an empty host and path.  Null html has
no links; relative links stay on the host and carry nothing; links to hosts
without pages are left out.  Repeated pages give repeated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host/path prefix): fixed by the contract of the query.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
SCALE = 10_000_000
MIN_DISTRUST = SCALE // 20
DAMPING = 85  # of 100
ROUNDS = 8
BROADCAST_HOSTS = 300_000
ROWS = 50_000  # hosts or edges to a partition
#: The host part of links that name one.
LINK_HOST = r"""(?i)\shref\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, the longest fitting rule and its verdict."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, prefix in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):  # the last one set wins
        host, path = prefix[:prefix.index("/")], prefix[prefix.index("/"):]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return p.withColumns({"rule": rule, "rule_verdict": verdict})


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts that have pages."""
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK_HOST), F.lit(1))
    e = (pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(found)).alias("dst"))
         .withColumn("dst", F.translate("dst", *LOWER)).filter("src <> dst AND src <> ''"))
    e = e.groupBy("src", "dst").agg(F.lit(1).alias("one")).select("src", "dst")
    return e.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")


def _parts(x: DataFrame) -> int:
    return max(1, math.ceil(x.count() / ROWS))


def _dealt(x: DataFrame) -> DataFrame:
    """A checkpoint with partitions in proportion to its rows."""
    x = checkpointed(x)
    return x.coalesce(_parts(x))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``score`` of each host after ``rounds`` of
    ``score = ((100 - DAMPING) * seed + DAMPING * sum(score of src / out-degree of src)) / 100``.

    seeds: (host, seed); edges: (src, dst), distinct.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    edges = _dealt(edges.join(degree, "src"))
    scores = seeds.select("host", F.expr(f"seed * {100 - DAMPING} div 100").alias("score"))
    if edges.isEmpty():
        return scores
    parts = _parts(seeds)
    for _ in range(rounds):
        sent = (edges.join(scores.filter("score > 0"), F.col("src") == F.col("host"))
                .select(F.col("dst").alias("host"), F.expr("score div degree").alias("part")))
        got = sent.groupBy("host").agg(F.sum("part").alias("got"))
        scores = checkpointed(seeds.join(got, "host", "left").select(
            "host", F.expr(f"(seed * {100 - DAMPING} + coalesce(got, 0) * {DAMPING}) div 100").alias("score")).coalesce(parts)).coalesce(parts)
    return scores


def host_scores(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust."""
    hosts = _dealt(judged(pages, rules).groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("n_allow"),
        F.count_if(F.col("rule_verdict") == "block").alias("n_block")))
    edges = _dealt(host_edges(pages, hosts))
    seed = lambda c: hosts.select("host", F.expr(f"{c} * {SCALE} div n").alias("seed"))
    trust = propagate(seed("n_allow"), edges, rounds).withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return trust.join(propagate(seed("n_block"), back, rounds).withColumnRenamed("score", "distrust"), "host").coalesce(_parts(hosts))


def judge(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, min_distrust: int = MIN_DISTRUST) -> DataFrame:
    """Every page with its verdict and its host's scores."""
    hosts = checkpointed(host_scores(pages, rules, rounds))
    if hosts.count() <= BROADCAST_HOSTS:  # so that a host with a third of all pages needs no shuffle
        hosts = F.broadcast(hosts)
    scored = judged(pages, rules).join(hosts, "host", "left")
    blocked = (F.col("distrust") >= min_distrust) & (F.col("distrust") > F.col("trust"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce(
        "rule_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def oracle_sql() -> str:
    """The same rounds as unrolled joins."""
    lower = "translate({}, '%s', '%s')" % LOWER
    fits = []
    for what, prefix in sorted(RULES, key=lambda r: (len(r[1]), r[1].index("/")), reverse=True):
        h, p = prefix[:prefix.index("/")], prefix[prefix.index("/"):]
        fits.append((f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", prefix, what))
    case = lambda k: "CASE " + " ".join(f"{f[0]} THEN '{f[k]}'" for f in fits) + " END"
    link = LINK_HOST.replace("'", "''")
    ctes = [f"""
    p AS (SELECT page_id, html, {lower.format("coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '')")} AS host,
                 coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    j AS (SELECT page_id, html, host, path, {case(1)} AS rule, {case(2)} AS rv FROM p),
    h AS (SELECT host, count(*) n, count(*) FILTER (rv = 'allow') a, count(*) FILTER (rv = 'block') b FROM j GROUP BY host),
    e AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, {lower.format("unnest(regexp_extract_all(coalesce(html, ''), '" + link + "', 1))")} AS dst FROM j)
          WHERE src <> dst AND src <> '' AND dst IN (SELECT host FROM h)),
    ef AS (SELECT src, dst, count(*) OVER (PARTITION BY src) d FROM e),
    eb AS (SELECT dst AS src, src AS dst, count(*) OVER (PARTITION BY dst) d FROM e)"""]
    for name, col, edge in (("t", "a", "ef"), ("u", "b", "eb")):
        seed = f"h.{col} * {SCALE} // h.n"
        ctes.append(f"{name}0 AS (SELECT host, ({seed}) * {100 - DAMPING} // 100 s FROM h)")
        for n in range(1, ROUNDS + 1):
            ctes.append(f"""{name}{n} AS (SELECT h.host, (({seed}) * {100 - DAMPING} + coalesce(g.got, 0) * {DAMPING}) // 100 s
              FROM h LEFT JOIN (SELECT dst, sum(s // d)::BIGINT got FROM {edge} JOIN {name}{n - 1} ON src = host GROUP BY dst) g ON g.dst = h.host)""")
    return f"""WITH {', '.join(ctes)}
    SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN u.s >= {MIN_DISTRUST} AND u.s > t.s THEN 'block' ELSE 'allow' END) AS verdict,
           t.s::BIGINT AS trust, u.s::BIGINT AS distrust FROM j JOIN t{ROUNDS} t USING (host) JOIN u{ROUNDS} u USING (host)"""
