"""URL filter, quality rules and line dedup against plain Python and on odd rows."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup as ld
from quarry.llm import quality_rules as qr
from quarry.llm import url_filter as uf

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b c a b c a b c d\n\nx\nx", "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s2", 0), (None, "one #two", "en", "s1", 3),
       (4, "w" * 200_000, "en", "s3", 9), (5, "same same\n" * 3000, "en", "s1", 9), (5, "same same\n" * 3000, "en", "s1", 9),
       (6, "the cat sat on the mat. " * 40, "en", "s4", 9), (7, "É\u00a0b\x1cc \x0b\x0c\td", "fr", "s4", 9), (8, "a a a", "en", "s1", 5), (9, "a a a a", "en", "s1", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD], DOC + ", word string, kept int")


def _measures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    count = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + o for i in range(len(words) - 2) if count[tuple(words[i:i + 3])] > 1 for o in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(odd):
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.query(odd).collect())
    assert got == sorted((i or 0, *_measures(t)) for i, t, *_ in ODD)


def test_quality_plan_is_native(odd):
    plan = qr.query(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_policies(odd):
    book = qr.ledger(odd)
    rows = qr.apply_policy(qr.apply_policy(book, qr.BASE, "base"), qr.STANDARD).collect()
    names = list(qr.RULES)
    for r in rows:
        failed = {names[i] for i in range(len(names)) if r.fail_bits >> i & 1}
        assert r.base == (not failed & set(qr.BASE.rules)) and r.kept == (not failed & set(qr.STANDARD.rules))
    for a in qr.ablations(book, qr.STANDARD).collect():
        bit = 1 << names.index(a.rule)
        assert a.n_failed == sum(bool(r.fail_bits & bit) for r in rows)
        assert a.n_failed_alone == sum(r.fail_bits == bit for r in rows)
        assert a.n_kept_without == sum(r.fail_bits & ~bit == 0 for r in rows)
    assert qr.query(odd.limit(0)).count() == 0
    stage = qr.filter_stage(odd)
    assert stage.columns == odd.columns and {r.doc_id for r in stage.collect()} == {r.doc_id for r in rows if r.kept}


def _dedup(rows, least):
    sites, first = collections.defaultdict(set), {}
    for i, t, site in rows:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" \t\n\x0b\x0c\r"):
                sites[line].add(site)
                first[line] = min(first.get(line, (i, k)), (i, k))
    out = []
    for i, t, site in rows:
        lines = t.split("\n") if t is not None else []
        keep = [x for k, x in enumerate(lines) if len(sites.get(x, ())) < least or first[x] == (i, k)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep) if t is not None else None))
    return sorted(out)


def test_line_dedup(spark):
    rows = [(i, f"hot\nown {i}\nspread {i % 30}\n\nhot" if i % 9 else None, f"site{i % 17}" if i % 17 else None) for i in range(600)]
    rows += [(700, "hot\nhot", "site1"), (701, "", "site1"), (702, "\n\n", "site2"), (703, "x\n" * 20_000, "site3")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, _k int")
    for least in (2, 10, 17, 18):
        got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in ld.dedup(df, least).collect())
        assert got == _dedup(rows, least)
    assert ld.dedup(df).columns[:4] == df.columns
    assert ld.query(df.limit(0)).count() == 0


def test_line_dedup_exact_near_threshold(spark):
    """Hundreds of sites: sketches alone would be off by one."""
    rows = [(s * 10 + k, f"line {k}", f"site{s}") for k in range(10) for s in range(295 + k)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.text for r in ld.dedup(df, 300).filter("n_removed > 0").select(F.col("doc_id") % 10).distinct().toDF("text").collect()}
    assert got == {5, 6, 7, 8, 9}


def test_line_dedup_passages_in_a_hot_source(spark):
    """Passages of over 50 words go when they are on two sites, most copies in one; a shorter line on nine sites stays."""
    passage = lambda k, n=51: " ".join(f"p{k}w{i}" for i in range(n))
    rows = [(k * 100 + i, f"own {k} {i}\n{passage(k)}", "hot" if i < 19 else f"site{k}") for k in range(6) for i in range(20)]
    rows += [(1000 + i, f"own {i}\n{passage(99, 50)}\n{'x ' * 60}alone{i}", f"site{i % 9}") for i in range(20)]
    rows += [(2000 + i, f"own {i}\n{passage(77)}", "hot") for i in range(20)]  # one site only
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed for r in ld.dedup(df, long_sites=ld.LONG_SITES).collect()}
    assert got == {i: int(i < 1000 and i % 100 > 0) for i, *_ in rows}


def test_url_parts_and_rules(spark):
    urls = {"http://a.example.com/en/x": ("block", "example.com/en/"), "http://www.example.com/en/x": ("allow", "www.example.com/en/"),
            "HTTPS://WWW.Example.COM/fr/": ("allow", "com/"), "http://x.net/es/1?a#b": ("block", "net/es/"), "http://x.net/en/": (None, None),
            "http://notcom/en": (None, None), "http://com": (None, None), "http://com/": ("allow", "com/"), "nothing": (None, None), None: (None, None),
            "a://b://c.com/": (None, None), "http://x.org": (None, None)}
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    rows = {r.page_id: r for r in uf.judge(df).collect()}
    for i, (u, (verdict, rule)) in enumerate(urls.items()):
        assert rows[i].rule == rule
        if verdict:
            assert rows[i].verdict == verdict
    assert (rows[3].host, rows[3].path) == ("x.net", "/es/1") and (rows[8].host, rows[8].path) == ("", "")
    assert rows[2].host == "www.example.com" and rows[10].host == "b:" and rows[11].path == ""
    assert uf.judge(df.limit(0)).count() == 0


def _propagate(seed, edges, rounds):
    out = collections.Counter(s for s, _ in edges)
    score = {h: s * (100 - uf.DAMPING) // 100 for h, s in seed.items()}
    for _ in range(rounds):
        got = collections.Counter()
        for s, d in edges:
            got[d] += score[s] // out[s]
        score = {h: (seed[h] * (100 - uf.DAMPING) + got[h] * uf.DAMPING) // 100 for h in seed}
    return score


def test_url_propagation(spark):
    """Trust runs along links, distrust against them; hosts that link to blocked ones are blocked."""
    link = lambda *hosts: "".join(f'<a class="x" HREF=\'//{h}/p\'>t</a><a href="/in">i</a>' for h in hosts)
    pages = [("bad.net", "/es/a", link()), ("bad.net", "/es/b", None), ("farm.org", "/1", link("bad.net")), ("far.org", "/1", link("farm.org", "unknown.org")),
             ("good.com", "/1", link("blog.org", "farm.org")), ("blog.org", "/1", link("Blog.ORG", "blog.org")), ("alone.org", "/1", "no links")]
    pages += [("hub.org", f"/{i}", link(f"h{i % 50}.org")) for i in range(200)] + [(f"h{i}.org", "/", link("hub.org")) for i in range(50)]
    df = spark.createDataFrame([(i, f"http://{h}{p}", t) for i, (h, p, t) in enumerate(pages)], "page_id long, url string, html string")
    hosts = {h for h, _, _ in pages}
    edges = sorted({(h, x.lower()) for h, _, t in pages for x in re.findall(r"'//([^/]+)/p'", t or "") if x.lower() != h and x.lower() in hosts})
    n = collections.Counter(h for h, _, _ in pages)
    bad, good = collections.Counter(), collections.Counter()
    for h, p, _ in pages:
        bad[h] += h.endswith(".net") and p.startswith("/es/")
        good[h] += h.endswith(".com")
    seed = lambda c: {h: c[h] * uf.SCALE // n[h] for h in hosts}
    trust, distrust = _propagate(seed(good), edges, uf.ROUNDS), _propagate(seed(bad), [(d, s) for s, d in edges], uf.ROUNDS)
    rows = uf.judge(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.trust, r.distrust) == (trust[r.host], distrust[r.host])
    verdict = {r.host: r.verdict for r in rows if r.rule is None}
    assert verdict["farm.org"] == "block" and verdict["blog.org"] == "allow" and verdict["far.org"] == "block"
    assert verdict["alone.org"] == verdict["hub.org"] == "allow"
    assert all((r.verdict == "block") == (r.distrust >= uf.MIN_DISTRUST and r.distrust > r.trust) for r in rows if r.rule is None)
