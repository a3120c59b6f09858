"""Host tables of the URL filter are dealt by their rows, not over the shuffle partitions, with the same scores."""

import pytest

from quarry.llm import url_filter as uf


def _pages():
    """Hosts h0..h11; each links to the next three, the first two are under a rule."""
    host = lambda i: ["a.com", "b.example.net"][i] if i < 2 else f"h{i}.org"
    links = lambda i: "".join(f'<a href="http://{host((i + k) % 12)}/x">x</a>' for k in (1, 2, 3))
    return [(i, f"http://{host(i)}/{'fr' if i == 1 else 'p'}/x", links(i)) for i in range(12)]


@pytest.fixture
def scores(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield lambda: uf.host_scores(spark.createDataFrame(_pages(), "page_id long, url string, html string").repartition(6))
    spark.conf.set(key, before)


def test_few_hosts_stay_in_one_partition(scores):
    assert scores().rdd.getNumPartitions() == 1


def test_scores_do_not_depend_on_partitions(scores, monkeypatch):
    one = sorted(tuple(r) for r in scores().collect())
    assert len(one) == 12 and all(t > 0 and d > 0 for _, t, d in one)
    monkeypatch.setattr(uf, "ROWS", 4)
    assert sorted(tuple(r) for r in scores().collect()) == one
