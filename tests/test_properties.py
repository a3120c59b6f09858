"""Property tests (hypothesis) on small generated inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import anomaly as AN
from quarry.operators import text_pages as TP


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=12), min_size=1, max_size=30))
def test_paging_loses_no_line(spark, lines):
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kept = [l.strip() for l in text.splitlines() if l.strip()]
    pages = [r.page for r in TP.scan_text_pages(docs).orderBy("page_no").collect()]
    assert len(pages) == (len(kept) + 7) // 8
    assert " ".join(pages) == " ".join(kept)


def test_forest_flags_planted_point(spark):
    rows = [(float(i % 17), float((i * 7) % 23)) for i in range(2000)] + [(1e6, -1e6)]
    df = spark.createDataFrame(rows, "a double, b double")
    scored = AN.iforest_scores(df, ["a", "b"], trees=50, psi=128, seed=7, keep=["a"])
    planted = scored.where("a = 1e6").first()._score
    higher = scored.where(F.col("_score") > planted).count()
    assert higher < 0.05 * 2001  # the planted point is among the flagged 5 %
    res = AN.anomaly_iforest(df, ["a", "b"], trees=50, psi=128, seed=7).first()
    assert abs(res.anomaly_rate - 5.0) < 0.5
