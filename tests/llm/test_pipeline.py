"""The pipeline on planted rows, and the queries' registration."""

import random

import __spark_entry__ as E
import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    r = random.Random(12)
    word = lambda: "".join(r.choice(["an", "ti", "or", "es", "lu", "ma", "ke"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    docs, labels, what = [], [], {}
    for i in range(360):
        t = "\n".join(text(40) for _ in range(3))
        kind = ("toxic", "clean", "clean", "junk", "line", "clean")[i % 6]
        if kind == "toxic":
            words = t.split(" ")
            for _ in range(5):
                words.insert(r.randrange(len(words)), "zork" + word())
            t = " ".join(words)
        elif kind == "junk":
            t = t.replace(" ", " ### ")
        elif kind == "line":
            t = "read more on our site\n" + t
        docs.append((i, t, "en", f"s{i % 23}", len(t)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
        what[i] = kind
    clean = [d for d in docs if what[d[0]] == "clean"][:20]
    for k, d in enumerate(clean):
        words = d[1].split(" ")
        if k % 2:
            words[50] = "changed"
        docs.append((1000 + k, " ".join(words), "en", "s1", 1))
        what[1000 + k] = "copy"
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    return docs, labels, what


def test_stages(spark, tmp_path):
    docs, labels, what = _rows()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality rules", "line dedup", "near duplicates", "packing"]
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert df.columns == [c.split()[0] for c in SCHEMA.split(", ")]
            kept.append({r.doc_id: r.text for r in df.collect()})
    left = {k: [i for i in kept[0] if what.get(i) == k] for k in ("toxic", "clean")}
    assert len(left["toxic"]) <= 3 and len(left["clean"]) >= 177
    assert not [i for i in kept[1] if what.get(i) == "junk"] and len([i for i in kept[1] if what.get(i) == "clean"]) == len(left["clean"])
    assert sum("read more" in t for t in kept[2].values()) == 1 and len(kept[2]) == len(kept[1])
    assert all(kept[2][i] == kept[1][i] for i in kept[1] if what[i] != "line")
    clean = {i: t for i, t in kept[1].items() if what[i] == "clean"}
    assert set(clean) <= set(kept[3]) and not [i for i in kept[3] if what[i] == "copy"]
    assert df.groupBy("doc_id").sum("length").count() == len(kept[3])


def test_passages_in_a_hot_source(spark):
    """A passage of over 50 words goes when it is on two sites, most copies in one; a shorter line on nine sites stays."""
    line = lambda k, n: " ".join(f"p{k}w{i}" for i in range(n))
    docs = [(i, f"own {i}\n{line(1, 51)}\n{line(2, 50)}", "en", "hot" if i < 90 else f"s{i % 8}", 1) for i in range(98)]
    kept = {r.doc_id: r.text for r in cp.drop_boilerplate(spark, spark.createDataFrame(docs, SCHEMA), "").collect()}
    assert kept == {d[0]: d[1] if d[0] == 0 else f"own {d[0]}\n{line(2, 50)}" for d in docs}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_oracles_are_sql():
    assert all(isinstance(v, str) for v in E.oracle_sql().values())
