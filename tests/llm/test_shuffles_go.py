"""Files and tasks of the near-duplicate operator: they follow the data, not the number of shuffle partitions."""

import glob
import os
import time

from pyspark.sql import functions as F

from quarry.llm.common import checkpointed
from quarry.llm.components import components

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in store.localDirs() for f in glob.glob(os.path.join(d.getPath(), "*", "shuffle_*"))}


def test_checkpoint_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(KEY, None)
    df = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    kept = checkpointed(df)
    until = time.time() + 20  # files are removed in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(KEY, None) == setting
    assert dict(kept.collect()) == dict(df.collect()) == {k: sum(range(k, 1000, 7)) for k in range(7)}


def test_components_of_few_edges_stay_in_few_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    chain = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b")).filter("a % 100 <> 0")
    try:
        out = components(chain.repartition(32))
        assert out.rdd.getNumPartitions() <= 1 + int(spark.conf.get("spark.sql.shuffle.partitions"))  # edges, and their distinct ends
    finally:
        spark.conf.set(key, before)
    assert {r.node: r.component for r in out.collect()} == {i: i // 100 * 100 for i in range(301) if i != 300}


def test_components_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.components.EDGES", 10)
    pairs = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 100), (200, 200), (300, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in [*range(61), *range(100, 140)]}
