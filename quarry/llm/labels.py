"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, size: int, folds: int) -> DataFrame:
    """At most ``size`` training documents of each label 0 and 1, by the smallest id hashes: doc_id, label, text.

    An id that repeats counts once, with the text of the smallest hash; repeats are dropped inside each task.
    """
    rows = (labels.select("doc_id", F.col(label_col).cast("int").alias("label"))
            .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != 0))
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    pick = lambda k: rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    chosen = pick(0).unionByName(pick(1))  # at most 2 * size rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("doc_id", "label", "x.text")
