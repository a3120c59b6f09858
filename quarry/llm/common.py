"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizers' files lie unless a caller names another folder.
TOKENIZER_DIR = "/opt/tokenizers"

#: The white space that separates words (fixed by the contracts of the operators).
SPACE = r"\x20\x09-\x0D"

#: Whether a plan's shuffle files are removed at the end of its execution.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master (tests: one machine) may go without the setting; on a
    cluster a local folder would lose files, so its absence is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="quarry-llm-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """Plans made in here drop their shuffle files when their job ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # select: a plan of its own, which nothing else runs again


def stored(df: DataFrame) -> DataFrame:
    """The same as a compressed table in the shared folder, for wide rows."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with _shuffles_go(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):  # else the package came from such an archive itself
        archive = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry_code.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(top)))
        sc.addPyFile(archive)
    sc._quarry_shipped = True


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` by a function of this package; its worker lets go of what another operator held when a task begins
    and gives freed memory back when it ends."""
    ship(df.sparkSession)
    owner = run.__module__

    def task(batches):
        let_go(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory of a Python worker, which lives on between tasks, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fold_of(doc_id: Column, folds: int) -> Column:
    """``crc32(doc_id as text) mod folds``; a null id falls in fold 1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column of an Arrow batch as UTF-8 bytes; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())  # bytes stay where they are
    return [x if x is not None else b"" for x in column.to_pylist()]


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain reference inside a lambda would be evaluated again for every
    element; as the single element of an array it is bound to a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


class Memo(dict):
    """A bounded memo of ``make(key)`` for keys that repeat (words).

    Two generations: when the young one is full it becomes the old one, and
    keys still in use move back on their next use.  Only speed depends on it.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_HELD: dict = {}
_OWNER: list[str] = []  # the module whose task began last


def held(key, make):
    """What ``make`` builds, kept in a Python worker from task to task; another operator's lets go of it."""
    if key not in _HELD:
        _drop()
        _HELD[key] = make()
    return _HELD[key]


def _drop() -> None:
    if _HELD:
        _HELD.clear()
        gc.collect()  # a memo refers to its maker and that to the memo: counting references frees neither
        give_back()


def let_go(owner: str) -> None:
    """Free what a Python worker holds for a module other than ``owner``, before its task reads a row."""
    if _OWNER != [owner]:
        _OWNER[:] = [owner]
        _drop()


def slices(batches, most: int = 4 << 20, column: str = "text"):
    """Arrow batches cut into parts of about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


WORDS_AT_ONCE = 4096  # new words whose values are worked out together


class Words:
    """Numbers words and keeps one row of values per word (bounded; starts anew when full)."""

    def __init__(self, limit: int, width: int, rows):
        self.limit, self.rows, self.width = limit, rows, width
        self.clear()

    def clear(self) -> None:
        self.index, self.table = {}, np.zeros((1024, self.width), np.float32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.limit:
            self.clear()
        index = self.index
        new = list(set(words) - index.keys())
        if new:
            start = len(index)
            index.update(zip(new, range(start, start + len(new))))
            if len(index) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(index), 2 * len(self.table)) - len(self.table), self.width), np.float32)])
            for i in range(0, len(new), WORDS_AT_ONCE):
                part = new[i:i + WORDS_AT_ONCE]
                self.table[start + i:start + i + len(part)] = self.rows(part)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))
