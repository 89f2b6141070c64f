"""What the operators of this subpackage share: written tables, word splitting and hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from contextlib import contextmanager
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks, the separators of every word definition here.
BLANK = re.compile(rb"[\x20\x09-\x0d]")

_written: list[tuple[SparkSession, str]] = []


_remembered: dict = {}


def remembered(key, make):
    """What a worker process keeps between tasks: one operator's memory at a time, so they don't add up."""
    if key not in _remembered:
        forget()
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Empty a worker's memory, for operators that keep none and need room, and give it back to the system."""
    _remembered.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside an executor whose heap is full."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


#: Most rows of a table of texts that go to Python at once.
TEXT_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most TEXT_ROWS rows from now on in this session: at the default, a batch of texts takes tens of megabytes on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, a temporary one on a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='priorline-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/priorline-{kind}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            continue


def durable(df: DataFrame, kind: str = "table", sums: Column | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, which cuts its lineage and outlives executors.

    Its rows are counted while they are written, and ``sums`` aggregated: no query of their own.
    """
    spark = df.sparkSession
    path = scratch(spark, kind)
    seen = Observation()
    also = [] if sums is None else [sums.alias("sums")]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *also).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._pl_path, back._pl_seen = path, seen.get
    return back


def collected(spark: SparkSession) -> None:
    """Collect garbage before a stage that needs room beside what has run so far.

    On the driver, shuffle files and broadcasts go only once nothing in its memory refers to them. On the executors, heaps
    that earlier stages have filled stay at their largest until a collection gives them back, and Python workers stand
    beside them; a task a core asks for one, half a second each.
    """
    trim()
    spark.sparkContext._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    asked = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("asked"))
    asked.write.format("noop").mode("overwrite").save()


def rows_of(df: DataFrame) -> int:
    """How many rows a table has; known of a ``durable`` one."""
    seen = getattr(df, "_pl_seen", None) or {}
    return seen["rows"] if "rows" in seen else df.count()


def seen_in(df: DataFrame):
    """What ``durable`` aggregated of a table, None of an empty one."""
    return (getattr(df, "_pl_seen", None) or {}).get("sums")


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Plans run within send at most so many rows at once to Python: for rows of many kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(df: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``df``, once nothing reads it any more."""
    delete(df.sparkSession, df._pl_path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; whatever else the table holds cannot clash with its own names."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def passages(text: bytes, size: int = 1 << 20):
    """``text`` cut at blanks into parts of about ``size`` bytes, so that splitting one very long text stays small."""
    at = 0
    while len(text) - at > size:
        found = BLANK.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Overlaps:
    """Whether a span meets any of many, by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


class Inside:
    """Whether a span lies within one of many, by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_right(self.starts, start)
        return before > 0 and self.ends[before - 1] >= end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
