"""Stores: append-only snapshots, immutable files, request-keyed caches, and sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions import values


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_snapshots(captures: DataFrame, path: str) -> int:
    """Captures (source, retrieved_ts, request, payload) appended by day; an identical capture adds nothing. Rows added."""
    spark = captures.sparkSession
    own = captures.withColumn("fingerprint", values.fingerprint(F.col("payload"))).withColumn("day", F.floor(F.col("retrieved_ts") / values.DAY_SECONDS))
    keys = ["source", "retrieved_ts", "request", "fingerprint"]
    new = own.dropDuplicates(keys)
    have = _read(spark, path)
    if have is not None:
        # Only the sources and days that come in are read: both are folders.
        touched = have.select(*keys, "day").join(F.broadcast(new.select("source", "day").distinct()), ["source", "day"], "left_semi")
        new = new.join(touched.select(*keys), keys, "left_anti")
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").partitionBy("source", "day").parquet(path)
    new.unpersist()
    return n


def replay(spark: SparkSession, path: str, source: str, since: int, until: int) -> DataFrame:
    """A source's snapshots from ``since`` to ``until``, both inclusive; source and day prune the folders."""
    return spark.read.parquet(path).where((F.col("source") == source) & F.col("day").between(since // values.DAY_SECONDS, until // values.DAY_SECONDS) & F.col("retrieved_ts").between(since, until))


def archive(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with their digests; of one name with other bytes the oldest counts, later ones are conflicts."""
    from pyspark.sql import Window as W

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"), F.substring_index("path", "/", -1).alias("name"))
    first = F.first("sha256").over(W.partitionBy("name").orderBy("modificationTime", "path"))
    return rows.withColumn("conflict", F.col("sha256") != first)


def cached(spark: SparkSession, root: str, request: dict[str, str], make) -> tuple[DataFrame, bool]:
    """The table of exactly this request: read if complete, else made and written; whether it was read.

    A folder is named by the request's digest and holds the request beside its rows: what is there is used only if it is
    the same, key by key. The request is written last, so a table that was cut off is made anew.
    """
    text = json.dumps({str(k): str(v) for k, v in request.items()}, sort_keys=True)
    path = f"{root.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()}"
    held = _read(spark, f"{path}/request")
    if held is not None:
        if held.first()["request"] != text:
            raise ValueError(f"{path} holds the table of another request")
        return spark.read.parquet(f"{path}/rows"), True
    make().write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(text,)], "request string").coalesce(1).write.mode("overwrite").parquet(f"{path}/request")
    return spark.read.parquet(f"{path}/rows"), False


def in_order(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with each row's place in the input: ``file`` (by path) and ``ordinal``, its number in the file.

    The scan knows both, so no sort and no counter is needed, and they are the same at any split of the files.
    """
    rows = spark.read.parquet(*paths)
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("ordinal"))


def keep_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows ``in_order`` gives, the first of each key; equal keys, nulls too, are one. A key's rows never meet in one list."""
    place = F.struct("file", "ordinal")
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), place).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def write_table(df: DataFrame, path: str, csv: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet, and CSV with a header beside it on request."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
