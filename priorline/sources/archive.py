"""A content-addressed archive that tasks write to without locks.

Bytes are stored under their sha256, and each name has a small record for every digest it was seen with. What a path holds
follows from its name, so writers that race, tasks that run again and whole re-runs leave the same files: an object is
written under a draft name and moved in place, and one that is there is left alone. A name seen with other bytes keeps
both versions; the one retrieved first counts, later ones are conflicts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = "name string, sha256 string, bytes long, retrieved_ts long"


def _put(store: fs.FileSystem, path: str, body: bytes) -> bool:
    """Whether the file was written; one that is there is not touched."""
    if store.get_file_info(path).type != fs.FileType.NotFound:
        return False
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(body)
    store.move(draft, path)
    return True


def put(files: DataFrame, root: str) -> DataFrame:
    """Write ``files`` (name, content binary, retrieved_ts) on the executors; name, sha256 and whether the bytes were new.

    Rows without a name or content are left out. The rows are the writes: run the result once, and count or write it.
    """

    def run(batches):
        store, place = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for name, content, ts in zip(*(batch.column(c).to_pylist() for c in ("name", "content", "retrieved_ts")), strict=True):
                digest = hashlib.sha256(content).hexdigest()
                new = _put(store, f"{place}/objects/{digest[:2]}/{digest}", content)
                key = hashlib.sha256(name.encode()).hexdigest()
                record = {"name": name, "sha256": digest, "bytes": len(content), "retrieved_ts": ts}
                _put(store, f"{place}/names/{key[:2]}/{key}-{digest}.json", json.dumps(record).encode())
                out.append((name, digest, new))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["name", "sha256", "new"])

    rows = files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"), F.col("retrieved_ts").cast("long").alias("retrieved_ts"))
    return rows.dropna().mapInArrow(run, "name string, sha256 string, new boolean")


def scan(spark: SparkSession, root: str, conflicts: bool = True) -> DataFrame:
    """Every version of every name, with ``conflict`` where other bytes were retrieved earlier; without them on request.

    Of versions retrieved at one instant the one with the smallest digest counts.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/names")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        rows = spark.createDataFrame([], RECORD)
    else:
        rows = spark.read.schema(RECORD).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{root}/names")
    place = F.row_number().over(W.partitionBy("name").orderBy("retrieved_ts", "sha256"))
    rows = rows.withColumn("conflict", place > 1)
    return rows if conflicts else rows.where(~F.col("conflict"))


def contents(spark: SparkSession, root: str, versions: DataFrame) -> DataFrame:
    """``versions`` with their bytes, each checked against its digest: one that is missing or not what its name says fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/objects")
    named = files.select(F.regexp_extract("path", "([0-9a-f]{64})$", 1).alias("sha256"), "content")
    # The scan passes over files without bytes.
    content = F.coalesce("content", F.when(F.col("bytes") == 0, F.lit(b"")))
    sound = F.when(F.sha2("content", 256) == F.col("sha256"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("damaged or missing object "), "sha256")).cast("boolean"))
    return versions.join(named, "sha256", "left").withColumn("content", content).where(sound)
