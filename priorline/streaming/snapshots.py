"""Current-state feeds, captured forward in time: one folder a micro-batch, written once.

A feed that says what is so now has no time of its own: what was observed is dated to the batch that fetched it, never to
anything in its payload, so it can only be known from then on. A micro-batch asks its requests on the executors and
writes every answer, failures included, to the folder of its number. A batch that is run again after a crash finds its
folder complete and adds nothing, or incomplete and writes it anew; readers see complete folders alone.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.functions import values

COLUMNS = "source string, request string, status string, payload string, records long, detail string, observed_ts long, fingerprint string"
#: Statuses: fetched; the fetch failed; the source is switched off.
STATUSES = ("captured", "failed", "disabled")


def fetched(requests: DataFrame, fetch: Callable[[str, str], object], observed_ts: int, disabled: dict[str, str] | None = None) -> DataFrame:
    """Every request (source, request) with its answer or why there is none; one failure does not stop the others.

    ``fetch`` is called on the executors and returns what JSON can hold; records counts a list, or the list under ``data``.
    A source in ``disabled`` (name -> reason) is not asked. Null sources or requests are asked as empty texts.
    """
    off = disabled or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, request in zip(pdf["source"], pdf["request"], strict=True):
                if source in off:
                    out.append((source, request, STATUSES[2], None, 0, off[source]))
                    continue
                try:
                    answer = fetch(source, request)
                    data = answer.get("data") if isinstance(answer, dict) else answer
                    n = len(data) if isinstance(data, list) else len(answer) if isinstance(answer, list) else 0
                    out.append((source, request, STATUSES[0], json.dumps(answer, sort_keys=True), n, None))
                except Exception as e:  # noqa: BLE001 - whatever a source does is an outcome
                    out.append((source, request, STATUSES[1], None, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source", "request", "status", "payload", "records", "detail"], dtype=object)

    asked = requests.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "request")])
    rows = asked.mapInPandas(run, "source string, request string, status string, payload string, records long, detail string")
    return rows.withColumn("observed_ts", F.lit(observed_ts).cast("long")).withColumn("fingerprint", values.fingerprint(F.col("payload")))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def batch_writer(path: str, fetch: Callable[[str, str], object], now: Callable[[], float] = time.time, disabled: dict[str, str] | None = None):
    """A function for ``foreachBatch``: the batch's requests, asked once each, in the folder of its number."""

    def write(requests: DataFrame, batch_id: int) -> None:
        folder = f"{path.rstrip('/')}/batch={batch_id}"
        if _exists(requests.sparkSession, f"{folder}/_SUCCESS"):
            return  # done before a crash: asking again would date the same batch twice
        rows = fetched(requests.select("source", "request").distinct(), fetch, int(now()), disabled)
        rows.write.mode("overwrite").parquet(folder)

    return write


def capture(requests: DataFrame, path: str, checkpoint: str, fetch: Callable[[str, str], object], now: Callable[[], float] = time.time, disabled: dict[str, str] | None = None):
    """All there is of a stream of requests (source, request), captured; goes on from its checkpoint. Returns the ended query."""
    query = requests.writeStream.foreachBatch(batch_writer(path, fetch, now, disabled)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def captured(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the complete batches, with ``batch``; a batch that was cut off is not there yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    folders = sorted(f.getPath().getParent().toString() for f in found or [])
    empty = spark.createDataFrame([], f"{COLUMNS}, batch long")
    if not folders:
        return empty
    rows = spark.read.schema(COLUMNS).option("basePath", path).parquet(*folders)
    return rows.select(*empty.columns[:-1], F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long").alias("batch"))


def known_at(rows: DataFrame, anchor_ts) -> DataFrame:
    """Of each source and request the last capture at or before an instant, with its staleness; failures tell nothing."""
    from priorline.operators import asof

    latest = asof.latest_state(rows.where(F.col("status") == STATUSES[0]), ["source", "request"], "observed_ts", "batch", anchor_ts)
    return latest.withColumn("staleness", anchor_ts - F.col("observed_ts"))
