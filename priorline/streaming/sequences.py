"""Streams of captures and ticks; form, as-of reads and plans with timers are in ``timed``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.streaming import timed
from priorline.streaming.timed import form_stream  # noqa: F401


def captures_once(captures: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of captures (``at`` timestamp, source, request, payload) without identical ones within the watermark."""
    own = captures.withColumn("fingerprint", F.sha2("payload", 256))
    return own.withWatermark("at", delay).dropDuplicatesWithinWatermark(["source", "request", "fingerprint"])


def candles(ticks: DataFrame, delay: str = "5 minutes") -> DataFrame:
    """Minute candles from a stream of ticks (``at`` timestamp, market, price); later than ``delay`` is dropped."""
    first, last = F.min_by("price", "at"), F.max_by("price", "at")
    out = ticks.withWatermark("at", delay).groupBy(F.window("at", "1 minute"), "market").agg(first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.count(F.lit(1)).alias("n"))
    return out.select("market", F.col("window.end").alias("end_ts"), "open", "high", "low", "close", "n")


def run_to_end(stream: DataFrame, checkpoint: str, sink: str) -> DataFrame:
    """All there is of a stream, into Parquet; started again, it goes on from its checkpoint."""
    return timed.run(stream, checkpoint, sink)[0]
