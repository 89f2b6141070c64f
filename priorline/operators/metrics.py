"""How good forecasts are: losses, ranking, calibration, paired resampling, segments."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from priorline.functions.values import clipped

BINS, SPARSE = 10, 30
RESAMPLES, SEED = 10_000, 20260820


def brier(y: Column, p: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), 2))


def log_loss(y: Column, p: Column) -> Column:
    q = clipped(p)
    return F.avg(-(F.when(y, F.log(q)).otherwise(F.log(1 - q))))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg(((p >= 0.5) == y).cast("double"))


def whole():
    """One frame over all rows: for tables of candidates or bins, never of data."""
    return W.partitionBy(F.lit(0))


def scores(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), brier(F.col(y), F.col(p)).alias("brier"), log_loss(F.col(y), F.col(p)).alias("log_loss"), accuracy(F.col(y), F.col(p)).alias("accuracy"))


#: Spans of probability within which ranks are counted apart.
RANK_SPANS = 4096


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mann-Whitney with tied ranks averaged; null where a class is absent.

    Counts by distinct probability come first. Their running total is made of two: over the spans of probability, which
    are few whatever the rows, and within each span, each in its own task.
    """
    levels = df.groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(y)).alias("_pos"))
    levels = levels.withColumn("_span", F.floor(F.col("_p") * RANK_SPANS))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = levels.groupBy("_span").agg(F.sum("_n").alias("_n")).select("_span", ahead(W.orderBy("_span")).alias("_below"))
    below = F.col("_below") + ahead(W.partitionBy("_span").orderBy("_p"))
    ranked = levels.join(F.broadcast(spans), "_span").select("_n", "_pos", (below + (F.col("_n") + 1) / 2).alias("_rank"))
    pos, neg = F.sum("_pos"), F.sum(F.col("_n") - F.col("_pos"))
    return ranked.agg(F.when((pos > 0) & (neg > 0), (F.sum(F.col("_rank") * F.col("_pos")) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def calibration(df: DataFrame, y: str, p: str) -> DataFrame:
    """Ten fixed bins, the last one closed; an empty bin has nulls, one of fewer than SPARSE rows is sparse."""
    spark = df.sparkSession
    edges = spark.createDataFrame([(i, i / BINS, (i + 1) / BINS) for i in range(BINS)], "bin int, low double, high double")
    # The bin is found on literal edges: floor(p * 10) would misplace values at them.
    at = F.lit(0)
    for i in range(1, BINS):
        at = F.when(F.col(p) >= i / BINS, i).otherwise(at)
    own = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))
    joined = F.broadcast(edges).join(own, "bin", "left")
    return joined.select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate", F.coalesce(F.col("n") < SPARSE, F.lit(False)).alias("sparse"))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def _poisson_lanes() -> np.ndarray:
    """Weight of each 16-bit number: quantiles of the Poisson distribution of mean 1."""
    heights = np.cumsum([1 / math.e / math.factorial(k) for k in range(12)])
    return np.searchsorted(heights, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


#: Differences of losses are added as whole numbers of this unit, so a sum is the same in any order.
UNIT = 2.0**-32


def paired_bootstrap(df: DataFrame, loss_a: str, loss_b: str, resamples: int = RESAMPLES, seed: int = SEED, chunk: int = 1000) -> DataFrame:
    """Mean difference of two losses (a - b) with a 95 percent interval of bootstrap means, and its verdict.

    How often a row is in a resample is a function of its ``key``, the resample's number and ``seed`` alone (a Poisson
    draw), so every task draws for its own rows and adds up whole numbers: the interval is the same at any partitioning.
    Keys are unique; rows with equal keys are drawn together. Rows without one of the losses are left out. A table
    without rows has n = 0 and nulls.
    """
    weights = _poisson_lanes()

    def run(batches):
        total = None
        for batch in batches:
            key = np.asarray(batch.column("k")).view(np.uint64)
            d = np.rint(np.asarray(batch.column("d")) / UNIT).astype(np.int64)
            own = np.zeros((2, resamples), object)
            for start in range(0, len(key), 256):
                k, part = key[start : start + 256, None], d[start : start + 256]
                for r in range(0, resamples, chunk):
                    n = min(chunk, resamples - r)
                    lanes = np.arange(r // 4, (r + n + 3) // 4, dtype=np.uint64)[None, :]
                    w = weights[_mixed(k ^ _mixed(lanes + np.uint64(1))).view(np.uint16).reshape(len(part), -1)[:, :n]].astype(np.int64)
                    own[0, r : r + n] += w.sum(axis=0)
                    own[1, r : r + n] += part @ w
            total = own if total is None else total + own
        if total is not None:
            high, low = total[1] >> 32, total[1] & 0xFFFFFFFF
            columns = [np.arange(resamples), *(x.astype(np.int64) for x in (total[0], high, low))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["resample", "w", "high", "low"])

    rows = df.select(F.xxhash64(F.lit(seed), F.col("key")).alias("k"), (F.col(loss_a) - F.col(loss_b)).cast("double").alias("d")).where("d is not null")
    sums = rows.mapInArrow(run, "resample long, w long, high long, low long").groupBy("resample").agg(*[F.sum(c).alias(c) for c in ("w", "high", "low")])
    drawn = (F.col("high") * 2.0**32 + F.col("low")) * UNIT / F.col("w")
    interval = sums.where("w > 0").select(drawn.alias("m")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("i"))
    units = F.sum(F.rint(F.col("d") / UNIT).cast("decimal(38,0)"))
    own = rows.agg(F.count(F.lit(1)).alias("n"), (units.cast("double") * UNIT / F.count(F.lit(1))).alias("difference"))
    low, high = F.col("i")[0], F.col("i")[1]
    verdict = F.when(low.isNull(), None).when(high < 0, "a_better").when(low > 0, "b_better").otherwise("inconclusive")
    return own.crossJoin(interval).select("n", "difference", low.alias("low"), high.alias("high"), verdict.alias("verdict"))  # one row by one


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_segments(df: DataFrame, segments: dict[str, Column]) -> DataFrame:
    """Each row once for every segment it is in, and once for ``all``."""
    flags = [F.lit("all"), *[F.when(cond, F.lit(name)) for name, cond in segments.items()]]
    return df.withColumn("segment", F.explode(F.array_compact(F.array(*flags))))


def tie_band(candidates: DataFrame, score: str, preference: list[Column], band: float = 1e-4, by: list[str] | None = None) -> DataFrame:
    """The preferred among the candidates within ``band`` of the best score (lowest)."""
    group = W.partitionBy(*(by or [F.lit(0)]))
    near = candidates.withColumn("_best", F.min(score).over(group)).where(F.col(score) - F.col("_best") <= band)
    return near.withColumn("_n", F.row_number().over(group.orderBy(*preference))).where("_n = 1").drop("_n", "_best")
