"""Centroid clustering in whole numbers by a tournament of bisectors.

Vectors are quantised once, component x to floor(``scale`` * x), and written. For every two centroids a < b the bisector
is linear in whole numbers: x is nearer to b exactly where x . (b - a) > (|b|^2 - |a|^2) / 2, so a normal and a floored
threshold are computed in advance for each pair. A vector meets the centroids in rising order: the winner so far against
the next one is one sign test, k - 1 in all, and zero favours the smaller number. Only the last winner's distance is
computed, exactly. A round is one pass over the written vectors: each task adds up count and components for each
centroid, Spark adds those few rows, and the new centroids, k * d numbers, are all that the driver sees.

Kept are vectors of exactly ``size`` components, none null or non-finite; others are left out. Starts are the kept
vectors with the smallest sha256 of ``2:<id>``, ties (repeated ids) by their components; where fewer than k are kept,
each of them is one. A null id starts no centroid but is clustered, unless
no vector has an id: then no rows come back, as from an empty table. Rows are clustered one by one, so repeated rows come
back as often as they are given. Components beyond +-2**26 go through Python's whole numbers; distances and sums that are
no 64-bit number come back as null. A centroid without vectors stays where it is.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorline.llm.common import durable, release

#: Largest component for which 64-bit sums over a vector cannot overflow, up to 256 components.
PLAIN = 1 << 26
#: Rows that are tested together, and most numbers in a table of normals; beyond, a centroid's are made as it is met.
ROWS, TABLE = 4096, 1 << 24
WIDE = T.DecimalType(38, 0)


class Bisectors:
    """Centroids as whole numbers, and normal and threshold of every two of them."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.norms = (centroids * centroids).sum(axis=1)
        k, size = centroids.shape
        self.table = [self._against(b) for b in range(k)] if k * k * size <= 2 * TABLE else None

    def _against(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For each a < b: b - a, and the floor of half of |b|^2 - |a|^2."""
        return self.centroids[b] - self.centroids[:b], (self.norms[b] - self.norms[:b]) // 2

    def winners(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row, the smaller number among equals."""
        best = np.zeros(len(x), np.int64)
        for b in range(1, len(self.centroids)):
            normals, thresholds = self.table[b] if self.table else self._against(b)
            for a in np.unique(best):  # rows with the same winner so far share one bisector
                rows = np.flatnonzero(best == a)
                best[rows[x[rows] @ normals[a] > thresholds[a]]] = b
        return best

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and exact squared distance of each row."""
        best = self.winners(x)
        apart = x - self.centroids[best]
        return best, (apart * apart).sum(axis=1)


def _assigner(centroids: list[list[int]]):
    """Blocks of a batch with their clusters and distances: in 64 bits where all fit, else in Python's whole numbers."""
    size = len(centroids[0])
    wide = Bisectors(np.array(centroids, dtype=object))
    plain = Bisectors(np.array(centroids, np.int64)) if max(abs(v) for c in centroids for v in c) <= PLAIN else None

    def run(batch: pa.RecordBatch):
        column = batch.column("components")
        for start in range(0, batch.num_rows, ROWS):
            x = np.floor(np.asarray(column.slice(start, ROWS).flatten()).reshape(-1, size))
            if plain and np.abs(x).max(initial=0) <= PLAIN:
                x = x.astype(np.int64)
                yield start, x, *plain.assigned(x)
            else:
                x = np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
                yield start, x, *wide.assigned(x)

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and components (scale * x as doubles; readers take their floor) of the vectors that are kept."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double") * F.lit(float(scale)))
    finite = F.forall("components", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).alias("vec_id"), x.alias("components")).where((F.size("components") == size) & finite)


def starts(kept: DataFrame, k: int, salt: str = "2") -> list[list[int]]:
    """The first centroids: k kept vectors in rising order of sha256 of ``salt:id``."""
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "components")
    first = hashed.where("h is not null").orderBy("h", "components").limit(k).collect()
    return [[math.floor(v) for v in r.components] for r in first]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's vectors' componentwise floor of the mean; one without vectors as it was.

    A task sends one row for each component of each centroid it met, its sum as high * 2**64 + low; place -1 counts.
    """
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("high", WIDE), T.StructField("low", WIDE)])

    def run(batches):
        assign, sums = _assigner(centroids), {}
        for batch in batches:
            for _, x, best, _ in assign(batch):
                for c in np.unique(best).tolist():
                    mine = x[best == c]
                    total = np.append(mine.sum(axis=0).astype(object), len(mine))
                    sums[c] = sums[c] + total if c in sums else total
        size = len(centroids[0])
        for c, total in sums.items():
            number = pa.decimal128(38, 0)
            parts = [divmod(int(v), 1 << 64) for v in total]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * (size + 1), pa.int32()), pa.array([*range(size), -1], pa.int32()), pa.array([Decimal(h) for h, _ in parts], number), pa.array([Decimal(low) for _, low in parts], number)],
                names=["cluster", "place", "high", "low"],
            )

    sums = kept.select("components").mapInArrow(run, schema).groupBy("cluster", "place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    total = {(r.cluster, r.place): (int(r.high) << 64) + int(r.low) for r in sums.collect()}
    return [[total[c, i] // total[c, -1] for i in range(len(own))] if (c, -1) in total else own for c, own in enumerate(centroids)]


def assigned(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance (squared; null where it is no 64-bit number) of every kept vector."""
    schema = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        assign = _assigner(centroids)
        for batch in batches:
            for start, x, best, distance in assign(batch):
                fits = [d if d < 1 << 63 else None for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(start, len(x)), pa.array(best, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, schema)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of whole numbers in decimal) of every kept vector."""
    spark = vectors.sparkSession
    kept = durable(quantised(vectors, id_col, vector_col, size, scale), "vectors")
    centroids = starts(kept, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(kept, centroids)
    # Without centroids no row is left that has an id; rows with null ids alone have nothing to be near to.
    of_each = durable(assigned(kept, centroids) if centroids else kept.selectExpr("vec_id", "cast(0 as int) as cluster", "0L as distance").limit(0), "assigned")
    release(kept)
    sums = of_each.groupBy("cluster").agg(F.sum(F.col("distance").cast(WIDE)).alias("total"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    inertia = {r.cluster: None if r.beyond else int(r.total) for r in sums.collect()}  # k rows
    whole = None if None in inertia.values() else sum(inertia.values())
    long = lambda v: v if v is not None and v < 1 << 63 else None
    rows = [(c, long(v), long(whole), [str(x) for x in centroids[c]]) for c, v in inertia.items()]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<string>")
    return of_each.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
