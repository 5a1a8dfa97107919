"""Centroid clustering in whole numbers, with block-norm screening.

Vectors become integers once and are written with the norms of their segments. A segment's product of vector and
centroid is at most the product of its norms (Cauchy-Schwarz), so the squared distance of the compressed vectors (the
norms) is a lower bound of the true one. Each round is one pass: a compressed matrix product bounds every centroid from
below, the centroid of the least bound is measured, and only centroids whose bound does not exceed the best distance so
far receive exact integer distances. Tasks send sums of their vectors by centroid, so what meets is bounded by the
number of tasks, centroids and components; centroids (k times length integers) go to the tasks with the code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteloom.llm.common import table, written

#: Components of a vector, integers a unit, number of centroids, rounds, components of a segment, prefix of the hash
#: that chooses the first centroids.
LENGTH, SCALE, CENTROIDS, ROUNDS, SEGMENT, START = 64, 1024, 8, 10, 8, "3:"
#: Integers beyond this count as it (components of 2^42 and more at the scale above).
LARGEST = 1 << 52
_LONG = (1 << 63) - 1


def whole_numbers(x: Column, scale: int, largest: int = LARGEST) -> Column:
    """floor(scale * v) of each v of an array of doubles, within +-largest."""
    return F.transform(x, lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(float(largest))), F.lit(-float(largest)))).cast("long"))


def all_finite(x: Column) -> Column:
    """Whether an array of doubles is there and holds neither null nor non-finite numbers."""
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Euclidean norms of the segments of each row (the last segment may be shorter)."""
    return np.sqrt(np.add.reduceat(x.astype(float) ** 2, np.arange(0, x.shape[1], segment), axis=1))


def exact_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, exact: machine integers where they hold, else Python's."""
    most = max((int(np.abs(a).max(initial=0)) for a in (x, c)), default=0)
    if x.shape[-1] * (2 * most) ** 2 > _LONG:
        x, c = x.astype(object), c.astype(object)
    gap = x - c
    return (gap * gap).sum(1)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the smaller number among equals) and squared distance of each row, and the number of exact
    distances it took."""
    compressed = segment_norms(centroids, segment)
    squares = (norms * norms).sum(1)[:, None] + (compressed * compressed).sum(1)[None, :]
    # Rounding moves a bound by far less than this share of its terms.
    lower = (squares - 2 * norms @ compressed.T) - 1e-12 * squares - 1.0
    label = lower.argmin(1)
    best = exact_distances(x, centroids[label])
    first, measured = label.copy(), len(x)
    for j in range(len(centroids)):
        open_ = np.flatnonzero((lower[:, j] <= best.astype(float) * (1 + 1e-12)) & (first != j))
        measured += len(open_)
        d = exact_distances(x[open_], centroids[j][None, :])
        better = (d < best[open_]) | ((d == best[open_]) & (j < label[open_]))
        label[open_[better]] = j
        best[open_[better]] = d[better]
    return label, best, measured


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums over rows as Python's integers."""
    if len(x) * int(np.abs(x).max(initial=0)) > _LONG:
        x = x.astype(object)
    return np.asarray(x.sum(0)).astype(object)


def _totals(points: DataFrame, centroids: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, summed distance and componentwise sum of the vectors of each centroid."""
    k, width = centroids.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 2), dtype=object)
        for batch in batches:
            x = matrix(batch.column(0), width)
            label, best, _ = nearest(x, matrix(batch.column(1), -(-width // segment)), centroids, segment)
            for j in np.unique(label):
                own = label == j
                total[j] += np.concatenate([[int(own.sum())], [int(_exact_sum(best[own]))], _exact_sum(x[own])])
        some = [j for j in range(k) if total[j, 0]]
        if some:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([[Decimal(int(v)) for v in total[j]] for j in some], pa.list_(kind))], ["cluster", "totals"])

    sums = points.select("x", "norms").mapInArrow(summed, "cluster int, totals array<decimal(38,0)>")
    rows = sums.select("cluster", F.posexplode("totals").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("v").alias("v")).collect()
    found = np.zeros((k, width + 2), dtype=object)
    for r in rows:
        found[r["cluster"], r["at"]] = int(r["v"])
    return found[:, 0], found[:, 1], found[:, 2:]


def clustered(
    vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", length: int = LENGTH, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, segment: int = SEGMENT, start: str = START
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, and centroid (array of long) of each vector that is kept.

    Kept are vectors of exactly `length` components, none null or non-finite. Centroids start as the kept vectors with
    the smallest sha256 of start and vec_id; a null vec_id comes last there, and rows of one vec_id stand in the order
    of their components. With fewer kept vectors than centroids there are as many centroids as vectors; equal ones stay
    empty but for the first. Repeated rows count each. Distances and inertias beyond a long are the largest long,
    integers beyond 2^52 count as it. An empty table gives an empty one; other columns are left out.
    """
    x = F.col(embedding).cast("array<double>")
    fine = F.when(x.isNotNull() & (F.size(x) == length), x)
    body = vectors.select(F.col(id).cast("long").alias("vec_id"), fine.alias("x")).where(all_finite(F.col("x"))).select("vec_id", whole_numbers(F.col("x"), scale).alias("x"))

    def normed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = segment_norms(matrix(batch.column(1), length), segment)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(norms.ravel()), norms.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], ["vec_id", "x", "norms"])

    points = written(body.mapInArrow(normed, "vec_id long, x array<long>, norms array<double>"))
    place = F.sha2(F.concat(F.lit(start), F.col("vec_id").cast("string")), 256)
    chosen = points.select("x", place.alias("place")).orderBy(F.asc_nulls_last("place"), "x").limit(centroids).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not chosen:
        return vectors.sparkSession.createDataFrame([], schema)
    now = np.array([r["x"] for r in chosen], dtype=np.int64)
    for _ in range(rounds):
        count, _, sums = _totals(points, now, segment)
        moved = np.array([[int(s) // int(n) for s in row] if n else old.tolist() for n, row, old in zip(count, sums, now, strict=True)], dtype=np.int64)
        if (moved == now).all():
            break  # every further round would give the same
        now = moved
    _, inertias, _ = _totals(points, now, segment)
    by_cluster = np.array([min(int(v), _LONG) for v in inertias], dtype=np.int64)
    total = min(int(sum(inertias)), _LONG)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = pa.array(now.tolist(), pa.list_(pa.int64()))
        for batch in batches:
            label, best, _ = nearest(matrix(batch.column(1), length), matrix(batch.column(2), -(-length // segment)), now, segment)
            distance = np.minimum(best, _LONG).astype(np.int64)
            made = [pa.array(label, pa.int32()), pa.array(distance), pa.array(by_cluster[label]), pa.array(np.full(len(label), total)), final.take(pa.array(label))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return points.select("vec_id", "x", "norms").mapInArrow(assigned, schema)


def centroid_text(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance, inertias and the centroid's digest of every kept vector of embeddings."""
    found = clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
