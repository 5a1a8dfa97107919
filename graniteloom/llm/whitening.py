"""Whitening by principal components, with cyclic Jacobi rotations on the driver.

Vectors become integers. Each distinct one is fitted once: a first pass sums components, a second one sums products of
the integers less the rounded mean, both exactly, so the centred scatter does not depend on how rows are dealt out, and
no digit is lost to a mean far from 0. The driver holds one symmetric matrix (length squared numbers) and turns it by
Jacobi rotations, each sweep meeting every pair once, until every off-diagonal entry vanishes against its two diagonal
ones: so small eigenvalues are as accurate as large ones. Sorted components over the roots of their eigenvalues are the
whitening matrix, which goes to the tasks with the code. A third pass over the fit list measures what whitening gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniteloom.llm.clustering import all_finite, matrix, whole_numbers
from graniteloom.llm.common import fields_of, kept, row_of, table, written

SCALE, COMPONENTS = 256, 4
#: Sweeps of rotations at most; ten are usual.
SWEEPS = 60
_EXACT = pa.decimal128(38, 0)


@dataclass
class Model:
    """Whitening of vectors of one length: n vectors with the sums S, centre = round(S / n) and rest = S - n * centre as
    integers, the components (columns) with their eigenvalues and shares, and the error that whitening leaves."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the roots of the eigenvalues; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(self.values > 0, self.vectors / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return ((x - self.centre) - self.rest / self.n) @ scaled

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of (n x - S)^2 of each row, and whether a long holds it. Machine integers wrap, so a sum that fits is exact
        whatever its terms were."""
        y = x - self.centre
        with np.errstate(over="ignore"):
            gap = y * np.int64(self.n) - self.rest
            exact = (gap * gap).sum(1)
        rough = ((y.astype(float) * self.n - self.rest.astype(float)) ** 2).sum(1)
        return exact, rough < 2.0**63 * (1 - 1e-9)


def jacobi(a: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix, eigenvalues falling.

    A sweep goes through a round-robin of disjoint pairs, so that a whole round of rotations is one matrix operation. A
    column's sign is such that its largest entry (the first of equals) is positive.
    """
    a, d = np.array(a, dtype=float), len(a)
    v, tiny = np.eye(d), np.finfo(float).eps
    seats = list(range(d)) + [-1] * (d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            pairs = [(min(i, j), max(i, j)) for i, j in zip(seats[: len(seats) // 2], reversed(seats[len(seats) // 2 :]), strict=True) if i >= 0 and j >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array(pairs, dtype=int).reshape(-1, 2).T
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            open_ = np.abs(apq) > tiny * np.sqrt(np.abs(app) * np.abs(aqq))
            if not open_.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[open_], q[open_], app[open_], aqq[open_], apq[open_]
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            up, low = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * up - s[:, None] * low, s[:, None] * up + c[:, None] * low
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    signs = np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0) if d else np.ones(0)
    return np.diag(a)[order], v * signs


def scatter(y: np.ndarray) -> np.ndarray:
    """Sums of products of the columns of integers, exact, as Python's integers."""
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    most = int(np.abs(y).max(initial=0))
    if most >= 1 << 20:
        wide = y.astype(object)
        return wide.T @ wide if len(y) else out
    for at in range(0, len(y), 4096):  # sums below 2^52 are exact in doubles
        part = y[at : at + 4096].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _by_length(lengths: pa.Array) -> list[tuple[int, np.ndarray]]:
    """Rows of each length in a batch."""
    sizes = lengths.to_numpy(zero_copy_only=False)
    return [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]


def _summed(fit: DataFrame, one_batch, kind: pa.DataType, sql: str) -> dict[int, dict[int, object]]:
    """By length of vectors, the sums over all batches of the numbers that one_batch(length, x) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, rows in _by_length(pa.compute.list_value_length(batch.column(0))):
                made = one_batch(d, matrix(batch.column(0).take(pa.array(rows)), d))
                totals[d] = totals[d] + made if d in totals else made
        as_kind = (lambda v: Decimal(int(v))) if kind is _EXACT else float
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([[as_kind(v) for v in a] for a in totals.values()], pa.list_(kind))], ["d", "totals"])

    parts = fit.select("x").mapInArrow(run, f"d int, totals array<{sql}>")
    found: dict[int, dict[int, object]] = {}
    for r in parts.select("d", F.posexplode("totals").alias("at", "v")).groupBy("d", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r["d"], {})[r["at"]] = int(r["v"]) if kind is _EXACT else r["v"]
    return found


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length of vectors in distinct (x array<long>). What the driver holds grows with the square of
    the lengths, not with the rows."""

    def sums(d: int, x: np.ndarray) -> np.ndarray:
        small = d == 0 or len(x) * int(np.abs(x).max(initial=0)) < 1 << 62
        return np.concatenate([[len(x)], (x if small else x.astype(object)).sum(0)]).astype(object)

    first = {d: [got[i] for i in range(d + 1)] for d, got in _summed(distinct, sums, _EXACT, "decimal(38,0)").items() if d > 0}
    centres = {d: np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64) for d, (n, *total) in first.items()}
    if not first:
        return {}

    def products(d: int, x: np.ndarray) -> np.ndarray:
        return scatter(x - centres[d])[np.triu_indices(d)] if d else np.zeros(1, dtype=object)

    models: dict[int, Model] = {}
    for d, got in _summed(distinct.where(F.size("x") > 0), products, _EXACT, "decimal(38,0)").items():
        n, *total = first[d]
        rest = [s - n * int(c) for s, c in zip(total, centres[d], strict=True)]
        covariance = np.zeros((d, d))
        for at, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
            covariance[i, j] = covariance[j, i] = (n * got[at] - rest[i] * rest[j]) / (n * n)
        values, vectors = jacobi(covariance)
        trace = float(np.trace(covariance))
        values = np.where(values > d * np.finfo(float).eps * values.max(initial=0.0), values, 0.0)
        shares = values / trace if trace > 0 else np.zeros(d)
        m = min(components, d)
        models[d] = Model(n, centres[d], np.array(rest, dtype=np.int64), vectors[:, :m], values[:m], shares[:m])

    def second_moments(d: int, x: np.ndarray) -> np.ndarray:
        z = np.nan_to_num(models[d].whiten(x), nan=0.0)
        return (z.T @ z).ravel()

    for d, got in _summed(distinct.where(F.size("x") > 0), second_moments, pa.float64(), "double").items():
        model, m = models[d], len(models[d].values)
        some = model.values > 0
        error = np.abs(np.array([got[i] for i in range(m * m)]).reshape(m, m) / model.n - np.eye(m))[np.ix_(some, some)]
        model.identity_error = float(error.max()) if some.any() else None
    return models


def whitened(vectors: DataFrame, keep: list[str], *, embedding: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """keep, n, deviation, identity_error, whitened and explained (arrays by component) of each vector that remains.

    Vectors that are null or hold null or non-finite entries are left out. Vectors of each length have a fit of their
    own; empty vectors have no components. Repeated rows and equal vectors are fitted once and returned each. Components
    without variance have null in whitened and 0 in explained; identity_error is over the others, null if there are
    none. A deviation that a long can't hold is null. Integers beyond 2^52 count as it. An empty table gives an empty
    one. A column of keep with the name of a result gives way to it.
    """
    made = ["n", "deviation", "identity_error", "whitened", "explained"]
    stay = kept(keep, *made)
    x: Column = F.col(embedding).cast("array<double>")
    body = vectors.where(all_finite(x)).select(row_of(stay).alias("row"), whole_numbers(x, scale).alias("x"))
    models = fit(written(body.select("x").distinct()), components)
    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.ArrayType(T.DoubleType()), T.ArrayType(T.DoubleType()))
    schema = T.StructType([body.schema["row"], *(T.StructField(c, t) for c, t in zip(made, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in _by_length(pa.compute.list_value_length(batch.column(1))):
                given = batch.take(pa.array(rows))
                size = len(rows)
                if d == 0:
                    nothing = [pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.float64()), *([pa.array([[]] * size, pa.list_(pa.float64()))] * 2)]
                    yield pa.RecordBatch.from_arrays([given.column(0), *nothing], schema.names)
                    continue
                model, ints = models[d], matrix(given.column(1), d)
                z, (deviation, fits) = model.whiten(ints), model.deviations(ints)
                m = z.shape[1]
                offsets = pa.array(np.arange(0, size * m + 1, m, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat))) for flat in (z.ravel(), np.tile(model.explained, size))]
                error = pa.array([model.identity_error] * size, pa.float64())
                yield pa.RecordBatch.from_arrays([given.column(0), pa.array(np.full(size, model.n)), pa.array(deviation, mask=~fits), error, *lists], schema.names)

    return body.mapInArrow(run, schema).select(*fields_of("row", stay), *made)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector of embeddings that remains."""
    found = whitened(table(spark, sf_dir, "embeddings"), ["vec_id"])
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    each = found.select("vec_id", "n", "deviation", "identity_error", parts)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), "identity_error")
