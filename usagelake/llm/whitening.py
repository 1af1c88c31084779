"""Embedding whitening by streamed moments and a symmetric QR eigen-solve.

Each task runs once over its vectors and updates the mean and the matrix of centred products by a rank-one step for each
(Welford). Tasks' moments are merged by the parallel formula, first in as many tasks as MERGERS, in the order of their
task numbers, then in one, which reads MERGERS rows of one matrix each: what is held anywhere depends on the dimension,
never on the number of vectors. The driver gets one matrix, reduces it to three diagonals by reflections and
diagonalizes these by implicit QR steps; the projection goes back to the tasks with their code.

Vectors are whitened as whole numbers, floor(scale * c) + shift, so their sums are exact. How far the result's covariance
is from the identity is measured on the result, by the same moments in a pass of its own.

Defined cases: vectors that are null or empty or hold null or non-finite entries are left out; so are vectors of another
length than that of the most rows (of equally frequent lengths, the smaller); whole numbers stop at +-2^62; a deviation
beyond the range of a long is null; a component without variance (below 10^-12 of the whole) has whitened 0 and no part
in identity_error; with fewer dimensions than components there are as many components as dimensions; repeated rows count
as often as they stand there; an empty table gives an empty result; ids may be of any type, nulls too; other columns play
no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import tidy

MERGERS = 64
#: Largest whole number of an entry, and share of the variance below which a component has none.
_MOST, _NOTHING = 2**62, 1e-12


class Moments:
    """n, mean, centred products and exact sums of vectors of d whole numbers or doubles."""

    def __init__(self, d: int):
        self.n, self.mean, self.products, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d
        self._step = np.empty((d, d))

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates, row by row."""
        for x in rows.astype(np.float64):
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply(before[:, None], (x - self.mean)[None, :], out=self._step)
            self.products += self._step
        if rows.dtype == np.int64 and len(rows):
            safe = len(rows) * int(np.abs(rows).max()) < 2**63
            self.sums = [a + int(b) for a, b in zip(self.sums, rows.sum(axis=0) if safe else rows.astype(object).sum(axis=0), strict=True)]

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        if other.n:
            apart = other.mean - self.mean
            self.products += other.products + np.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
            self.sums, self.n = [a + b for a, b in zip(self.sums, other.sums, strict=True)], n

    def row(self, part: int) -> pa.RecordBatch:
        values = [[part], [self.n], [self.mean.tolist()], [self.products.ravel().tolist()], [[str(s) for s in self.sums]]]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], _FIELDS)

    @staticmethod
    def of(n: int, mean, products, sums) -> Moments:
        out = Moments(len(mean))
        out.n, out.mean, out.sums = n, np.array(mean, np.float64), [int(s) for s in sums]
        out.products = np.array(products, np.float64).reshape(len(mean), len(mean))
        return out


_FIELDS = ["part", "n", "mean", "products", "sums"]
_SCHEMA = "part int, n long, mean array<double>, products array<double>, sums array<string>"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def moments(vectors: DataFrame, col: str, d: int, whole: Whole | None = None) -> Moments:
    """Of a column of arrays of d doubles without nulls, or of the whole numbers made of them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(d)
        for batch in batches:
            rows = _matrix(batch.column(0), d)
            own.add(whole.of(rows) if whole else rows)
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = Moments(d), 0
        for batch in batches:
            for row in batch.to_pylist():
                own.merge(Moments.of(row["n"], row["mean"], row["products"], row["sums"]))
                part = row["part"]
        if own.n:
            yield own.row(part)

    parts = vectors.select(col).mapInArrow(tidy(each), _SCHEMA)
    for tasks in (MERGERS, 1):
        parts = parts.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(tidy(merged), _SCHEMA)
    found = parts.collect()
    return Moments.of(*found[0][1:]) if found else Moments(d)


@dataclass(frozen=True)
class Whole:
    """Doubles as whole numbers: floor(scale * c) + shift."""

    scale: int = 1024
    shift: int = 100_000

    def of(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.floor(self.scale * rows.astype(np.float64))
        return np.clip(scaled, -float(_MOST), float(_MOST)).astype(np.int64).clip(-_MOST + self.shift, _MOST - self.shift) + self.shift


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, the one below it, q) with a = q t q', by Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v /= length
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns, the largest entry of each positive): implicit QR steps with Wilkinson's
    shift on the tridiagonal form."""
    diagonal, below, q = tridiagonal(a)
    t, last = np.diag(diagonal) + np.diag(below, 1) + np.diag(below, -1), len(a) - 1
    tiny = np.finfo(np.float64).eps
    while last > 0:
        for k in range(last):
            if abs(t[k + 1, k]) <= tiny * (abs(t[k, k]) + abs(t[k + 1, k + 1])):
                t[k + 1, k] = t[k, k + 1] = 0.0
        if t[last, last - 1] == 0:
            last -= 1
            continue
        first = last - 1
        while first > 0 and t[first, first - 1] != 0:
            first -= 1
        half, off = (t[last - 1, last - 1] - t[last, last]) / 2, t[last, last - 1]
        x = t[first, first] - (t[last, last] - off**2 / (half + math.copysign(math.hypot(half, off), half)))
        z = t[first + 1, first]
        for k in range(first, last):  # chase the bulge down
            r = math.hypot(x, z)
            turn = np.array([[x, z], [-z, x]]) / r if r else np.eye(2)
            near = slice(max(k - 1, first), min(k + 3, last + 1))
            t[k : k + 2, near] = turn @ t[k : k + 2, near]
            t[near, k : k + 2] = t[near, k : k + 2] @ turn.T
            q[:, k : k + 2] = q[:, k : k + 2] @ turn.T
            if k < last - 1:
                x, z = t[k + 1, k], t[k + 2, k]
    order = np.argsort(-np.diag(t), kind="stable")
    values, vectors = np.diag(t)[order], q[:, order]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Projection:
    """What whitens a vector: exact sums of the n fitted vectors, the components as columns over the root of their variance."""

    whole: Whole
    n: int
    sums: tuple[int, ...]
    weights: np.ndarray
    explained: tuple[float, ...]
    live: tuple[bool, ...]

    @staticmethod
    def of(found: Moments, whole: Whole, components: int) -> Projection:
        variance = found.products / found.n
        values, vectors = symmetric_eigen((variance + variance.T) / 2)
        values, vectors = values[:components], vectors[:, :components]
        trace = float(np.trace(variance))
        live = values > _NOTHING * trace
        weights = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
        explained = tuple(float(v) / trace if ok else 0.0 for v, ok in zip(values, live, strict=True))
        return Projection(whole, found.n, tuple(found.sums), weights, explained, tuple(map(bool, live)))

    def apply(self, rows: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(whitened, row by row; sums of (n * x - sums)^2, null beyond a long)."""
        x = self.whole.of(rows)
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)) * 2
        sums = np.array(self.sums, np.int64 if most < 2**62 else object)
        apart = (x if most < 2**62 else x.astype(object)) * self.n - sums
        widest = int(np.abs(apart).max(initial=0))
        squares = (apart if len(self.sums) * widest**2 < 2**63 else apart.astype(object)) ** 2
        deviation = [int(s) if s < 2**63 else None for s in squares.sum(axis=1).tolist()]
        return (apart / self.n).astype(np.float64) @ self.weights, deviation


def _dimension(vectors: DataFrame) -> int:
    most = vectors.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").limit(1).collect()
    return most[0]["d"] if most else 0


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, whole: Whole = Whole()) -> DataFrame:  # noqa: B008
    """One row for each vector and component: id, component (from 1, by falling variance), n, deviation, whitened, explained,
    identity_error."""
    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]
    entries = F.col(vector_col).cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = df.select(F.col(id_col).alias("id"), entries.alias("v")).where(F.col(vector_col).isNotNull() & sound)
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = _dimension(vectors)
    if not d:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    vectors = vectors.where(F.size("v") == d)
    projection = Projection.of(moments(vectors, "v", d, whole), whole, components)
    k = len(projection.live)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = projection.apply(_matrix(batch.column(0), d))[0]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(rows.ravel()))], ["w"])

    checked = moments(vectors.select("v").mapInArrow(tidy(projected), "w array<double>"), "w", k)
    apart = np.abs(checked.products / checked.n - np.eye(k))[np.ix_(projection.live, projection.live)]
    error = float(apart.max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, deviation = projection.apply(_matrix(batch.column(1), d))
            n = len(rows)
            ids, spread = batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(n), k)))
            numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))
            columns = [ids, numbers, pa.array(np.full(n * k, projection.n)), spread, pa.array(rows.ravel()), pa.array(np.tile(projection.explained, n)), pa.array(np.full(n * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
