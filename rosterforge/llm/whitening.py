"""Whitening of embeddings by their principal components, with moments that are merged by Chan's formula.

Entries become whole numbers x = floor(scale * c) + shift, and the fit list is each distinct vector once. A task sums up the
vectors that it reads to a count, the exact sums of each dimension and the scatter about its own mean; two such summaries are
merged by

    scatter = scatter_a + scatter_b + (mean_b - mean_a)(mean_b - mean_a)' * n_a * n_b / (n_a + n_b)

in a tree over the tasks, so nothing is ever subtracted from a large sum of squares, and what meets in one place is a few
matrices of dimension by dimension, whatever the rows. The driver takes the eigenvectors of the merged covariance. A second pass
over the fit list whitens it and merges the moments of the result in the same way: how far their covariance is from the identity.

Sums are exact (whole numbers of any length), as is the deviation, the sum over dimensions of (n * x - S)**2.

Rows whose vector is null or empty, or holds null, NaN or infinite entries, are dropped, as are rows with an entry that no long
can hold when scaled (2**62 or more) and rows of another length than the commonest one (of equally common ones the
longest). Null and repeated ids are kept: each row gives its own results. A component without variance (fewer distinct vectors than
dimensions, constant dimensions) explains nothing and has null `whitened`. Vectors of fewer dimensions than components have as
many as dimensions. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow

SCALE, SHIFT = 64.0, 1_000_000
#: Summaries that are merged in one place.
FAN = 8
#: Deviations beyond this have no place in their column.
MOST = 10**38 - 1


@dataclass
class Moments:
    """n vectors, their sums, and their scatter about their mean."""

    n: int
    total: list
    scatter: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Moments:
        return cls(0, [0] * dim, np.zeros((dim, dim)))

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of x: exact sums if they are whole numbers."""
        n = len(x)
        if not n:
            return cls.none(x.shape[1])
        if x.dtype.kind == "i":
            total = whole_sums(x)
            d = centred(x, total, n)
        else:
            total = x.sum(0).tolist()
            d = x - x.mean(0)
        return cls(n, total, d.T @ d)

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        a, b = self.n, other.n
        apart = np.array([(y * a - x * b) / (a * b) for x, y in zip(self.total, other.total, strict=True)])
        both = [x + y for x, y in zip(self.total, other.total, strict=True)]
        return Moments(a + b, both, self.scatter + other.scatter + np.outer(apart, apart) * (a * b / (a + b)))


def whole_sums(x: np.ndarray) -> list[int]:
    """Exact sums of columns, from the halves of the numbers."""
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return [(int(h) << 32) + int(y) for h, y in zip(high, low, strict=True)]


def centred(x: np.ndarray, total: list[int], n: int) -> np.ndarray:
    """x less total / n: the whole part is subtracted exactly."""
    base = np.array([t // n for t in total], np.int64)
    return (x - base).astype(np.float64) - np.array([t % n / n for t in total])


def deviations(x: np.ndarray, total: list[int], n: int) -> list[int]:
    """Exact sums of (n * x - total)**2 over columns, a number per row."""
    base, rest = [t // n for t in total], [t % n for t in total]
    y = x - np.array(base, np.int64)
    most = max(int(np.abs(y).max(initial=0)), 1) * y.shape[1]
    if most * max(most, *rest) < 1 << 62:  # then the sums of y * y and of y * rest fit
        square, mixed = (y * y).sum(1).tolist(), (y * np.array(rest, np.int64)).sum(1).tolist()
        own = sum(r * r for r in rest)
        return [n * n * a - 2 * n * b + own for a, b in zip(square, mixed, strict=True)]
    return [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist()]


@dataclass(frozen=True)
class Model:
    """n distinct vectors, their sums, and falling eigenvalues with their unit eigenvectors as columns."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @classmethod
    def of(cls, m: Moments, components: int) -> Model:
        v = m.scatter / m.n
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        # the same sign wherever it is fitted: the largest entry is positive
        sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        return cls(m.n, m.total, values, vectors * sign, float(np.trace(v)))

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > max(float(self.values[0]), 0.0) * len(self.total) * np.finfo(float).eps

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A column per component that has variance."""
        live = self.live
        return centred(x, self.total, self.n) @ (self.vectors[:, live] / np.sqrt(self.values[live]))


def usable(rows: DataFrame, vector_col: str, scale: float, shift: int) -> Column:
    """The vector as whole numbers; null if it can't be used."""
    v = F.col(vector_col)
    ok = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * scale) < float(1 << 62)))
    return F.when((F.size(v) > 0) & ok, F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(shift).cast("long")))


def arrays(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def merged(vectors: DataFrame, dim: int, own) -> Moments:
    """The moments of own(x) over all rows x (a column of arrays of `dim` whole numbers), merged in a tree of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for batch in batches:
            new = Moments.of(own(arrays(batch, "x", dim)))
            m = new if m is None else m.merge(new)
        if m is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary())], ["m"])

    parts = in_arrow(vectors, run, "m binary").rdd.map(lambda r: pickle.loads(r[0]))
    depth = max(2, math.ceil(math.log(max(parts.getNumPartitions(), 2), FAN)))
    return parts.treeReduce(lambda a, b: a.merge(b), depth)


def fit(rows: DataFrame, components: int = 16, vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> Model | None:
    """The model of the distinct vectors, and its identity error; None if no row can be used."""
    x = rows.select(usable(rows, vector_col, scale, shift).alias("x")).filter("x IS NOT NULL")
    lengths = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return None
    dim = lengths[0].dim
    tmp = Scratch(rows.sparkSession, "whitening")
    distinct = tmp.write(x.filter(F.size("x") == dim).distinct(), "fit")
    model = Model.of(merged(distinct, dim, lambda v: v), components)
    if model.live.any():
        white = merged(distinct, dim, model.whiten)
        error = np.abs(white.scatter / white.n - np.eye(len(white.total))).max()
        model = Model(model.n, model.total, model.values, model.vectors, model.trace, float(error))
    tmp.drop("fit")
    return model


def transform(rows: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    id_type = rows.schema[id_col].dataType
    x = rows.select(F.col(id_col).alias("id"), usable(rows, vector_col, scale, shift).alias("x"))
    out = f"id {id_type.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return in_arrow(x.filter("false"), lambda batches: iter(()), out).withColumnRenamed("id", id_col)
    dim, k, live = len(model.total), len(model.values), np.flatnonzero(model.live)
    explained = np.where(model.live, model.values / (model.trace or 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = arrays(batch, "x", dim)
            n = len(v)
            white = np.full((n, k), np.nan)
            white[:, live] = model.whiten(v)
            far = [d if d <= MOST else None for d in deviations(v, model.total, model.n)]
            each = np.repeat(np.arange(n), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)),
                    pa.array(far, pa.decimal128(38, 0)).take(pa.array(each)), pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                    pa.array(np.tile(explained, n)), pa.array(np.full(n * k, model.identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return in_arrow(x.filter((F.size("x") == dim) & F.col("x").isNotNull()), run, out).withColumnRenamed("id", id_col)


def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Fit and transform the same rows."""
    model = fit(rows, components, vector_col, scale, shift)
    return transform(rows, model, id_col, vector_col, scale, shift)
