"""Whitening of embedding vectors by the eigenvectors of their covariance.

The fit list, each distinct vector once, is gathered by Spark; its sums and its scatter about the
mean are added up by tasks in whole numbers, so they do not depend on how the rows are split.  The
scatter is as large as the number of dimensions squared, and only that comes to the driver: a
Cholesky factorisation with pivots takes it apart, and one-sided Jacobi rotations make the columns
of the triangular factor orthogonal.  Their squared norms are the eigenvalues, their directions the
components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import stored

COMPONENTS = 16
#: An entry is counted in steps of 1/64; where zero lies makes no difference to what is found.
STEPS = 64
#: Entries further from zero, in steps, count as that far.
FARTHEST = 1 << 53
#: Whole numbers below this are exact in a double.
EXACT = 1 << 53
#: Sweeps of rotations at most; a handful is enough.
SWEEPS = 60


@dataclass
class Whitening:
    """``n`` distinct vectors; per dimension a whole ``centre`` near the mean and the sum ``rest`` of what is left."""

    n: int
    centre: list[int]
    rest: list[int]
    variance: np.ndarray  # of the components, falling
    axes: np.ndarray  # dimensions x components
    trace: float
    identity_error: float = 0.0

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of vectors less the centre."""
        mean = np.array([r / self.n for r in self.rest])
        return (y - mean) @ self.axes / np.sqrt(self.variance)

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sums of (n * x - total) squared, exact; null where that is no long."""
        top = self.n * max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) + max(map(abs, self.rest), default=0)
        kind = np.int64 if y.shape[1] * top * top < 1 << 63 else object
        away = y.astype(kind) * self.n - np.array(self.rest, kind)
        return [int(v) if v < 1 << 63 else None for v in (away * away).sum(1)]


def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of a column of double lists that are whole and finite, and their entries in steps."""
    rows, out = [], []
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)  # null entries become nan
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(valid & (at[1:] > at[:-1]) & (bad[at[1:]] == bad[at[:-1]])):
        rows.append(k)
        out.append(np.floor(np.clip(STEPS * flat[at[k] : at[k + 1]], -FARTHEST, FARTHEST)).astype(np.int64))
    return np.array(rows, np.int64), out


def _packed(x: np.ndarray) -> bytes:
    """A vector of steps in as few bytes as hold it, after the width; equal vectors give equal bytes."""
    top = max(-int(x.min()), int(x.max()) + 1)
    width = 2 if top <= 1 << 15 else 4 if top <= 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpacked(keys: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(k, f"<i{k[0]}", offset=1).astype(np.int64) for k in keys.to_pylist()])


def fit_list(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(key, d): each distinct vector once, packed, and its dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, xs = _vectors(batch.column("v"))
            yield pa.RecordBatch.from_arrays([pa.array(map(_packed, xs), pa.binary()), pa.array(map(len, xs), pa.int32())], ["key", "d"])

    return vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "key binary, d int").distinct()


def _added(fit: DataFrame, terms, names: str) -> list:
    """Sums over all tasks of the numbers by place that ``terms`` gives for some vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = terms(_unpacked(batch.column("key")))
                total = own if total is None else total + own
        if total is not None:
            flat = total.reshape(-1).tolist()
            cells = [Decimal(v) for v in flat] if total.dtype == object else flat
            kind = pa.decimal128(38, 0) if total.dtype == object else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(cells, kind)], ["place", "v"])

    rows = fit.select("key").mapInArrow(run, f"place int, v {names}").groupBy("place").agg(F.sum("v").alias("v"))
    return [r.v for r in rows.orderBy("place").collect()]


def _sums(y: np.ndarray) -> np.ndarray:
    """Whole sums of the columns, as Python numbers."""
    return y.sum(0, dtype=np.int64).astype(object) if abs(y).max() * len(y) < 1 << 62 else y.astype(object).sum(0)


def _products(y: np.ndarray) -> np.ndarray:
    """Whole sums of the products of columns, as Python numbers."""
    top = int(abs(y).max())
    if top * top >= EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    out, step = 0, max(1, EXACT // max(1, top * top))
    for k in range(0, len(y), step):
        part = y[k : k + step].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L with as many columns as ``v`` has rank and L L' = v; rows stay in the order of ``v``.

    With its rows in the order of the pivots L is lower triangular.
    """
    rest, columns = np.array(v, float), []
    least = len(v) * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for _ in range(len(v)):
        pivot = int(np.argmax(rest.diagonal()))
        top = rest[pivot, pivot]
        if top <= least:
            break
        column = rest[:, pivot] / np.sqrt(top)
        columns.append(column)
        rest = rest - np.outer(column, column)
        rest[pivot, :] = rest[:, pivot] = 0.0
    return np.stack(columns, 1) if columns else np.zeros((len(v), 0))


def jacobi(a: np.ndarray) -> np.ndarray:
    """``a`` with its columns rotated in pairs until all are orthogonal, longest first."""
    a, n = a.copy(), a.shape[1]
    for _ in range(SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                x, y = a[:, p], a[:, q]
                aa, bb, ab = x @ x, y @ y, x @ y
                if abs(ab) <= 4 * np.finfo(float).eps * np.sqrt(aa * bb):
                    continue
                turned = True
                tau = (bb - aa) / (2 * ab)
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return a[:, np.argsort(-(a * a).sum(0), kind="stable")]


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct vectors; None if no vector is whole.

    Vectors whose length is not the most frequent one (of equally frequent ones the greatest) are left
    out, as null vectors and those with null or non-finite entries are.
    """
    fit = stored(fit_list(vectors, vector_col), "vectors")
    lengths = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths.d, lengths["count"]
    fit = fit.where(F.col("d") == d)
    total = [int(v) for v in _added(fit, _sums, "decimal(38,0)")]
    centre = [t // n for t in total]
    rest = [t - n * c for t, c in zip(total, centre)]
    middle = np.array(centre, np.int64)
    scatter = [int(v) for v in _added(fit, lambda x: _products(x - middle), "decimal(38,0)")]
    # about the whole centre, so what the fraction of the mean adds is taken off, still in whole numbers
    covariance = np.array([(n * s - rest[k // d] * rest[k % d]) / (n * n) for k, s in enumerate(scatter)]).reshape(d, d)
    turned = jacobi(pivoted_cholesky(covariance))[:, :components]
    variance = (turned * turned).sum(0)
    axes = turned / np.sqrt(variance)
    if axes.size:
        axes = axes * np.sign(axes[abs(axes).argmax(0), np.arange(axes.shape[1])])
    model = Whitening(n, centre, rest, variance, axes, float(covariance.trace()))
    k = len(variance)
    if k:
        model.identity_error = _identity_error(fit, model, middle)
    return model


def _identity_error(fit: DataFrame, model: Whitening, middle: np.ndarray) -> float:
    """Largest entry by which the covariance of the whitened fit list misses the identity."""
    k = len(model.variance)
    mean = np.array(_added(fit, lambda x: model.project(x - middle).sum(0), "double")) / model.n

    def squares(x: np.ndarray) -> np.ndarray:
        w = model.project(x - middle) - mean
        return w.T @ w

    found = np.array(_added(fit, squares, "double")).reshape(k, k) / model.n
    return float(abs(found - np.eye(k)).max())


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component.

    Returns id_col, component (from 1 by falling variance), n, deviation, whitened, explained and
    identity_error.  Vectors that are null, empty, of another length than those of the fit list, or hold
    null or non-finite entries have no row; repeated rows and null ids have theirs.  Directions without
    variance cannot be whitened and are no components, so vectors that are all alike give no rows, as
    an empty table does.  Entries of more than 2^53 steps count as 2^53; a deviation that is no long is
    null.  Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if model is None or not len(model.variance):
        model_rows = rows.limit(0).mapInArrow(lambda batches: iter(()), SCHEMA)
        return model_rows.withColumnRenamed("id", id_col)
    k, middle = len(model.variance), np.array(model.centre, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, xs = _vectors(batch.column("v"))
            fits = [i for i, x in enumerate(xs) if len(x) == len(middle)]
            if not fits:
                continue
            y = np.stack([xs[i] for i in fits]) - middle
            ids = batch.column("id").take(pa.array(at[fits]))
            each = pa.array(np.repeat(np.arange(len(fits)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(fits))),
                    pa.array(np.full(len(each), model.n)),
                    pa.array(model.deviation(y), pa.int64()).take(each),
                    pa.array(model.project(y).reshape(-1)),
                    pa.array(np.tile(model.variance / model.trace, len(fits))),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
