"""Robust fits of two-view models, one for every pair of images, from tables of point matches.

The pool of a pair are its matches with the lowest hashes; every try draws its points from there and solves
for one model.  All models of all pairs are scored in one pass over the matches by a join on the pair and an
aggregate by (pair, try), combined before its shuffle.  A pair with very many matches is cut into pieces, and
its models go to every piece.  The best model is then fitted to all its inliers by sums of products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.session import spread, stored

Keys = Sequence[str]
XY = ("x1", "y1", "x2", "y2")
#: Matches of a pair that one task scores; a pair with more is cut into pieces.
PIECE_ROWS = 200_000
#: Matches of a pair from which its tries draw.
POOL = 512
#: Samples whose equations have less than this share of full rank, by singular values, give no model.
FLAT = 1e-9


def _rows(kind: str, x, y, u, v, one, zero) -> list[list]:
    """Linear equations in the nine entries of the model, for columns and for numpy arrays."""
    if kind == "homography":
        return [[-x, -y, -one, zero, zero, zero, u * x, u * y, u], [zero, zero, zero, -x, -y, -one, v * x, v * y, v]]
    return [[u * x, u * y, u, v * x, v * y, v, x, y, one]]


def _residual(kind: str, m: Sequence, x, y, u, v) -> tuple:
    """Error of a match as numerator and squared denominator: transfer error, or Sampson's first-order distance."""
    a, b, c = (m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] for i in range(3))
    if kind == "homography":
        return F.sqrt(F.pow(a - u * c, F.lit(2.0)) + F.pow(b - v * c, F.lit(2.0))), F.pow(c, F.lit(2.0))
    p, q = (m[i] * u + m[3 + i] * v + m[6 + i] for i in range(2))
    return F.abs(u * a + v * b + c), reduce(lambda s, t: s + t, [F.pow(t, F.lit(2.0)) for t in (a, b, p, q)])


SAMPLE = {"homography": 4, "fundamental": 8}


@dataclass(frozen=True)
class _Solver:
    """Turns equations in centred and scaled coordinates into models of the given ones."""

    kind: str
    tries: int
    seed: int

    def frame(self, p: np.ndarray) -> np.ndarray:
        """(centre x, centre y, scale) that bring points to mean zero and mean distance sqrt(2)."""
        mid = p.mean(axis=0)
        far = np.sqrt(((p - mid) ** 2).sum(axis=1)).mean()
        return np.array([*mid, np.sqrt(2) / far if far > 0 else 1.0])

    def raw(self, models: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
        """Models (n, 3, 3) of framed coordinates in the given coordinates, of unit norm, greatest entry positive."""
        to1, to2 = (np.array([[f[2], 0, -f[2] * f[0]], [0, f[2], -f[2] * f[1]], [0, 0, 1]]) for f in (f1, f2))
        if self.kind == "fundamental":
            a, s, b = np.linalg.svd(models)
            s[:, 2] = 0
            out = to2.T @ (a * s[:, None, :] @ b) @ to1
        else:
            out = np.linalg.inv(to2) @ models @ to1
        flat = out.reshape(-1, 9)
        flat = flat / np.linalg.norm(flat, axis=1, keepdims=True)
        top = np.take_along_axis(flat, np.abs(flat).argmax(axis=1)[:, None], axis=1)
        return flat * np.sign(top)

    def draws(self, n: int) -> np.ndarray:
        """Rows of the pool (tries, sample), different within a try; they depend on the seed and n alone."""
        lots = np.random.default_rng([self.seed, n]).random((self.tries, n))
        return np.argsort(lots, axis=1, kind="stable")[:, : SAMPLE[self.kind]]

    def sampled(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(models (n, 9), frame of the first image, of the second) of all tries over a pool."""
        f1, f2 = self.frame(xy[:, :2]), self.frame(xy[:, 2:])
        at = np.concatenate([(xy[:, :2] - f1[:2]) * f1[2], (xy[:, 2:] - f2[:2]) * f2[2]], axis=1)[self.draws(len(xy))]
        x, y, u, v = np.moveaxis(at, 2, 0)
        parts = [np.stack(r, axis=2) for r in _rows(self.kind, x, y, u, v, np.ones_like(x), np.zeros_like(x))]
        _, s, vt = np.linalg.svd(np.concatenate(parts, axis=1), full_matrices=True)
        sound = s[:, 7] > FLAT * s[:, 0]
        return self.raw(vt[sound, 8].reshape(-1, 3, 3), f1, f2), f1, f2


def two_view_fit(
    matches: DataFrame,
    keys: Keys,
    tie: Keys,
    kind: str,
    tol: float,
    tries: int = 64,
    pool: int = POOL,
    seed: int = 0,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """(keys, n_matches, sampled_inliers, n_inliers, mean_sq, model) for every pair of images.

    ``matches`` holds x1, y1, x2, y2 and the columns ``tie`` that tell matches of a pair apart.  ``kind`` is
    ``homography`` (4 points, transfer error) or ``fundamental`` (8 points, Sampson distance); a match within ``tol``
    is an inlier.  ``model`` has nine entries by rows, unit norm and a positive greatest entry; it is fitted to the
    inliers of the best try, or that try's own where the fit keeps fewer.  Of equal tries the first one counts.
    Matches with a null key or without finite coordinates are left out.  Equal matches all count.  A pair whose
    matches give no model has nulls and no inliers.
    """
    size = SAMPLE[kind]
    solver = _Solver(kind, tries, seed)
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c).cast("double")) < F.lit(float("inf")) for c in XY])
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    lot = F.xxhash64(*[F.col(t) for t in tie], F.lit(seed))
    own = matches.where(finite & known).select(*keys, *[F.col(c).cast("double").alias(c) for c in XY], lot.alias("_lot"))
    own = stored(spread(own), "matches")  # read by every pass below; coordinates are computed once

    counts = stored(own.groupBy(*keys).agg(F.count("*").alias("n_matches")), "counts")
    models = stored(_sampled(own, keys, solver, pool, size), "models")

    pieces = F.ceil(F.col("n_matches") / F.lit(piece_rows)).cast("int")
    hot = counts.where(F.col("n_matches") > piece_rows).select(*keys, pieces.alias("_pieces"))
    dealt = own.join(hot, list(keys), "left").withColumn("_piece", F.coalesce(F.pmod("_lot", "_pieces"), F.lit(0).cast("bigint")))
    dealt = dealt.drop("_pieces", "_lot")

    def over(found: DataFrame) -> DataFrame:
        """Every match next to what was found for its pair; what was found for a hot pair goes to its pieces."""
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_pieces", F.lit(1)).cast("bigint") - 1))
        return dealt.join(found.join(hot, list(keys), "left").withColumn("_piece", every).drop("_pieces"), [*keys, "_piece"])

    def within(m: str) -> tuple[Column, Column]:
        top, low = _residual(kind, [F.col(f"{m}{i}") for i in range(9)], *[F.col(c) for c in XY])
        return (low > 0) & (top <= F.lit(float(tol)) * F.sqrt(low)), F.pow(top, F.lit(2.0)) / F.nullif(low, F.lit(0.0))

    tried = over(models.select(*keys, "models")).select(*keys, *XY, F.inline("models"))
    votes = tried.where(within("_m")[0]).groupBy(*keys, "_try").agg(F.count("*").alias("_n"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("_try")).alias("_back"))).alias("_b"))
    best = best.select(*keys, F.col("_b._n").alias("sampled_inliers"), (-F.col("_b._back")).alias("_try"))
    best = best.join(models, list(keys)).select(*keys, "sampled_inliers", "f1", "f2", F.get("models", "_try").alias("_m"))
    best = best.select("*", "_m.*").drop("_m", "_try")
    best = stored(best, "best")

    fitted = stored(_refit(over(best), keys, solver, within), "fitted")
    both = best.drop("f1", "f2").join(fitted, list(keys))
    told = over(both)
    parts = []
    for name in ("_m", "_r"):
        near, err = within(name)
        parts += [F.sum(near.cast("bigint")).alias(f"{name}n"), F.avg(F.when(near, err)).alias(f"{name}sq")]
    told = told.groupBy(*keys).agg(*parts)
    keep = F.coalesce(F.col("_rn") >= F.col("_mn"), F.lit(False))
    final = both.join(told, list(keys)).select(
        *keys,
        "sampled_inliers",
        F.when(keep, F.col("_rn")).otherwise(F.col("_mn")).alias("n_inliers"),
        F.when(keep, F.col("_rsq")).otherwise(F.col("_msq")).alias("mean_sq"),
        F.when(keep, F.array(*[f"_r{i}" for i in range(9)])).otherwise(F.array(*[f"_m{i}" for i in range(9)])).alias("model"),
    )
    none = F.lit(0).cast("bigint")
    return counts.join(final, list(keys), "left").select(
        *keys, "n_matches", *[F.coalesce(c, none).alias(c) for c in ("sampled_inliers", "n_inliers")], "mean_sq", "model"
    )


def _sampled(own: DataFrame, keys: Keys, solver: _Solver, pool: int, size: int) -> DataFrame:
    """(keys, models, f1, f2): the models of all tries, at most ``pool`` rows of a pair to a group."""
    order = Window.partitionBy(*keys).orderBy("_lot", *XY)
    seeds = own.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= pool)
    double = T.ArrayType(T.DoubleType())
    model = T.StructType([T.StructField("_try", T.IntegerType())] + [T.StructField(f"_m{i}", T.DoubleType()) for i in range(9)])
    fields = [own.schema[k] for k in keys] + [T.StructField("models", T.ArrayType(model)), T.StructField("f1", double), T.StructField("f2", double)]

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        if len(rows) < size:
            return pd.DataFrame(columns=[f.name for f in fields])
        models, f1, f2 = solver.sampled(rows[list(XY)].to_numpy(dtype=float))
        named = [{"_try": t} | {f"_m{i}": float(v) for i, v in enumerate(m)} for t, m in enumerate(models)]
        found = {"models": [named], "f1": [f1.tolist()], "f2": [f2.tolist()]}
        return pd.DataFrame({k: rows[k].iloc[:1].to_list() for k in keys} | found)

    out = seeds.groupBy(*keys).applyInPandas(solve, T.StructType(fields))
    return out.where(F.size("models") > 0)


def _refit(near: DataFrame, keys: Keys, solver: _Solver, within) -> DataFrame:
    """(keys, _r0.._r8): the least-squares model of the inliers, from the sums of products of their equations."""
    near = near.where(within("_m")[0])
    framed = [(F.col(c) - F.col(f)[i]) * F.col(f)[2] for c, f, i in zip(XY, ("f1", "f1", "f2", "f2"), (0, 1, 0, 1))]
    near = near.select(*keys, "f1", "f2", *[v.alias(c) for c, v in zip(XY, framed)])
    one, zero = F.lit(1.0), F.lit(0.0)
    eqs = _rows(solver.kind, *[F.col(c) for c in XY], one, zero)
    places = [(i, j) for i in range(9) for j in range(i, 9)]
    sums = [F.sum(reduce(lambda a, b: a + b, [r[i] * r[j] for r in eqs])).alias(f"_s{i}{j}") for i, j in places]
    total = near.groupBy(*keys).agg(F.first("f1").alias("f1"), F.first("f2").alias("f2"), *sums)
    total = total.select(*keys, "f1", "f2", F.array(*[f"_s{i}{j}" for i, j in places]).alias("_s"))

    @F.pandas_udf("array<double>")
    def solved(s: pd.Series, f1: pd.Series, f2: pd.Series) -> pd.Series:
        out = []
        at = tuple(np.array(places).T)
        for row, one_, two in zip(s, f1, f2):
            a = np.zeros((9, 9))
            a[at] = row
            _, vec = np.linalg.eigh(a + np.triu(a, 1).T)
            out.append(solver.raw(vec[:, 0].reshape(1, 3, 3), np.asarray(one_), np.asarray(two))[0].tolist())
        return pd.Series(out)

    total = total.select(*keys, solved("_s", "f1", "f2").alias("_new"))
    return total.select(*keys, *[F.col("_new")[i].alias(f"_r{i}") for i in range(9)])
