"""Descriptor matching: best by dot product with distance, ratio and mutual tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.gridjoin import UNEVEN, Axis, listed, pieces
from geoloom.operators.knn import ENTRIES, _first, _matrix, knn_vectors
from geoloom.session import checkpoint

#: Pairs of places that one group of a guided search compares, about.
PAIRS = 1 << 26
#: Stands for a null id in a task; the lowest number, as nulls come first.
NONE = -(1 << 63)

SCALE = 512  # fixed value: descriptors are stored as int(512 v + 0.5)


def quantise(vec: Column | str) -> Column:
    return F.transform(vec, lambda v: F.floor(v.cast("double") * SCALE + 0.5).cast("int"))


def angle(dot: Column) -> Column:
    """Angle between two unit descriptors from their quantised dot product."""
    return F.acos(F.least(dot / F.lit(float(SCALE * SCALE)), F.lit(1.0)))


def _accepted(top2: DataFrame, me: str, distmax: float, ratiomax: float) -> DataFrame:
    """Best partner per row when it is near enough and clearly better than the second."""
    per = top2.groupBy(me).agg(
        F.max(F.when(F.col("rank") == 1, F.col("nid"))).alias("partner"),
        F.max(F.when(F.col("rank") == 1, F.col("dot"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("dot"))).alias("d2"),
    )
    near, second = angle(F.col("d1")), F.coalesce(angle(F.col("d2")), F.lit(1e30))
    return per.where((near < distmax) & (near < second * ratiomax)).select(
        me, "partner", near.alias("dist"), (near / second).alias("ratio")
    )


def best_matches(
    a: DataFrame, b: DataFrame, aid: str, avec: str, bid: str, bvec: str, distmax: float, ratiomax: float, mutual: bool = True
) -> DataFrame:
    """Accepted matches (aid, bid, dist); with ``mutual`` both sides must choose each other."""

    def top2(q, d, qid, qvec, did, dvec):
        near = knn_vectors(q, d, 2, qid, qvec, did, dvec, metric="dot")
        return near.withColumn("dot", -F.col("value"))

    fwd = _accepted(top2(a, b, aid, avec, bid, bvec), aid, distmax, ratiomax).withColumnRenamed("partner", bid)
    if not mutual:
        return fwd.select(aid, bid, "dist", "ratio")
    back = _accepted(top2(b, a, bid, bvec, aid, avec), bid, distmax, ratiomax).select(bid, F.col("partner").alias(aid))
    return fwd.join(back, [aid, bid], "left_semi").select(aid, bid, "dist", "ratio")


def guided_matches(
    a: DataFrame,
    b: DataFrame,
    dim: int,
    homography: Sequence[float],
    fundamental: Sequence[float],
    hdistmax: float,
    fdistmax: float,
    distmax: float,
    ratiomax: float,
) -> DataFrame:
    """Matches among pairs that fit a homography and an epipolar geometry.

    Sides are (a_id, a_vec, ax, ay) and (b_id, b_vec, bx, by).  The homography gate is a
    radius around the projected place.  Rows meet in the cells of the grid join, where products and gates are
    taken for all of them at once; only the two best of each row leave a cell, so no list of pairs is written.
    """
    h = [float(v) for v in homography]
    ax, ay = F.col("ax"), F.col("ay")
    w = ax * h[6] + ay * h[7] + h[8]
    proj = a.withColumn("_px", (ax * h[0] + ay * h[1] + h[2]) / w).withColumn("_py", (ax * h[3] + ay * h[4] + h[5]) / w)
    near = b
    for c in "xy":
        near = near.withColumn(f"_l{c}", F.col(f"b{c}") - hdistmax).withColumn(f"_h{c}", F.col(f"b{c}") + hdistmax)
    sides = []
    for side, tag in ((proj, "a"), (near, "b")):
        vec = F.slice(F.col(f"{tag}_vec"), 1, dim).cast("array<double>")
        side = side.withColumns({f"{tag}_vec": vec, f"{tag}_id": F.coalesce(F.col(f"{tag}_id").cast("bigint"), F.lit(NONE))})
        # without a whole descriptor there is no product
        sides.append(side.where((F.size(f"{tag}_vec") == dim) & F.forall(f"{tag}_vec", lambda v: v.isNotNull())))
    both = listed(*sides, [Axis(f"_p{c}", f"_p{c}", f"_l{c}", f"_h{c}", 2.0 * hdistmax) for c in "xy"])
    empty = a.join(b, F.lit(False)).select("a_id", "b_id", F.lit(0.0).alias("dist"))
    if both is None:
        return empty
    ls, rs, keys, rows = both
    ls, rs, on, tasks = pieces(ls, rs, keys, PAIRS)
    if not tasks:
        return empty
    run = _best_gated([float(v) for v in fundamental], hdistmax, fdistmax, max(rows) < UNEVEN * min(rows))
    groups = (side.repartition(tasks, *on).groupBy(*on) for side in (ls, rs))
    found = checkpoint(next(groups).cogroup(next(groups)).applyInPandas(run, "forward boolean, me bigint, nid bigint, dot double"))

    def top2(forward, me, other):
        ranked = found.where(F.col("forward") == forward).withColumn("rank", F.row_number().over(Window.partitionBy("me").orderBy(F.desc("dot"), "nid")))
        ids = [F.nullif(c, F.lit(NONE)).cast(k).alias(n) for c, k, n in (("me", *me), ("nid", other, "nid"))]
        return ranked.where("rank <= 2").select(*ids, "dot", "rank")

    a_type, b_type = a.schema["a_id"].dataType, b.schema["b_id"].dataType
    fwd = _accepted(top2(True, (a_type, "a_id"), b_type), "a_id", distmax, ratiomax).withColumnRenamed("partner", "b_id")
    back = _accepted(top2(False, (b_type, "b_id"), a_type), "b_id", distmax, ratiomax).select("b_id", F.col("partner").alias("a_id"))
    return fwd.join(back, ["a_id", "b_id"], "left_semi").select("a_id", "b_id", "dist")


def _best_gated(f: Sequence[float], hdistmax: float, fdistmax: float, corner: bool):
    """The two best partners, within both gates, of every row of a cell and on both sides.

    A pair counts in one cell only, by the rules of the grid join; ``corner`` as there.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = ([], [])
        if len(left) and len(right):
            left, right = left.sort_values("a_id", kind="stable"), right.sort_values("b_id", kind="stable")  # ties by id
            mine, theirs = _matrix(left["a_vec"]), _matrix(right["b_vec"])
            ax, ay, px, py = (left[c].to_numpy(dtype=float) for c in ("ax", "ay", "_px", "_py"))
            bx, by = (right[c].to_numpy(dtype=float) for c in ("bx", "by"))
            l0, l1, l2 = (ax * f[i] + ay * f[i + 1] + f[i + 2] for i in (0, 3, 6))
            scale = np.sqrt(l0 * l0 + l1 * l1)
            here = []  # a level, or a first cell, that is the cell's on one of the sides
            for i in range(2):
                here.append((left[f"_vl{i}"].to_numpy() == left[f"_m{i}"].to_numpy(), right[f"_vr{i}"].to_numpy() == right[f"_m{i}"].to_numpy()))
                if corner:
                    here.append((left[f"_fl{i}"].to_numpy() == left[f"_c{i}"].to_numpy(), right[f"_fr{i}"].to_numpy() == right[f"_c{i}"].to_numpy()))
            step = max(1, ENTRIES // len(right))
            for lo in range(0, len(left), step):
                at = slice(lo, lo + step)
                dx, dy = px[at, None] - bx, py[at, None] - by
                gate = dx * dx + dy * dy <= hdistmax * hdistmax
                with np.errstate(divide="ignore", invalid="ignore"):
                    gate &= np.abs(bx * l0[at, None] + by * l1[at, None] + l2[at, None]) / scale[at, None] <= fdistmax
                for own, other in here:
                    if not own[at].all() and not other.all():
                        gate &= own[at, None] | other
                dot = np.where(gate, mine[at] @ theirs.T, -np.inf)
                for out, axis, n in zip(found, (1, 0), dot.shape):
                    values, each = dot.copy(), np.arange(n)
                    for _ in range(2):
                        best = values.argmax(axis=axis)  # the first of equal ones
                        place = (each, best) if axis else (best, each)
                        value = values[place]
                        some = value > -np.inf
                        row, col = (lo + each, best) if axis else (each, lo + best)
                        out.append((row[some], col[some], -value[some]))
                        values[place] = -np.inf
        parts = []
        for forward, out in zip((True, False), found):
            if out:
                row, col, value = _first(*(np.concatenate(c) for c in zip(*out)), 2)
                a_id, b_id = left["a_id"].to_numpy(), right["b_id"].to_numpy()
                me, other = (a_id, b_id) if forward else (b_id, a_id)
                parts.append(pd.DataFrame({"forward": forward, "me": me[row], "nid": other[col], "dot": -value}))
        return pd.concat(parts) if parts else pd.DataFrame({"forward": [], "me": [], "nid": [], "dot": []}).astype({"forward": bool, "me": "int64", "nid": "int64"})

    return run


def first_matches(matches: DataFrame, order: str, cap: int) -> DataFrame:
    """The first ``cap`` accepted matches in index order (a top-k report)."""
    return matches.orderBy(order).limit(cap)
