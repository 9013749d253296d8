"""Level surface of a voxel table as a vertex and a face table.

A cell is eight voxels of a cube.  Each cell is cut into six tetrahedra around its main diagonal, the
same way everywhere, so neighbouring cells agree on the faces between them and the surface has no
cracks and no ambiguous case.  A vertex lies on an edge between a voxel inside and one outside, and is
named by that edge (its low voxel and its direction), so cells share vertices without any search.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import spread

KEYS = ("ix", "iy", "iz")
#: Voxel numbers lie between -HALF and HALF - 1 on each axis, so that an edge has a name in a bigint.
HALF = 1 << 18
#: Triangles a tetrahedron can have, and tetrahedra of a cell.
SLOTS, TETRAHEDRA = 2, 6


def _offset(corner: int) -> np.ndarray:
    return np.array([corner >> axis & 1 for axis in range(3)], float)


def paths() -> list[tuple[int, int, int, int]]:
    """The tetrahedra: corners met on the ways from the low to the high corner, one axis at a time."""
    return [(0, 1 << a, 1 << a | 1 << b, 7) for a, b, _ in permutations(range(3))]


def _triangles(corners: tuple[int, ...], inside: int) -> list[list[tuple[int, int]]]:
    """Triangles of a tetrahedron, each three (low, high) edges, seen from outside against the clock."""
    own = [c for k, c in enumerate(corners) if inside >> k & 1]
    other = [c for c in corners if c not in own]
    if not own or not other:
        return []
    if len(own) == 2:
        ring = [(own[0], other[0]), (own[0], other[1]), (own[1], other[1]), (own[1], other[0])]
        found = [[ring[0], ring[1], ring[2]], [ring[0], ring[2], ring[3]]]
    else:
        found = [[(a, b) for a in own for b in other]]
    away = sum(map(_offset, other)) / len(other) - sum(map(_offset, own)) / len(own)
    out = []
    for edges in found:
        p, q, r = ((_offset(a) + _offset(b)) / 2 for a, b in edges)
        turned = edges if np.cross(q - p, r - p) @ away > 0 else edges[::-1]
        out.append([(min(e), max(e)) for e in turned])
    return out


def case_table() -> list[int]:
    """low * 8 + high of three edges for each tetrahedron, choice of inside corners and slot; -1 for none."""
    table = []
    for corners in paths():
        for inside in range(16):
            found = _triangles(corners, inside)
            for slot in range(SLOTS):
                table += [lo * 8 + hi for lo, hi in found[slot]] if slot < len(found) else [-1] * 3
    return table


def cells(voxels: DataFrame, value: str) -> DataFrame:
    """Cells (low voxel) with all eight corner values w0 to w7.

    Corner k is the voxel one further on the axes whose bits k has.  Every voxel tells the eight cells it
    is a corner of its value: one shuffle, combined before it, and no voxel has more than eight rows.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("k"), *[(F.col(c) - (k >> axis & 1)).alias(c) for axis, c in enumerate(KEYS)]) for k in range(8)])
    told = spread(voxels.select(*[F.col(c).cast("bigint").alias(c) for c in KEYS], F.col(value).cast("double").alias("w")).dropna())
    corner = told.select("w", F.explode(rows).alias("r")).select("w", "r.*")
    got = corner.groupBy(*KEYS).agg(*[F.min(F.when(F.col("k") == k, F.col("w"))).alias(f"w{k}") for k in range(8)])
    return got.dropna()


def _packed(cols: list[Column], more: int) -> Column:
    """Voxel numbers in one bigint, with room for ``more`` bits below."""
    out = F.lit(0).cast("bigint")
    for c in cols:
        fits = (c >= -HALF) & (c < HALF)
        shifted = F.when(fits, c + HALF).otherwise(F.raise_error(F.lit("voxel number out of range")).cast("bigint"))
        out = F.shiftleft(out, 19).bitwiseOR(shifted)
    return F.shiftleft(out, more)


def triangles(voxels: DataFrame, value: str, level: float = 0.0) -> DataFrame:
    """(ix, iy, iz, fid, p0, p1, p2): the triangles of each cell; p has vid, x, y, z.

    Voxels below ``level`` are inside; a voxel at the level is outside.  Only cells with all corners take
    part, so the surface ends where voxels are missing.  A voxel that is listed twice counts with its
    least value; nulls are missing voxels.
    """
    inside = [F.when(F.col(f"w{k}") < level, 1).otherwise(0) for k in range(8)]
    crossed = cells(voxels, value).withColumn("n", sum(inside)).where((F.col("n") > 0) & (F.col("n") < 8))
    case = F.array(*[sum((inside[c] * (1 << k) for k, c in enumerate(path)), F.lit(0)) for path in paths()])
    slots = crossed.withColumn("case", case).select("*", F.explode(F.sequence(F.lit(0), F.lit(TETRAHEDRA * SLOTS - 1))).alias("slot"))
    tetrahedron = F.floor(F.col("slot") / SLOTS).cast("int")
    at = ((tetrahedron * 16 + F.get("case", tetrahedron)) * SLOTS + F.col("slot") % SLOTS) * 3
    table = F.array(*[F.lit(v) for v in case_table()])
    placed = slots.select(*KEYS, "slot", F.array(*[f"w{k}" for k in range(8)]).alias("w"), *[F.get(table, at + i).alias(f"e{i}") for i in range(3)])
    placed = placed.where("e0 >= 0")

    def point(i: int) -> Column:
        lo, hi = F.floor(F.col(f"e{i}") / 8).cast("int"), F.col(f"e{i}") % 8
        a, b = F.get("w", lo), F.get("w", hi)
        t = (F.lit(float(level)) - a) / (b - a)
        bit = lambda c, axis: F.shiftright(c, axis).bitwiseAND(1)
        low = [F.col(c) + bit(lo, axis) for axis, c in enumerate(KEYS)]
        vid = _packed(low, 3).bitwiseOR((hi - lo).cast("bigint"))
        return F.struct(vid.alias("vid"), *[(v + t * bit(hi - lo, axis)).alias(x) for axis, (v, x) in enumerate(zip(low, "xyz"))]).alias(f"p{i}")

    fid = _packed([F.col(c) for c in KEYS], 4).bitwiseOR(F.col("slot").cast("bigint")).alias("fid")
    return placed.select(*KEYS, fid, *[point(i) for i in range(3)])


def level_surface(voxels: DataFrame, value: str, level: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the surface between voxels below ``level`` and the others; see ``triangles``."""
    tri = triangles(voxels, value, level)
    corners = tri.select(F.explode(F.array("p0", "p1", "p2")).alias("p")).select("p.*")
    # every cell around an edge finds the same place for it
    verts = corners.groupBy("vid").agg(*[F.min(c).alias(c) for c in "xyz"])
    faces = tri.select("fid", *[F.col(f"p{i}.vid").alias(f"v{i}") for i in range(3)])
    return verts, faces


def edge_pairs() -> list[tuple[int, int]]:
    """(low, high) corners of the edges that a cell's tetrahedra have."""
    return sorted({(a, b) for path in paths() for a, b in combinations(path, 2)})
