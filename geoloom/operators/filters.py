"""Row filters on boxes, points and faces; plain comparisons reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geom as G
from geoloom.operators.gridjoin import Axis, box_join, by_cell, listed, number, pieces
from geoloom.session import stored

CORNERS = [f"{t}{c}" for t in "abc" for c in "xyz"]
#: Mean extents of faces, and of surfaces on x, that a cell has in which points are told to be inside.
CELL = 4
#: Points, and faces, that are compared at once.
POINTS, FACES = 256, 512


def window_filter(df: DataFrame, lows: Sequence[str], highs: Sequence[str], box: Sequence[tuple[float, float]]) -> DataFrame:
    """Boxes that meet the window (touching counts)."""
    tests = [
        (F.col(lo) <= F.lit(float(h))) & (F.col(hi) >= F.lit(float(l))) for lo, hi, (l, h) in zip(lows, highs, box)
    ]
    return df.where(reduce(Column.__and__, tests))


def ordered_window(corners: Sequence[tuple[float, float]], eps: float = 0.0) -> list[tuple[float, float]]:
    """Window from two corners in any order, grown by ``eps``."""
    return [(min(a, b) - eps, max(a, b) + eps) for a, b in corners]


def in_window(cols: Sequence[Column], box: Sequence[tuple[float, float]]) -> Column:
    return G.all_of([(c >= F.lit(float(l))) & (c <= F.lit(float(h))) for c, (l, h) in zip(cols, box)])


def clip_to_box(df: DataFrame, axes: Sequence[str], corners: Sequence[tuple[float, float]], eps: float = 0.0) -> DataFrame:
    return df.where(in_window([F.col(a) for a in axes], ordered_window(corners, eps)))


def face_points(faces: DataFrame, verts: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Faces with corner coordinates ax..cz (and ``extra`` vertex columns per corner)."""
    out = faces
    for tag, v in zip("abc", ("v0", "v1", "v2")):
        side = verts.select(
            F.col("vid").alias(v), *[F.col(n).alias(f"{tag}{n}") for n in ("x", "y", "z", *extra)]
        )
        out = out.join(side, v)
    return out


def face_owner(tri: DataFrame) -> DataFrame:
    """Owner vertex of each face: the first corner with the largest x."""
    corners = [
        F.struct(F.col(f"{t}x").alias("x"), F.lit(-i).alias("first"), F.col(f"{t}y").alias("y"), F.col(f"{t}z").alias("z"))
        for i, t in enumerate("abc")
    ]
    top = F.greatest(*corners)
    return tri.withColumn("_own", top).select(
        *tri.columns, *[F.col("_own")[c].alias(f"own_{c}") for c in ("x", "y", "z")]
    ).drop("_own")


def clip_faces(tri: DataFrame, corners: Sequence[tuple[float, float]], eps: float = 0.0, inverse: bool = False) -> DataFrame:
    """Keep (or drop) the faces whose owner vertex is inside the box: no face is in two tiles."""
    owned = face_owner(tri)
    inside = in_window([F.col("own_x"), F.col("own_y"), F.col("own_z")], ordered_window(corners, eps))
    return owned.where(~inside if inverse else inside)


def halfspace(coord: Column, cut: float, sign: int) -> Column:
    """Point on the inner side of an axis-parallel plane."""
    return (coord - F.lit(cut)) * F.lit(sign) >= 0


def project_pinhole(m: Sequence[float], p: Sequence[Column]) -> list[Column]:
    """Image position (u, v) and depth under a row-major 3x4 matrix."""
    row = [G.dot([F.lit(float(c)) for c in m[i : i + 3]], p) + F.lit(float(m[i + 3])) for i in (0, 4, 8)]
    return [row[0] / row[2], row[1] / row[2], row[2]]


def in_all_frames(df: DataFrame, axes: Sequence[str], cams: list[dict]) -> DataFrame:
    """Points that fall inside the image of every camera (a short parameter list)."""
    p = [F.col(a) for a in axes]
    tests = []
    for cam in cams:
        u, v, depth = project_pinhole(cam["m"], p)
        tests.append((depth > 0) & (u >= 0) & (u <= cam["width"]) & (v >= 0) & (v <= cam["height"]))
    return df.where(G.all_of(tests))


def _left_of(y: Column, z: Column, p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    """Does the edge p-q pass z, from one side to the other, at a larger y?

    One end of the span belongs to it, and the crossing is always computed from the lower end, so
    faces that share the edge get the same answer, rounding included.
    """
    low = F.least(F.struct(p[1].alias("z"), p[0].alias("y")), F.struct(q[1].alias("z"), q[0].alias("y")))
    high = F.greatest(F.struct(p[1].alias("z"), p[0].alias("y")), F.struct(q[1].alias("z"), q[0].alias("y")))
    spans = (low["z"] <= z) & (z < high["z"])
    at = low["y"] + (z - low["z"]) / F.when(high["z"] > low["z"], high["z"] - low["z"]) * (high["y"] - low["y"])
    return F.coalesce(spans & (y < at), F.lit(False))


def on_triangle(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """Point exactly on a triangle, borders included; never on one without area."""
    u, v, w = G.sub(b, a), G.sub(c, a), G.sub(p, a)
    n = G.cross(u, v)
    size = F.when(G.dot(n, n) > 0, G.dot(n, n))
    s, t = G.dot(G.cross(w, v), n) / size, G.dot(G.cross(u, w), n) / size
    return F.coalesce((G.dot(w, n) == 0) & (s >= 0) & (t >= 0) & (s + t <= 1), F.lit(False))


def inside_mesh(points: DataFrame, pid: str, axes: Sequence[str], tri: DataFrame, mesh: str | None = None) -> DataFrame:
    """Points inside closed surfaces: an odd number of faces lies in direction +x.

    A surface whose faces all fit a cell is decided in the task of the cell; see ``_decided``.  For surfaces with larger
    faces, and for points that share an id, crossings are told by the grid join and counted apart.  A ray through an
    edge or a corner meets the faces there by a half-open rule, so each crossing counts once.  Points
    on a face are inside.  With ``mesh`` the faces of different meshes are counted apart, and a point
    in any of them is inside.
    """
    lo = lambda c: F.least(F.col(f"a{c}"), F.col(f"b{c}"), F.col(f"c{c}"))
    hi = lambda c: F.greatest(F.col(f"a{c}"), F.col(f"b{c}"), F.col(f"c{c}"))
    shape = tri.select(
        (F.col(mesh) if mesh else F.lit(0)).alias("_mesh"),
        *CORNERS,
        lo("x").alias("_lx"), hi("x").alias("_hx"), lo("y").alias("_ly"), hi("y").alias("_hy"), lo("z").alias("_lz"), hi("z").alias("_hz"),
    )
    # a hair wider, so that rounding loses no point on a face
    slack = (F.abs(F.min("_lx")) + F.abs(F.max("_hx")) + 1.0) * 1e-9
    sizes = [f(F.col(f"_h{c}") - F.col(f"_l{c}")).cast("double").alias(f"_{n}{c}") for c in "yz" for f, n in ((F.sum, "sum"), (F.max, "max"))]
    ends = shape.groupBy("_mesh").agg((F.min("_lx") - slack).alias("_sx"), (F.max("_hx") + slack).alias("_ex"), F.count("*").alias("_faces"), *sizes)
    ends = stored(ends.withColumnRenamed("_mesh", "_of"), "meshes")
    total = ends.agg(F.sum("_faces"), F.sum((F.col("_ex") - F.col("_sx")) * F.col("_faces")), F.sum("_sumy"), F.sum("_sumz")).first()
    size = [float(v / total[0]) if v else 1.0 for v in total[1:]]
    fits = (F.col("_maxy") <= F.lit(CELL * size[1])) & (F.col("_maxz") <= F.lit(CELL * size[2]))
    ends = ends.select("_of", "_sx", "_ex", F.coalesce(fits, F.lit(False)).alias("_fits"))
    shape = shape.drop("_lx", "_hx").join(ends, F.col("_mesh").eqNullSafe(F.col("_of"))).drop("_of")
    shape = stored(shape, "faces")  # counted and joined
    probe = points.select(F.col(pid).alias("_pid"), *[F.col(c).alias(f"_p{n}") for c, n in zip(axes, "xyz")])
    alone = probe.groupBy("_pid").agg(F.count("*").alias("_n")).where("_n = 1").select(F.col("_pid").alias("_id"))
    probe = probe.join(alone.withColumn("_alone", F.lit(True)), F.col("_pid") == F.col("_id"), "left").drop("_id")
    probe = stored(probe, "points")
    once, again = probe.where("_alone").drop("_alone"), probe.where("_alone is null").drop("_alone")
    fit, rest = shape.where("_fits").drop("_fits"), shape.where("not _fits").drop("_fits")
    inside = _decided(once, fit, size).unionByName(_counted(once, rest, size)).unionByName(_counted(again, shape.drop("_fits"), size))
    return points.join(inside.distinct().withColumnRenamed("_pid", pid), pid, "left_semi")


def _counted(probe: DataFrame, shape: DataFrame, size: Sequence[float]) -> DataFrame:
    """(_pid) inside a surface, by the crossings of each point and surface.

    Only faces whose (y, z) bounds hold the point are met, through the grid join, and only by points between the
    ends of their surface on x, so what is counted per point and mesh follows the boxes of the meshes.
    """
    a, b, c = (G.cols(f"{t}x", f"{t}y", f"{t}z") for t in "abc")
    p = G.cols("_px", "_py", "_pz")
    edges = [_left_of(p[1], p[2], (q[1], q[2]), (r[1], r[2])).cast("int") for q, r in ((a, b), (b, c), (c, a))]
    n = G.cross(G.sub(b, a), G.sub(c, a))
    # x where the ray meets the face's plane; a face seen edge-on is not crossed
    x_hit = a[0] - (n[1] * (p[1] - a[1]) + n[2] * (p[2] - a[2])) / F.when(n[0] != 0, n[0])
    crosses = ((edges[0] + edges[1] + edges[2]) % 2 == 1) & (x_hit > p[0])
    hits = box_join(probe, shape, [Axis("_px", "_px", "_sx", "_ex", size[0]), Axis("_py", "_py", "_ly", "_hy", size[1]), Axis("_pz", "_pz", "_lz", "_hz", size[2])])
    seen = hits.select("_pid", "_mesh", F.coalesce(crosses, F.lit(False)).alias("_hit"), on_triangle(p, a, b, c).alias("_on"))
    each = seen.groupBy("_pid", "_mesh").agg(F.count_if("_hit").alias("_n"), F.max("_on").alias("_on"))
    return each.where((F.col("_n") % 2 == 1) | F.col("_on")).select("_pid")


def _decided(probe: DataFrame, shape: DataFrame, size: Sequence[float]) -> DataFrame:
    """(_pid) inside a surface, for points with an id of their own and surfaces whose faces fit a cell.

    Points and faces are dealt out by the cells of a grid, faces by their (y, z) bounds and the ends of their surface on x.
    In its cell a point meets every face that can count, so a surface is decided there and no crossing is
    shuffled; a point that is inside one surface asks no more.
    """
    grid = [Axis("_px", "_px", "_sx", "_ex", CELL * size[0]), Axis("_py", "_py", "_ly", "_hy", CELL * size[1]), Axis("_pz", "_pz", "_lz", "_hz", CELL * size[2])]
    none = probe.select("_pid").where(F.lit(False))
    both = listed(probe, shape, grid, floor=0, whole=True)
    if both is None:
        return none
    ls, rs, keys, _ = both
    ls, rs, on, tasks = pieces(ls.select(*probe.columns, *keys), rs.select(*shape.columns, *keys), keys, None, together=["_mesh"])
    if not tasks:
        return none
    dealt = rs.withColumn("_of", F.lit(0)).unionByName(ls.withColumn("_of", F.lit(1)), allowMissingColumns=True)
    dealt = dealt.repartition(tasks, *on).sortWithinPartitions(*on, "_of", "_mesh")
    return dealt.mapInArrow(_Inside(on), T.StructType([dealt.schema["_pid"]]))


class _Inside:
    """The points of a cell that are inside a surface, for a partition sorted by cell, faces first and by surface.

    A cell's faces are held, which its pieces bound; points stream past them.
    """

    def __init__(self, on: list[str]):
        self._on = on

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for faces, points in by_cell(batches, self._on, self._faces):
            at = [number(points, f"_p{c}") for c in "xyz"]
            hit = [lo + self._met([c[lo : lo + POINTS] for c in at], *faces) for lo in range(0, points.num_rows, POINTS)]
            yield from points.select(["_pid"]).take(np.concatenate(hit)).combine_chunks().to_batches()

    @staticmethod
    def _faces(rows: pa.Table):
        code = rows["_mesh"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, rows.num_rows]
        return first, {c: number(rows, c) for c in (*CORNERS, "_ly", "_hy", "_lz", "_hz", "_sx", "_ex")}

    @staticmethod
    def _met(at: list[np.ndarray], first: np.ndarray, face: dict[str, np.ndarray]) -> np.ndarray:
        """Places of the points that are inside; ``first`` are the places where surfaces begin."""
        left, begin = np.arange(len(at[0])), 0
        while begin < len(first) - 1 and len(left):
            # whole surfaces, about FACES faces of them
            end = max(begin + 1, int(np.searchsorted(first, first[begin] + FACES, "right")) - 1)
            n = end - begin
            crossed, inside = np.zeros(len(left) * n, np.int64), np.zeros(len(left) * n, bool)
            x, y, z = (c[left, None] for c in at)
            for lo in range(first[begin], first[end], FACES):
                some = slice(lo, min(lo + FACES, first[end]))
                near = (y >= face["_ly"][some]) & (y <= face["_hy"][some]) & (z >= face["_lz"][some]) & (z <= face["_hz"][some])
                i, f = np.nonzero(near & (x >= face["_sx"][some]) & (x <= face["_ex"][some]))
                f = f + lo
                crosses, touches = crossings([c[left[i]] for c in at], *[[face[f"{t}{c}"][f] for c in "xyz"] for t in "abc"])
                place = i * n + np.searchsorted(first, f, "right") - 1 - begin
                crossed += np.bincount(place[crosses], minlength=len(crossed))
                inside[place[touches]] = True
            inside |= crossed % 2 == 1
            left, begin = left[~inside.reshape(len(left), n).any(axis=1)], end
        return np.setdiff1d(np.arange(len(at[0])), left)


def crossings(p, a, b, c) -> tuple[np.ndarray, np.ndarray]:
    """Whether the rays from p in direction +x cross the triangles a, b, c, as ``_left_of`` tells for edges, and ``on_triangle``."""
    with np.errstate(all="ignore"):
        left = np.zeros(len(p[0]), np.int64)
        for q, r in ((a, b), (b, c), (c, a)):
            swap = (r[2] < q[2]) | ((r[2] == q[2]) & (r[1] < q[1]))
            (ly, lz), (hy, hz) = ([np.where(swap, r[k], q[k]) for k in (1, 2)], [np.where(swap, q[k], r[k]) for k in (1, 2)])
            left += (lz <= p[2]) & (p[2] < hz) & (p[1] < ly + (p[2] - lz) / (hz - lz) * (hy - ly))
        sub = lambda q, r: [x - y for x, y in zip(q, r)]
        dot = lambda q, r: q[0] * r[0] + q[1] * r[1] + q[2] * r[2]
        cross = lambda q, r: [q[1] * r[2] - q[2] * r[1], q[2] * r[0] - q[0] * r[2], q[0] * r[1] - q[1] * r[0]]
        u, v, w = sub(b, a), sub(c, a), sub(p, a)
        n = cross(u, v)
        # x where the ray meets the face's plane; a face seen edge-on is not crossed
        hit = (n[0] != 0) & (a[0] - (n[1] * w[1] + n[2] * w[2]) / n[0] > p[0])
        size = dot(n, n)
        s, t = dot(cross(w, v), n) / size, dot(cross(u, w), n) / size
        return (left % 2 == 1) & hit, (size > 0) & (dot(w, n) == 0) & (s >= 0) & (t >= 0) & (s + t <= 1)


def covered_share(df: DataFrame, covered: Column, weight: Column, limit: float) -> DataFrame:
    """Share of covered area and whether the sparse mode pays off."""
    share = F.sum(F.when(covered, weight).otherwise(0.0)) / F.sum(weight)
    return df.agg(share.alias("ratio")).withColumn("sparse", F.col("ratio") < F.lit(limit))


def compatible_extents(
    left: DataFrame, right: DataFrame, systems: tuple[str, str], bounds: Sequence[Axis]
) -> DataFrame:
    """Pairs in one coordinate system whose closed extents overlap."""
    return box_join(left, right, bounds, equal=[systems], task_pairs=None)
