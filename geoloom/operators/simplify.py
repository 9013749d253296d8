"""Fewer faces by edge collapse with error quadrics.

Every vertex carries the sum of its faces' squared plane distances, weighted by area, as ten numbers.  In a
round all edges are collapsed that are cheaper than every edge at their ends and at the neighbours of their ends.
Such edges share no face, so each can be tested and applied on its own; the work of a round is a few joins
and aggregates by vertex, all combined before their shuffle, and no neighbourhood is gathered in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geom as G
from geoloom.operators.filters import face_points
from geoloom.operators.mesh import corner_vectors, corners, drop_collapsed, edges, remap
from geoloom.session import stored

TERMS = [(i, j) for i in range(4) for j in range(i, 4)]
Q = [f"q{i}{j}" for i, j in TERMS]
#: Part of the cheapest edges a round looks at, at least; more where more is left to remove.
LEAST_SHARE = 0.25
#: Weight of an edge's length in the order of collapses, so that flat parts keep well-formed faces.
SHORT = 1e-3


def vertex_quadrics(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """(vid, q00..q33): sums over the faces of a vertex of area times the squared distance from their planes.

    Faces without area or with a vertex that has no row add nothing.
    """
    a, b, c = corner_vectors()
    n = G.cross(G.sub(b, a), G.sub(c, a))
    plane = face_points(faces.select("v0", "v1", "v2"), verts).select("v0", "v1", "v2", *[v.alias(f"h{i}") for i, v in enumerate([*n, -G.dot(n, a)])])
    size = F.sqrt(sum(F.col(f"h{i}") * F.col(f"h{i}") for i in range(3)))
    plane = plane.withColumn("size", size).where("size > 0")
    # the planes are not unit vectors: size is their length and twice the area
    part = [(F.col(f"h{i}") * F.col(f"h{j}") / (2 * F.col("size"))).alias(q) for (i, j), q in zip(TERMS, Q)]
    return corners(plane.select("v0", "v1", "v2", *part)).groupBy("vid").agg(*[F.sum(q).alias(q) for q in Q])


def quadric_error(at: list[Column], q: list[Column] | None = None) -> Column:
    """Area times squared distance of a place from the planes in a quadric."""
    h = [*at, F.lit(1.0)]
    return sum((1 if i == j else 2) * v * h[i] * h[j] for (i, j), v in zip(TERMS, q or [F.col(n) for n in Q]))


def _lowest_place() -> tuple[list[Column], Column]:
    """Where the quadric is least, and whether that is well determined."""
    m = [[F.col(f"q{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    rows = [G.cross(m[1], m[2]), G.cross(m[2], m[0]), G.cross(m[0], m[1])]
    det = G.dot(m[0], rows[0])
    right = [-F.col(f"q{i}3") for i in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]
    return [F.try_divide(sum(rows[k][i] * right[k] for k in range(3)), det) for i in range(3)], F.abs(det) > 1e-4 * F.pow(trace / 3, 3)


def edge_costs(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """(a, b, cost, rank, x, y, z, from_a): edges that may collapse, the error, their order, where to, and which end's id stays.

    ``verts`` have vid, position, quadric and ``fixed``.  An edge must have two faces and at most one fixed
    end, which then is the place.  Else it is the least of the quadrics' sum, if that is well determined and
    not farther from the middle than the edge is long, or the best of both ends and the middle.
    """
    e = edges(faces).where("n = 2 AND a <> b").select("a", "b")
    for t in "ab":
        e = e.join(verts.select(F.col("vid").alias(t), *[F.col(c).alias(f"{t}_{c}") for c in ("x", "y", "z", "fixed", *Q)]), t)
    e = e.where("NOT (a_fixed AND b_fixed)")
    ends = {t: G.cols(f"{t}_x", f"{t}_y", f"{t}_z") for t in "ab"}
    # inline keeps the sums as columns: the many terms below read them and do not repeat them
    sums = [(F.col(f"a_{q}") + F.col(f"b_{q}")).alias(q) for q in Q]
    e = e.select("a", "b", "a_fixed", "b_fixed", *ends["a"], *ends["b"], F.inline(F.array(F.struct(*sums))))
    low, sure = _lowest_place()
    e = e.select("*", F.inline(F.array(F.struct(*[v.alias(f"low_{c}") for c, v in zip("xyz", low)], sure.alias("sure")))))
    middle = [(p + q) / 2 for p, q in zip(ends["a"], ends["b"])]
    low = G.cols("low_x", "low_y", "low_z")
    side, off = G.sub(ends["a"], ends["b"]), G.sub(low, middle)
    place = lambda p, k: F.struct(F.greatest(F.lit(0.0), quadric_error(p)).alias("cost"), F.lit(k).alias("k"), *[v.alias(c) for c, v in zip("xyz", p)])
    free = F.array(
        F.when(~F.col("b_fixed"), place(ends["a"], 1)),
        F.when(~F.col("a_fixed"), place(ends["b"], 2)),
        F.when(~F.col("a_fixed") & ~F.col("b_fixed"), place(middle, 0)),
        F.when(~F.col("a_fixed") & ~F.col("b_fixed") & F.col("sure") & (G.dot(off, off) <= G.dot(side, side)), place(low, 3)),
    )
    long = SHORT * (F.col("q00") + F.col("q11") + F.col("q22")) * G.dot(side, side)
    best = F.array(F.array_min(F.filter(free, lambda p: p.isNotNull())))
    e = e.select("a", "b", F.inline(best), long.alias("long"), (~F.col("b_fixed")).alias("from_a"))
    return e.select("a", "b", "cost", (F.col("cost") + F.col("long")).alias("rank"), "x", "y", "z", "from_a")


def _independent(cand: DataFrame, faces: DataFrame) -> DataFrame:
    """Candidates (a, b, key, ..) with the least key of all candidates at their ends and at the ends' neighbours."""
    both = lambda x, y, v: F.inline(F.array(F.struct(F.col(x).alias("vid"), v(y)), F.struct(F.col(y).alias("vid"), v(x))))
    own = stored(cand.select(both("a", "b", lambda _: F.col("key").alias("key"))).groupBy("vid").agg(F.min("key").alias("least")), "least")
    near = edges(faces).select("a", "b")
    for t in "ab":
        near = near.join(own.select(F.col("vid").alias(t), F.col("least").alias(f"least_{t}")), t, "left")
    told = near.select(both("a", "b", lambda o: F.col(f"least_{o}").alias("least"))).unionByName(own)
    round_ = told.groupBy("vid").agg(F.min("least").alias("least"))
    for t in "ab":
        cand = cand.join(round_.select(F.col("vid").alias(t), F.col("least").alias(f"least_{t}")), t)
    return cand.where((F.col("key") <= F.col("least_a")) & (F.col("key") <= F.col("least_b"))).drop("least_a", "least_b")


def _around(chosen: DataFrame, faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Faces at the ends of the chosen edges: (a, b, fid, at_a, at_b, others, turned)."""
    ends = chosen.select("a", "b", "x", "y", "z", F.explode(F.array("a", "b")).alias("vid"))
    at = corners(faces.select("fid", "v0", "v1", "v2")).join(ends, "vid")
    hit = at.groupBy("a", "b", "fid").agg(F.bool_or(F.col("vid") == F.col("a")).alias("at_a"), F.bool_or(F.col("vid") == F.col("b")).alias("at_b"), *[F.first(c).alias(f"to_{c}") for c in "xyz"])
    tri = face_points(hit.join(faces.select("fid", "v0", "v1", "v2"), "fid"), verts.select("vid", "x", "y", "z"))
    old = corner_vectors()
    gone = [F.col(v).isin(F.col("a"), F.col("b")) for v in ("v0", "v1", "v2")]
    new = [[F.when(g, F.col(f"to_{c}")).otherwise(p) for c, p in zip("xyz", pt)] for g, pt in zip(gone, old)]
    normal = lambda p: G.cross(G.sub(p[1], p[0]), G.sub(p[2], p[0]))
    tri = tri.select("*", F.inline(F.array(F.struct(*[v.alias(f"{t}{c}_") for t, n in (("o", normal(old)), ("n", normal(new))) for c, v in zip("xyz", n)]))))
    was, now = G.cols("ox_", "oy_", "oz_"), G.cols("nx_", "ny_", "nz_")
    turn = F.try_divide(G.dot(was, now), G.magnitude(was) * G.magnitude(now))
    others = F.array_sort(F.filter(F.array("v0", "v1", "v2"), lambda v: ~v.isin(F.col("a"), F.col("b"))))
    return tri.select("a", "b", "fid", "at_a", "at_b", others.alias("others"), F.when(~(F.col("at_a") & F.col("at_b")), F.coalesce(turn, F.lit(-1.0))).alias("turn"))


def _bad(around: DataFrame, cos_limit: float) -> DataFrame:
    """Chosen edges that would fold a face over, or join parts that only touch."""
    turned = around.where(F.col("turn") < cos_limit).select("a", "b")
    # two faces at different ends with the same far side would fall onto each other
    equal = around.where("NOT (at_a AND at_b)").groupBy("a", "b", "others").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    common = around.select("a", "b", "at_a", "at_b", F.explode("others").alias("w")).groupBy("a", "b", "w").agg(F.bool_or("at_a").alias("at_a"), F.bool_or("at_b").alias("at_b"))
    linked = common.groupBy("a", "b").agg(F.count_if(F.col("at_a") & F.col("at_b")).alias("n")).where("n <> 2").select("a", "b")
    return turned.unionByName(equal).unionByName(linked).distinct()


def simplify(faces: DataFrame, verts: DataFrame, target: int, max_error: float | None = None, cos_limit: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) after collapses down to at most ``target`` + 1 faces, cheapest edges first, of flat ones the shortest.

    A collapse costs its quadric's error (area times squared distance); dearer ones than ``max_error`` are not
    made.  None is made that turns a face by more than the angle of ``cos_limit`` or changes what is connected
    how: the Euler number, the border and edges of more than two faces stay, and so do the vertices on
    these.  So there may be more faces left than asked for.  Kept vertices and faces keep their ids and
    columns, positions become double.  Faces with a missing or repeated corner are left out.
    """
    names = faces.columns
    usable = drop_collapsed(faces.dropna(subset=["v0", "v1", "v2"]))
    whole = verts.dropna(subset=["vid", "x", "y", "z"])
    for k in range(3):
        usable = usable.join(whole.select(F.col("vid").alias(f"v{k}")), f"v{k}", "left_semi")
    mesh = stored(usable.select(*names), "faces")
    # quadrics lose their digits far from the origin
    mid = whole.agg(*[F.avg(c).alias(c) for c in "xyz"]).first()
    centre = {c: mid[c] or 0.0 for c in "xyz"}
    near = whole.select("vid", *[(F.col(c).cast("double") - centre[c]).alias(c) for c in "xyz"])
    odd = edges(mesh).where("n <> 2").select(F.explode(F.array("a", "b")).alias("vid")).distinct().withColumn("odd", F.lit(True))
    state = near.join(vertex_quadrics(mesh, near), "vid").join(odd, "vid", "left")
    state = stored(state.select("vid", "x", "y", "z", *Q, F.coalesce("odd", F.lit(False)).alias("fixed")), "points")
    barred, since = None, 0
    n = mesh.count()
    while n > target:
        cand = edge_costs(mesh, state)
        if max_error is not None:
            cand = cand.where(F.col("cost") <= max_error)
        if barred is not None:
            cand = cand.join(barred, ["a", "b"], "left_anti")
        cand = stored(cand.withColumn("key", F.struct("rank", F.xxhash64("a", "b").alias("h"), "a", "b")), "candidates")
        m = cand.count()
        if m == 0:
            if not since:
                break
            barred, since = None, 0
            continue
        need = math.ceil((n - target) / 2)
        share = min(1.0, max(LEAST_SHARE, 2 * need / m))
        dear = cand.agg(F.percentile_approx("rank", share)).first()[0]
        chosen = stored(_independent(cand, mesh).where(F.col("rank") <= dear), "chosen")
        around = stored(_around(chosen, mesh, state), "around")
        bad = stored(_bad(around, cos_limit), "bad")
        good = chosen.join(bad, ["a", "b"], "left_anti")
        good = stored(good.orderBy("key").limit(need) if chosen.count() > need else good, "collapses")
        done = good.select("a", "b", "x", "y", "z", F.when(F.col("from_a"), F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(F.col("from_a"), F.col("b")).otherwise(F.col("a")).alias("gone"))
        # what was refused waits until nothing else is left, and is tried again if something has changed by then
        barred = bad if barred is None else stored(barred.unionByName(bad), "barred")
        mesh = stored(drop_collapsed(remap(mesh, done.select("gone", "keep"), "gone", "keep")).select(*names), "faces")
        merged = done
        for t in ("keep", "gone"):
            merged = merged.join(state.select(F.col("vid").alias(t), F.col("fixed").alias(f"{t}_fixed"), *[F.col(q).alias(f"{t}_{q}") for q in Q]), t)
        merged = merged.select(F.col("keep").alias("vid"), "x", "y", "z", *[(F.col(f"keep_{q}") + F.col(f"gone_{q}")).alias(q) for q in Q], (F.col("keep_fixed") | F.col("gone_fixed")).alias("fixed"))
        away = done.select(F.explode(F.array("a", "b")).alias("vid"))
        state = stored(state.join(away, "vid", "left_anti").unionByName(merged), "points")
        before, n = n, mesh.count()
        since += before - n
    back = [(F.col(c) + centre[c]).alias(c) for c in "xyz"]
    left = verts.drop("x", "y", "z").join(state.select("vid", *back), "vid").select(*verts.columns)
    return left, mesh
