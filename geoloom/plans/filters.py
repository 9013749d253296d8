"""Filters and predicates on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geom as G
from geoloom.operators import filters as op
from geoloom.operators.gridjoin import Axis, box_join
from geoloom.operators.temporal import segment_hits_box
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table

XY, XY2 = ["x1", "y1"], ["x2", "y2"]
KEYS = ["l_orderkey", "l_linenumber", "x1", "y1"]


def _corners():
    """Low and high corner of the row's box and of the query box."""
    return G.cols(*XY), G.cols(*XY2), [F.lit(10.0), F.lit(20000.0)], [F.lit(20.0), F.lit(40000.0)]


@query(
    "box_window_bounds",
    with_sql("boxes")
    + "SELECT l_linenumber, COUNT(*) AS n, MIN(x1) AS xmin, MAX(x2) AS xmax, MIN(y1) AS ymin, MAX(y2) AS ymax "
    "FROM boxes WHERE x1 <= 20 AND x2 >= 10 AND y1 <= 40000 AND y2 >= 20000 GROUP BY l_linenumber",
)
def box_window_bounds(spark, sf):
    hit = op.window_filter(B.boxes(spark, sf), XY, XY2, [(10, 20), (20000, 40000)])
    return hit.groupBy("l_linenumber").agg(
        F.count("*").alias("n"),
        F.min("x1").alias("xmin"),
        F.max("x2").alias("xmax"),
        F.min("y1").alias("ymin"),
        F.max("y2").alias("ymax"),
    )


@query(
    "box_intersects",
    with_sql("boxes") + "SELECT l_orderkey, l_linenumber, x1, y1, x2, y2 FROM boxes "
    "WHERE x1 <= 20 AND x2 >= 10 AND y1 <= 40000 AND y2 >= 20000",
)
def box_intersects(spark, sf):
    return op.window_filter(B.boxes(spark, sf), XY, XY2, [(10, 20), (20000, 40000)]).drop("l_partkey")


@query(
    "box_contains",
    with_sql("boxes") + "SELECT l_orderkey, l_linenumber, x1, y1 FROM boxes "
    "WHERE x1 >= 10 AND x2 <= 20 AND y1 >= 20000 AND y2 <= 40000",
)
def box_contains(spark, sf):
    return B.boxes(spark, sf).where(G.contained(*_corners())).select(*KEYS)


@query(
    "point_location",
    with_sql("boxes") + ", q AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS px, 900.0 + s_acctbal * 9 AS py FROM supplier) "
    "SELECT s_suppkey, l_orderkey, l_linenumber, x1, y1 FROM boxes JOIN q "
    "ON x1 <= px AND px <= x2 AND y1 <= py AND py <= y2",
)
def point_location(spark, sf):
    q = table(spark, sf, "supplier").select(
        "s_suppkey",
        (F.col("s_suppkey") % 50).cast("double").alias("px"),
        (F.lit(900.0) + F.col("s_acctbal") * 9).alias("py"),
    )
    axes = [Axis("px", "px", "x1", "x2", 6.0), Axis("py", "py", "y1", "y2", 41.0)]
    return box_join(q, B.boxes(spark, sf), axes).select("s_suppkey", *KEYS)


@query(
    "box_touches",
    with_sql("boxes") + "SELECT l_orderkey, l_linenumber, x1, y1 FROM boxes WHERE x1 <= 20 AND x2 >= 10 "
    "AND y1 <= 40000 AND y2 >= 20000 AND (x1 = 20 OR x2 = 10 OR y1 = 40000 OR y2 = 20000)",
)
def box_touches(spark, sf):
    return B.boxes(spark, sf).where(G.touches(*_corners())).select(*KEYS)


@query(
    "box_measures",
    with_sql("boxes") + "SELECT l_orderkey, l_linenumber, x1, y1, round((x2 - x1) * (y2 - y1), 6) + 0.0 AS area, "
    "round(2 * ((x2 - x1) + (y2 - y1)), 6) + 0.0 AS margin, "
    "round((x1 + x2) / 2, 6) + 0.0 AS cx, round((y1 + y2) / 2, 4) + 0.0 AS cy, "
    "round(greatest(least(x2, 20.0) - greatest(x1, 10.0), 0.0) * greatest(least(y2, 40000.0) - greatest(y1, 20000.0), 0.0), 4) + 0.0 AS common, "
    "least(x1, 10.0) AS ux1, greatest(x2, 20.0) AS ux2, least(y1, 20000.0) AS uy1, greatest(y2, 40000.0) AS uy2, "
    "round(sqrt(pow(greatest(10.0 - x2, x1 - 20.0, 0.0), 2) + pow(greatest(20000.0 - y2, y1 - 40000.0, 0.0), 2)), 4) + 0.0 AS gap "
    "FROM boxes",
)
def box_measures(spark, sf):
    lo, hi, qlo, qhi = _corners()
    return B.boxes(spark, sf).select(
        *KEYS,
        rnd(G.area(lo, hi)).alias("area"),
        rnd(G.margin(lo, hi)).alias("margin"),
        rnd((lo[0] + hi[0]) / 2).alias("cx"),
        rnd((lo[1] + hi[1]) / 2, 4).alias("cy"),
        rnd(G.overlap_area(lo, hi, qlo, qhi), 4).alias("common"),
        F.least(lo[0], qlo[0]).alias("ux1"),
        F.greatest(hi[0], qhi[0]).alias("ux2"),
        F.least(lo[1], qlo[1]).alias("uy1"),
        F.greatest(hi[1], qhi[1]).alias("uy2"),
        rnd(G.box_distance(lo, hi, qlo, qhi), 4).alias("gap"),
    )


# segment from (value, s / 3600) to a point shifted by key remainders, against a fixed box;
# the SQL twin uses separating axes instead of clipping
@query(
    "segment_hits_box",
    with_sql("ev") + ", seg AS (SELECT event_id, value AS x0, CAST(event_id % 101 AS DOUBLE) AS y0, "
    "value + (user_id % 7 - 3) * 40 AS x1, CAST(event_id % 101 + (event_id % 13 - 6) * 10 AS DOUBLE) AS y1 FROM ev) "
    "SELECT event_id FROM seg WHERE least(x0, x1) <= 120 AND greatest(x0, x1) >= 60 "
    "AND least(y0, y1) <= 70 AND greatest(y0, y1) >= 30 "
    "AND least((x1-x0)*(30-y0)-(y1-y0)*(60-x0), (x1-x0)*(30-y0)-(y1-y0)*(120-x0), (x1-x0)*(70-y0)-(y1-y0)*(60-x0), (x1-x0)*(70-y0)-(y1-y0)*(120-x0)) <= 0 "
    "AND greatest((x1-x0)*(30-y0)-(y1-y0)*(60-x0), (x1-x0)*(30-y0)-(y1-y0)*(120-x0), (x1-x0)*(70-y0)-(y1-y0)*(60-x0), (x1-x0)*(70-y0)-(y1-y0)*(120-x0)) >= 0",
)
def segment_hits(spark, sf):
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    start = [v, (e % 101).cast("double")]
    end = [v + (u % 7 - 3) * 40, (e % 101 + (e % 13 - 6) * 10).cast("double")]
    box_lo, box_hi = [F.lit(60.0), F.lit(30.0)], [F.lit(120.0), F.lit(70.0)]
    return B.events(spark, sf).where(segment_hits_box(start, end, box_lo, box_hi)).select("event_id")


@query(
    "point_segment_distance",
    with_sql("pts") + ", p AS (SELECT *, least(greatest(((x - 5) * 40.0 + (y - 10) * 80.0) / 8000.0, 0), 1) AS t FROM pts) "
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "round(sqrt(pow(x - (5 + 40 * t), 2) + pow(y - (10 + 80 * t), 2)), 6) + 0.0 AS seg_dist, "
    "round(abs(40 * (10 - y) - (5 - x) * 80) / sqrt(8000.0), 6) + 0.0 AS line_dist, round(t, 9) + 0.0 AS place FROM p",
)
def point_segment(spark, sf):
    p = G.cols("x", "y")
    a, b = [F.lit(5.0), F.lit(10.0)], [F.lit(45.0), F.lit(90.0)]
    return B.points(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        rnd(G.point_segment_distance(p, a, b)).alias("seg_dist"),
        rnd(G.point_line_distance(p, a, b)).alias("line_dist"),
        rnd(G.segment_place(p, a, b), 9).alias("place"),
    )


@query(
    "point_in_triangle",
    with_sql("vert", "face", "tri") + ", p AS (SELECT *, (ax + bx + cx) / 3 + (mesh_id % 5 - 2) * 0.25 AS px, (ay + by_ + cy) / 3 AS py FROM tri), "
    "s AS (SELECT *, (bx-ax)*(py-ay)-(by_-ay)*(px-ax) AS s1, (cx-bx)*(py-by_)-(cy-by_)*(px-bx) AS s2, (ax-cx)*(py-cy)-(ay-cy)*(px-cx) AS s3 FROM p) "
    "SELECT fid, (s1 >= 0 AND s2 >= 0 AND s3 >= 0) OR (s1 <= 0 AND s2 <= 0 AND s3 <= 0) AS inside FROM s",
)
def point_in_triangle(spark, sf):
    tri = op.face_points(B.faces(spark, sf), B.vertices(spark, sf))
    a, b, c = G.cols("ax", "ay"), G.cols("bx", "by"), G.cols("cx", "cy")
    p = [
        (F.col("ax") + F.col("bx") + F.col("cx")) / 3 + (F.col("mesh_id") % 5 - 2) * 0.25,
        (F.col("ay") + F.col("by") + F.col("cy")) / 3,
    ]
    return tri.select("fid", G.in_triangle(p, a, b, c).alias("inside"))


@query(
    "clip_to_box",
    with_sql("pts") + "SELECT l_orderkey, l_linenumber, l_partkey, x, y, z FROM pts "
    "WHERE x BETWEEN 9.5 AND 20.5 AND y BETWEEN 29.5 AND 60.5 AND z BETWEEN 0.5 AND 8.5",
)
def clip_to_box(spark, sf):
    return op.clip_to_box(B.points(spark, sf), "xyz", [(20, 10), (30, 60), (8, 1)], 0.5).drop("l_suppkey")


OWNER_SQL = (
    with_sql("vert", "face", "tri") + ", own AS (SELECT *, CASE WHEN ax >= bx AND ax >= cx THEN ax WHEN bx >= cx THEN bx ELSE cx END AS own_x, "
    "CASE WHEN ax >= bx AND ax >= cx THEN ay WHEN bx >= cx THEN by_ ELSE cy END AS own_y, "
    "CASE WHEN ax >= bx AND ax >= cx THEN az WHEN bx >= cx THEN bz ELSE cz END AS own_z FROM tri) "
)
TILE = [(4, 12), (18, 6), (0.0, 3.0)]


def _tri(spark, sf):
    return op.face_points(B.faces(spark, sf), B.vertices(spark, sf))


@query(
    "max_x_owner",
    OWNER_SQL + "SELECT fid, own_x, own_y, own_z FROM own WHERE own_x BETWEEN 4 AND 12 AND own_y BETWEEN 6 AND 18 AND own_z BETWEEN 0 AND 3",
)
def max_x_owner(spark, sf):
    return op.clip_faces(_tri(spark, sf), TILE).select("fid", "own_x", "own_y", "own_z")


@query(
    "clip_inverse",
    OWNER_SQL + "SELECT fid FROM own WHERE NOT (own_x BETWEEN 4 AND 12 AND own_y BETWEEN 6 AND 18 AND own_z BETWEEN 0 AND 3)",
)
def clip_inverse(spark, sf):
    return op.clip_faces(_tri(spark, sf), TILE, inverse=True).select("fid")


@query(
    "halfspace_filter",
    "SELECT vec_id, label FROM embeddings WHERE embedding[3] >= 0 AND embedding[8] <= 0.1 "
    "AND embedding[1] BETWEEN -0.15 AND 0.15 AND embedding[2] BETWEEN -0.15 AND 0.15",
)
def halfspace_filter(spark, sf):
    e = F.col("embedding")
    inside = op.in_window([e[0].cast("double"), e[1].cast("double")], [(-0.15, 0.15), (-0.15, 0.15)])
    return (
        table(spark, sf, "embeddings")
        .where(op.halfspace(e[2].cast("double"), 0.0, 1) & op.halfspace(e[7].cast("double"), 0.1, -1) & inside)
        .select("vec_id", "label")
    )


# three looking-down cameras as parameters
CAMERAS = [
    {"m": [100, 0, 0, -1000 + 200 * i, 0, 100, 0, -2000, 0, 0, 1, 20 + i], "width": 320.0, "height": 240.0}
    for i in range(3)
]


def _frame_sql(i: int) -> str:
    u, v, d = f"(100 * x + {-1000 + 200 * i})", "(100 * y - 2000)", f"(z + {20 + i})"
    return f"({d} > 0 AND {u} / {d} BETWEEN 0 AND 320 AND {v} / {d} BETWEEN 0 AND 240)"


@query(
    "in_all_frames",
    with_sql("pts") + "SELECT l_orderkey, l_linenumber, l_partkey, x, y, z FROM pts WHERE " + " AND ".join(_frame_sql(i) for i in range(3)),
)
def in_all_frames(spark, sf):
    return op.in_all_frames(B.points(spark, sf), "xyz", CAMERAS).drop("l_suppkey")


@query(
    "extents_compatible",
    "WITH p AS (SELECT p_partkey AS id, p_brand AS sys, CAST(p_partkey % 200 AS DOUBLE) AS lo, "
    "CAST(p_partkey % 200 + p_size AS DOUBLE) AS hi, p_size * 1.0 / (1 + p_partkey % 4) AS res FROM part) "
    "SELECT a.id AS id_a, b.id AS id_b, round(a.res / b.res, 6) + 0.0 AS ratio FROM p a JOIN p b "
    "ON a.sys = b.sys AND a.lo <= b.hi AND b.lo <= a.hi AND a.id < b.id",
)
def extents_compatible(spark, sf):
    k = F.col("p_partkey")

    def side(tag):
        return table(spark, sf, "part").select(
            k.alias(f"id_{tag}"),
            F.col("p_brand").alias(f"sys_{tag}"),
            F.substring("p_brand", 7, 9).cast("double").alias(f"no_{tag}"),
            (k % 200).cast("double").alias(f"lo_{tag}"),
            (k % 200 + F.col("p_size")).cast("double").alias(f"hi_{tag}"),
            (F.col("p_size") * 1.0 / (1 + k % 4)).alias(f"res_{tag}"),
        )

    axes = [Axis("lo_a", "hi_a", "lo_b", "hi_b", 25.0)]
    pairs = op.compatible_extents(side("a").drop("no_a"), side("b").drop("no_b"), ("sys_a", "sys_b"), axes)
    return pairs.where("id_a < id_b").select("id_a", "id_b", rnd(F.col("res_a") / F.col("res_b")).alias("ratio"))


# one closed box surface (12 faces) per supplier; every third point sits on the lattice of corners,
# edges and faces; twin: the closed boxes that hold the point
@query(
    "inside_mesh",
    "WITH b AS (SELECT CAST(s_suppkey % 47 AS DOUBLE) AS lx, CAST(s_suppkey % 11 AS DOUBLE) AS ly, CAST(s_nationkey AS DOUBLE) AS lz, "
    "4.0 + s_suppkey % 3 AS w FROM supplier), "
    "p AS (SELECT c_custkey, c_custkey % 50 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 0.37 END AS x, "
    "c_custkey % 16 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 0.21 END AS y, c_nationkey + CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 0.43 END AS z FROM customer) "
    "SELECT DISTINCT c_custkey FROM p JOIN b ON x BETWEEN lx AND lx + w AND y BETWEEN ly AND ly + w AND z BETWEEN lz AND lz + w",
)
def inside_mesh(spark, sf):
    k = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(
        F.array((k % 47).cast("double"), (k % 11).cast("double"), F.col("s_nationkey").cast("double")).alias("o"),
        (F.lit(4.0) + k % 3).alias("w"),
        k.alias("mesh"),
    )
    # fixed values: the corners (bits x, y, z) of the two triangles on each side of a cube
    sides = [(0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5)]
    tris = F.array(
        *[
            F.struct(
                *[
                    (F.col("o")[ax] + (F.col("w") if corner >> ax & 1 else F.lit(0.0))).alias(f"{t}{c}")
                    for t, corner in zip("abc", side)
                    for ax, c in enumerate("xyz")
                ]
            )
            for side in sides
        ]
    )
    c = F.col("c_custkey")
    off = lambda n, by: F.when(c % n == 0, 0.0).otherwise(by)
    pts = table(spark, sf, "customer").select(
        "c_custkey", (c % 50 + off(3, 0.37)).alias("x"), (c % 16 + off(3, 0.21)).alias("y"), (F.col("c_nationkey") + off(6, 0.43)).alias("z")
    )
    return op.inside_mesh(pts, "c_custkey", ["x", "y", "z"], base.select("mesh", F.inline(tris)), "mesh").select("c_custkey")


@query(
    "cell_valid_ratio",
    "WITH c AS (SELECT l_partkey % 64 AS col, l_suppkey % 64 AS row, COUNT(*) AS n FROM lineitem GROUP BY ALL) "
    "SELECT round(SUM(CASE WHEN n >= 10 THEN 1.0 + col % 3 ELSE 0 END) / SUM(1.0 + col % 3), 6) + 0.0 AS ratio, "
    "SUM(CASE WHEN n >= 10 THEN 1.0 + col % 3 ELSE 0 END) / SUM(1.0 + col % 3) < 0.75 AS sparse FROM c",
)
def cell_valid_ratio(spark, sf):
    out = op.covered_share(B.pixels(spark, sf), F.col("n") >= 10, (F.col("col") % 3 + 1.0), 0.75)
    return out.select(rnd("ratio").alias("ratio"), "sparse")
