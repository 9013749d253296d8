"""Edge collapse with quadrics."""

import pytest
from pyspark.sql import functions as F

from geoloom.operators import loops as L
from geoloom.operators import mesh as M
from geoloom.operators import simplify as P
from geoloom.operators import surface as S
from geoloom.operators.filters import face_points

R = 3.2


@pytest.fixture(scope="module")
def ball(spark):
    n = 9
    i = F.col("id")
    voxels = spark.range(n**3).select((i % n - 4).alias("ix"), (F.floor(i / n) % n - 4).alias("iy"), (F.floor(i / n / n) - 4).alias("iz"))
    voxels = voxels.withColumn("w", F.sqrt(F.pow(F.col("ix") - 0.3, 2) + F.pow(F.col("iy") - 0.4, 2) + F.pow(F.col("iz") + 0.1, 2)) - R)
    verts, faces = S.level_surface(voxels, "w")
    return verts.cache(), faces.cache()


def grid(spark, n, bump=0.0):
    i = F.col("id")
    verts = spark.range(n * n).select(F.col("id").alias("vid"), (i % n).cast("double").alias("x"), F.floor(i / n).cast("double").alias("y"), (F.when(i == n * (n // 2) + n // 2, bump).otherwise(0.0)).alias("z"))
    quads = verts.where(f"x < {n - 1} AND y < {n - 1}").select(F.col("vid").alias("v"))
    two = F.array(
        F.struct((2 * F.col("v")).alias("fid"), F.col("v").alias("v0"), (F.col("v") + 1).alias("v1"), (F.col("v") + n + 1).alias("v2")),
        F.struct((2 * F.col("v") + 1).alias("fid"), F.col("v").alias("v0"), (F.col("v") + n + 1).alias("v1"), (F.col("v") + n).alias("v2")),
    )
    return verts, quads.select(F.inline(two))


def off(faces, verts):
    """Mean over faces of the distance of their middle from the ball."""
    at = M.face_measures(face_points(faces, verts))
    r = F.sqrt(F.pow(F.col("mx") - 0.3, 2) + F.pow(F.col("my") - 0.4, 2) + F.pow(F.col("mz") + 0.1, 2))
    return at.agg(F.avg(F.abs(r - R))).first()[0]


def test_ball_keeps_its_form(ball):
    verts, faces = ball
    want = faces.count() * 2 // 3
    few, less = P.simplify(faces, verts, want)
    assert want - 1 <= less.count() <= want + 1
    edges = M.edges(less)
    assert edges.where("n <> 2").isEmpty() and few.count() - edges.count() + less.count() == 2
    assert L.border_edges(less).isEmpty()
    # no face looks inwards
    out = M.face_measures(face_points(less, few)).where("nx * (mx - 0.3) + ny * (my - 0.4) + nz * (mz + 0.1) <= 0")
    assert out.isEmpty()
    # closer to the ball than clustering with at least as many faces left
    cell, n = 2.0, 0
    while n < less.count():
        cell *= 0.8
        clustered, merged = M.cluster_vertices(verts, faces, cell, list("xyz"))
        n = merged.count()
    assert off(less, few) < off(merged, clustered)


def test_flat_grid_goes_first_and_border_stays(spark):
    verts, faces = grid(spark, 9, bump=3.0)
    few, less = P.simplify(faces.repartition(5), verts, 100)
    assert 99 <= less.count() <= 101
    # flat collapses cost nothing, so the peak stays as it is
    peak = few.where("z > 0").collect()
    assert [(p.x, p.y, p.z) for p in peak] == [(4.0, 4.0, 3.0)]
    side = lambda f: {(r.s, r.d) for r in L.border_edges(f).collect()}
    assert side(less) == side(faces)
    flat = M.face_measures(face_points(less, few)).agg(F.sum("nz")).first()[0]
    assert flat == pytest.approx(2 * 8 * 8)


def test_hub_and_limits(spark):
    n = 300
    rim = spark.range(n).select(F.col("id").alias("vid"), F.cos(F.col("id") * 6.283185307179586 / n).alias("x"), F.sin(F.col("id") * 6.283185307179586 / n).alias("y"), F.lit(0.0).alias("z"))
    tips = spark.createDataFrame([(1000, 0.0, 0.0, 1.0), (1001, 0.0, 0.0, -1.0)], "vid long, x double, y double, z double")
    up = spark.range(n).select(F.col("id").alias("fid"), F.lit(1000).cast("long").alias("v0"), F.col("id").alias("v1"), ((F.col("id") + 1) % n).alias("v2"))
    down = spark.range(n).select((F.col("id") + n).alias("fid"), F.lit(1001).cast("long").alias("v0"), ((F.col("id") + 1) % n).alias("v1"), F.col("id").alias("v2"))
    verts, faces = rim.unionByName(tips), up.unionByName(down)
    few, less = P.simplify(faces, verts, 594)
    edges = M.edges(less)
    assert less.count() <= 595 and few.count() - edges.count() + less.count() == 2
    # a tetrahedron cannot lose an edge, and nothing is cheap enough for a limit below 0
    tetra = spark.createDataFrame([(0, 0, 2, 1), (1, 0, 1, 3), (2, 1, 2, 3), (3, 0, 3, 2)], "fid long, v0 long, v1 long, v2 long")
    at = spark.createDataFrame([(0, 0.0, 0.0, 0.0, "a"), (1, 1.0, 0.0, 0.0, "b"), (2, 0.0, 1.0, 0.0, "c"), (3, 0.0, 0.0, 1.0, "d")], "vid long, x double, y double, z double, key string")
    assert P.simplify(tetra, at, 2)[1].count() == 4
    assert P.simplify(faces, verts, 10, max_error=-1.0)[1].count() == 2 * n


def test_odd_rows(spark):
    verts, faces = grid(spark, 5)
    odd = faces.unionByName(spark.createDataFrame([(900, None, 1, 2), (901, 3, 3, 4), (902, 0, 1, 777)], "fid long, v0 long, v1 long, v2 long"))
    few, less = P.simplify(odd, verts.unionByName(spark.createDataFrame([(800, None, 0.0, 0.0)], "vid long, x double, y double, z double")), 26)
    assert 25 <= less.count() <= 27 and less.where("fid >= 900").isEmpty()
    none, nothing = P.simplify(faces.where("fid < 0"), verts, 0)
    assert nothing.isEmpty() and none.isEmpty()


def test_quadrics_are_plane_distances(spark):
    verts, faces = grid(spark, 4, bump=2.0)
    got = {r.vid: r for r in P.vertex_quadrics(faces, verts).join(verts, "vid").withColumn("e", P.quadric_error([F.col("x") + 1, F.col("y"), F.col("z") + 1])).collect()}
    tri = M.face_measures(face_points(faces, verts)).collect()
    for vid, row in got.items():
        total = 0.0
        for t in tri:
            if vid in (t.v0, t.v1, t.v2):
                size = (t.nx**2 + t.ny**2 + t.nz**2) ** 0.5
                d = ((row.x + 1 - t.ax) * t.nx + (row.y - t.ay) * t.ny + (row.z + 1 - t.az) * t.nz) / size
                total += size / 2 * d * d
        assert row.e == pytest.approx(total)
