"""Level surfaces, border loops and hole filling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import loops as L
from geoloom.operators import mesh as M
from geoloom.operators import surface as S
from geoloom.operators.filters import face_points


@pytest.fixture(scope="module")
def sphere(spark):
    n = 10
    i = F.col("id")
    voxels = spark.range(n**3).select((i % n - 4).alias("ix"), (F.floor(i / n) % n - 4).alias("iy"), (F.floor(i / n / n) - 4).alias("iz"))
    voxels = voxels.withColumn("w", F.sqrt(F.pow(F.col("ix") - 0.3, 2) + F.pow(F.col("iy") - 0.4, 2) + F.pow(F.col("iz") + 0.1, 2)) - 3.2)
    verts, faces = S.level_surface(voxels.repartition(7), "w")
    return voxels, verts.cache(), faces.cache()


def test_surface_of_a_sphere(sphere):
    _, verts, faces = sphere
    edges = M.edges(faces)
    assert verts.count() - edges.count() + faces.count() == 2
    assert edges.where("n <> 2").isEmpty() and L.border_edges(faces).isEmpty()
    assert faces.select("fid").distinct().count() == faces.count()
    row = M.face_measures(face_points(faces, verts)).agg(F.sum("volume").alias("v"), F.sum("area").alias("a")).first()
    assert 0.9 < row.v / (4 / 3 * math.pi * 3.2**3) < 1
    assert 0.95 < row.a / (4 * math.pi * 3.2**2) < 1.05
    far = verts.select(F.sqrt(F.pow(F.col("x") - 0.3, 2) + F.pow(F.col("y") - 0.4, 2) + F.pow(F.col("z") + 0.1, 2)).alias("r"))
    assert far.where("abs(r - 3.2) > 0.2").isEmpty()


def test_surface_ends_where_voxels_are_missing(spark, sphere):
    voxels, _, faces = sphere
    _, half = S.level_surface(voxels.where("iz <= 0"), "w")
    assert 0 < half.count() < faces.count() and not L.border_edges(half).isEmpty()
    assert L.border_loops(half).select("loop_s", "loop_d").distinct().count() == 1
    odd = voxels.unionByName(voxels.where("ix = 0")).unionByName(spark.createDataFrame([(None, 1, 1, 0.0), (99, 1, 1, None)], "ix long, iy long, iz long, w double"))
    assert S.level_surface(odd, "w")[1].count() == faces.count()
    none, nothing = S.level_surface(voxels.where("ix > 1000"), "w")
    assert none.isEmpty() and nothing.isEmpty()


def test_every_case_is_closed_inside_a_cell():
    """Sides of a tetrahedron's triangles that do not lie on its hull meet in pairs, and the table says so for each case."""
    table = S.case_table()
    assert len(table) == 6 * 16 * 2 * 3
    for k, path in enumerate(S.paths()):
        for inside in range(16):
            cells = [e for e in table[(k * 16 + inside) * 6 : (k * 16 + inside + 1) * 6] if e >= 0]
            crossed = {min(a, b) * 8 + max(a, b) for i, a in enumerate(path) for j, b in enumerate(path) if (inside >> i & 1) > (inside >> j & 1)}
            assert set(cells) == crossed and len(cells) in (0, 3, 6)


def walked(pairs):
    """Loops by walking on from the least edge that is left."""
    after = {s: d for s, d in pairs}
    out = set()
    while after:
        s = min(after)
        first, place, at = (s, after[s]), 0, s
        while at in after:
            d = after.pop(at)
            out.add((*first, place, at, d))
            at, place = d, place + 1
    return out


def test_loops_equal_a_walk(sphere):
    _, verts, faces = sphere
    gone = [r.vid for r in verts.orderBy(F.xxhash64("vid")).limit(3).collect()]
    open_ = faces.where(~(F.col("v0").isin(gone) | F.col("v1").isin(gone) | F.col("v2").isin(gone)))
    border = L.border_edges(open_).collect()
    assert len({r.s for r in border}) == len(border)
    assert {tuple(r) for r in L.border_loops(open_).collect()} == walked([(r.s, r.d) for r in border])


def test_one_loop_with_most_edges(spark):
    """A band with a border of 600 edges on either side: rounds, not steps, and no edge is lost."""
    n = 600
    rows = [(2 * i, i, (i + 1) % n, n + i) for i in range(n)] + [(2 * i + 1, (i + 1) % n, n + (i + 1) % n, n + i) for i in range(n)]
    loops = L.border_loops(spark.createDataFrame(rows, "fid long, v0 long, v1 long, v2 long"))
    got = {tuple(r) for r in loops.collect()}
    assert len(got) == 2 * n
    assert got == walked([(s, d) for _, _, _, s, d in got])


def test_known_loops_leave_the_rounds(spark, monkeypatch):
    """Many triangles and one band: rounds after the first few hold the band alone."""
    held = []
    keep = L.bucketed
    monkeypatch.setattr(L, "bucketed", lambda df, *a: held.append(keep(df, *a)) or held[-1])
    n = 200
    rows = [(2 * i, i, (i + 1) % n, n + i) for i in range(n)] + [(2 * i + 1, (i + 1) % n, n + (i + 1) % n, n + i) for i in range(n)]
    rows += [(1000 + i, 1000 + 3 * i, 1002 + 3 * i, 1001 + 3 * i) for i in range(300)]
    got = {tuple(r) for r in L.border_loops(spark.createDataFrame(rows, "fid long, v0 long, v1 long, v2 long")).collect()}
    assert got == walked([(s, d) for _, _, _, s, d in got]) and len(got) == 2 * n + 900
    assert held[0].count() == 2 * n + 900 and held[-2].count() == 2 * n


def test_filled_mesh_is_closed(spark, sphere):
    _, verts, faces = sphere
    gone = [r.vid for r in verts.orderBy(F.xxhash64("vid")).limit(3).collect()]
    open_ = faces.where(~(F.col("v0").isin(gone) | F.col("v1").isin(gone) | F.col("v2").isin(gone))).cache()
    more, added = L.fill_holes(open_, verts)
    whole = open_.unionByName(added.withColumn("fid", F.lit(-1).cast("long"))).cache()
    edges = M.edges(whole)
    assert edges.where("n <> 2").isEmpty()
    corners = M.corners(whole).select("vid").distinct().count()
    assert corners - edges.count() + whole.count() == 2
    volume = lambda f, v: M.face_measures(face_points(f, v)).agg(F.sum("volume")).first()[0]
    assert volume(whole, verts.unionByName(more)) == pytest.approx(volume(faces, verts), rel=0.1)
    kept, none = L.fill_holes(open_, verts, max_edges=2)
    assert kept.isEmpty() and none.isEmpty()


def test_holes_of_many_blocks(spark, sphere, monkeypatch):
    """Small blocks fill the same holes with the same faces, and sides away from the rings are not kept."""
    _, verts, faces = sphere
    gone = [r.vid for r in verts.orderBy(F.xxhash64("vid")).limit(3).collect()]
    open_ = faces.where(~(F.col("v0").isin(gone) | F.col("v1").isin(gone) | F.col("v2").isin(gone))).cache()
    held, keep = [], L.bucketed
    monkeypatch.setattr(L, "bucketed", lambda df, name, *a: (held.append((name, keep(df, name, *a))), held[-1][1])[1])
    _, added = L.fill_holes(open_, verts)
    once = sorted(tuple(r) for r in added.collect())
    assert [t.count() for name, t in held if name == "sides"][0] < M.edges(open_).count() / 2
    monkeypatch.setattr(L, "BLOCK", 2)
    assert sorted(tuple(r) for r in L.fill_holes(open_, verts)[1].collect()) == once


def test_chains_and_empty_meshes(spark):
    empty = spark.createDataFrame([], "fid long, v0 long, v1 long, v2 long")
    assert L.border_loops(empty).isEmpty()
    twisted = spark.createDataFrame([(0, 1, 2, 3), (1, 3, 2, 4), (2, 2, 5, 4), (3, 5, 2, 1)], "fid long, v0 long, v1 long, v2 long")
    rows = L.border_loops(twisted).collect()
    assert len(rows) == L.border_edges(twisted).count()


def test_holes_that_touch_are_closed_together(spark, monkeypatch):
    """Sheets full of holes that share vertices: closed in tasks, with the faces that the rounds over tables give."""
    rng = np.random.default_rng(3)
    n = 9
    verts = [(m * 100 + i * n + j, float(i), float(j), float(rng.integers(0, 4))) for m in range(2) for i in range(n) for j in range(n)]
    gone = set(rng.choice([m * 100 + i * n + j for m in range(2) for i in range(n - 1) for j in range(n - 1)], 45, replace=False).tolist())
    quads = [v for v, x, y, _ in verts if x < n - 1 and y < n - 1 and v not in gone]
    faces = spark.createDataFrame([f for v in quads for f in ((2 * v, v, v + n, v + n + 1), (2 * v + 1, v, v + n + 1, v + 1))], "fid long, v0 long, v1 long, v2 long")
    verts = spark.createDataFrame([(v, x, y, None if v == 40 else z) for v, x, y, z in verts], "vid long, x double, y double, z double")
    rounds, keep = [], L.bucketed
    monkeypatch.setattr(L, "bucketed", lambda df, name, *a: rounds.append(name) or keep(df, name, *a))
    rows = lambda: [sorted(tuple(r) for r in t.collect()) for t in L.fill_holes(faces, verts)]
    more, added = rows()
    assert "ears" not in rounds
    monkeypatch.setattr(L, "BLOCK", 40)
    mixed = rows()
    assert "ears" in rounds
    assert mixed[1] == added and [r[0] for r in mixed[0]] == [r[0] for r in more]
    whole = faces.unionByName(spark.createDataFrame(added, "v0 long, v1 long, v2 long").withColumn("fid", F.lit(-1).cast("long")))
    assert L.border_edges(whole).isEmpty()
