"""Points in meshes, alignments far from the origin, corner areas, regions in time, nearest boxes."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import aggregates, filters, joins, knn, mesh, temporal, voxel
from geoloom.operators.filters import inside_mesh

# fixed values: the corners (bits x, y, z) of the two triangles on each side of a cube
SIDES = [(0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5)]


def cube(mesh_id, low, size):
    out = []
    for side in SIDES:
        out.append((mesh_id, *[low[ax] + size * (corner >> ax & 1) for corner in side for ax in range(3)]))
    return out


FACES = "mesh int, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double"


@pytest.mark.parametrize("flipped", [False, True])
def test_points_of_a_lattice_in_a_cube(spark, flipped):
    """Centre, edges, corners, faces, and rays through all of them."""
    rows = cube(1, (0.0, 0.0, 0.0), 1.0)
    if flipped:
        rows = [(m, *r[6:9], *r[3:6], *r[0:3]) for m, *r in rows]
    steps = [-0.5, 0.0, 0.25, 0.5, 0.75, 1.0, 1.5]
    pts = [(i, *p) for i, p in enumerate(itertools.product(steps, repeat=3))]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double")
    got = {r.id for r in inside_mesh(df, "id", ["x", "y", "z"], spark.createDataFrame(rows, FACES), "mesh").collect()}
    assert got == {p[0] for p in pts if all(0 <= v <= 1 for v in p[1:])}


def test_points_outside_on_x_meet_no_face(spark, monkeypatch):
    """A row of cubes along x: a point is compared with the faces of the cube it is in, not with all it looks at."""
    met = []
    join = filters.box_join

    def counted(*a, **kw):
        met.append(join(*a, **kw))
        return met[-1]

    monkeypatch.setattr(filters, "box_join", counted)
    rows = [r for i in range(20) for r in cube(i, (3.0 * i, 0.0, 0.0), 1.0)]
    df = spark.createDataFrame([(i, 3.0 * i + x, 0.5, 0.25) for i in range(20) for x in (0.5,)] + [(100, 2.0, 0.5, 0.25), (101, 3.0, 0.5, 0.25)], "id int, x double, y double, z double")
    got = {r.id for r in inside_mesh(df, "id", ["x", "y", "z"], spark.createDataFrame(rows, FACES), "mesh").collect()}
    assert got == {*range(20), 101}
    assert met[0].count() <= 21 * 12


def test_surfaces_are_decided_in_their_cell(spark, monkeypatch):
    """Points in many cubes at once: no crossing leaves its task, except for large faces and for points that share an id."""
    met, join = [], filters.box_join
    monkeypatch.setattr(filters, "box_join", lambda *a, **kw: met.append(join(*a, **kw)) or met[-1])
    rng = random.Random(11)
    at = [tuple(float(rng.randrange(6)) for _ in range(3)) for _ in range(60)]
    cubes = [(o, 1.0 + i % 3) for i, o in enumerate(at)]
    pts = [(i, *[rng.choice([float(rng.randrange(9)), rng.uniform(0, 9)]) for _ in range(3)]) for i in range(200)]
    inside = lambda p, boxes: any(all(o[k] <= p[k] <= o[k] + w for k in range(3)) for o, w in boxes)
    tri = lambda boxes: spark.createDataFrame([r for i, (o, w) in enumerate(boxes) for r in cube(i, o, w)], FACES)
    ask = lambda rows, boxes: {r.id for r in inside_mesh(spark.createDataFrame(rows, "id int, x double, y double, z double"), "id", ["x", "y", "z"], tri(boxes), "mesh").collect()}
    monkeypatch.setattr(filters, "POINTS", 7)
    monkeypatch.setattr(filters, "FACES", 30)
    assert ask(pts, cubes) == {p[0] for p in pts if inside(p[1:], cubes)}
    assert sum(m.count() for m in met) == 0
    # one surface of large faces around the others, and two points with the id 0 outside all
    large = [*cubes, ((-50.0, -50.0, 4.0), 100.0)]
    assert ask([*pts, (500, -20.0, 0.0, 8.0), (0, 99.0, 99.0, 99.0)], large) >= {p[0] for p in pts[1:] if inside(p[1:], large)} | {500}
    assert sum(m.count() for m in met) > 0


def test_meshes_are_counted_apart(spark):
    rows = cube(1, (0.0, 0.0, 0.0), 2.0) + cube(2, (1.0, 0.0, 0.0), 2.0)
    df = spark.createDataFrame([(1, 1.5, 1.0, 1.0), (2, 2.5, 1.0, 1.0), (3, 3.5, 1.0, 1.0)], "id int, x double, y double, z double")
    tri = spark.createDataFrame(rows, FACES)
    assert {r.id for r in inside_mesh(df, "id", ["x", "y", "z"], tri, "mesh").collect()} == {1, 2}
    assert {r.id for r in inside_mesh(df, "id", ["x", "y", "z"], tri).collect()} == {2}  # one surface: even in the overlap


@pytest.mark.parametrize("far", [0.0, 6e6])
def test_alignments_far_from_the_origin(spark, far):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 10, (500, 2)) + far
    c, s = np.cos(0.3), np.sin(0.3)
    b = (a - far) @ np.array([[c, s], [-s, c]]) * 1.0 + far
    rows = [(*map(float, p), *map(float, q)) for p, q in zip(a, b)] + [(None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    fit = aggregates.rigid_align(df, ["ax", "ay"], ["bx", "by"])
    assert fit["n"] == 500
    assert np.arctan2(fit["rot"][1, 0], fit["rot"][0, 0]) == pytest.approx(0.3, abs=1e-8)
    assert fit["scale"] == pytest.approx(1.0, abs=1e-8)
    assert np.allclose(fit["scale"] * a @ fit["rot"].T + fit["move"], b, atol=1e-4)
    m = aggregates.affine_align(df, ["ax", "ay"], ["bx", "by"])
    assert np.allclose(m["matrix"], [[c, -s], [s, c]], atol=1e-8)
    assert np.allclose(a @ m["matrix"].T + m["move"], b, atol=1e-4)


def test_corner_areas_are_the_nearest_parts(spark):
    """Against a fine lattice in each triangle: acute, right, obtuse at each corner, without area."""
    shapes = [((0, 0), (4, 0), (2, 3)), ((0, 0), (4, 0), (0, 3)), ((0, 0), (6, 0), (1, 1)), ((6, 0), (1, 1), (0, 0)), ((1, 1), (0, 0), (6, 0)), ((0, 0), (1, 1), (2, 2))]
    rows = [(k * 3, k * 3 + 1, k * 3 + 2, *[float(v) for p in t for v in (*p, 0)]) for k, t in enumerate(shapes)]
    names = "v0 int, v1 int, v2 int, " + ", ".join(f"{t}{c} double" for t in "abc" for c in "xyz")
    got = {r.vid: r.area for r in mesh.point_areas(spark.createDataFrame(rows, names)).collect()}
    n = 400
    u, v = (np.indices((n, n)).reshape(2, -1) + 0.5) / n
    u, v = np.where(u + v > 1, 1 - u, u), np.where(u + v > 1, 1 - v, v)
    for k, t in enumerate(shapes[:-1]):
        p = np.array(t, float)
        at = p[0] + np.outer(u, p[1] - p[0]) + np.outer(v, p[2] - p[0])
        near = ((at[:, None] - p) ** 2).sum(2).argmin(1)
        area = abs(np.linalg.det(np.stack([p[1] - p[0], p[2] - p[0]]))) / 2
        for i in range(3):
            assert got[k * 3 + i] == pytest.approx(area * (near == i).mean(), rel=0.02)
    assert 15 not in got


def test_regions_over_an_interval(spark):
    one = spark.range(1)
    still = [((F.lit(10.0), F.lit(0.0)), (F.lit(12.0), F.lit(0.0)))]
    moving = [((F.lit(0.0), F.lit(1.0)), (F.lit(4.0), F.lit(1.0)))]
    point = [((F.lit(11.0), F.lit(-0.5)),) * 2]
    first = lambda span: tuple(one.select(*[c.alias(n) for c, n in zip(span, "abc")]).first())
    assert first(temporal.regions_meet(moving, still, F.lit(0), F.lit(60))) == (6.0, 12.0, True)
    assert first(temporal.region_holds(moving, still, F.lit(0), F.lit(60)))[:2] == (8.0, 10.0)
    start, end, may = first(temporal.region_holds(moving, point, F.lit(0), F.lit(5)))
    assert may and (start, end) == (pytest.approx(7 / 1.5), 5.0)
    rest = [((F.lit(0.0), F.lit(0.0)), (F.lit(4.0), F.lit(0.0)))]
    assert not first(temporal.regions_meet(rest, still, F.lit(0), F.lit(60)))[2]


def test_nearest_boxes_of_many_points_with_ties(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(0, 12, (150, 2)).astype(float)
    high = low + rng.integers(0, 4, (150, 2))
    high[0] = low[0] + 40  # its centre is far from most of what it holds
    q = rng.uniform(-3, 18, (40, 2)).round(1)
    b = spark.createDataFrame([(i, *map(float, (*l, *h))) for i, (l, h) in enumerate(zip(low, high))], "b long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], "q long, x double, y double")
    got = {}
    for r in knn.nearest_boxes_join(p, b, "q", ["x", "y"], "b", ["x1", "y1"], ["x2", "y2"], 4).collect():
        got.setdefault(r.q, {})[r.b] = r["rank"]
    for i, v in enumerate(q):
        gap = np.maximum(np.maximum(low - v, v - high), 0)
        d2 = (gap**2).sum(1)
        rank = {j: 1 + int((d2 < d2[j]).sum()) for j in range(150)}
        assert got[i] == {j: r for j, r in rank.items() if r <= 4}


def test_subvolumes_by_voxel_budget():
    for budget in (592_704, 600_000, 9_261):
        size, border = voxel.subvolume_size(0.5, budget)
        edge = round((size + 2 * border) / 0.5)
        assert edge**3 <= budget < (edge + 1) ** 3 and border == 5.0
    with pytest.raises(ValueError):
        voxel.subvolume_size(0.5, 8_000)


def test_poses_of_other_origins_are_refused(spark):
    a = spark.createDataFrame([(1.0, 1.0, 1.0, -31.0)], "x double, y double, r double, origin double")
    b = spark.createDataFrame([(1.0, 1.0, 1.0, -32.0)], "px double, py double, pr double, origin double")
    with pytest.raises(ValueError):
        joins.overlap_filter(a, b, ("x", "y", "r"), ("px", "py", "pr"), origin=["origin"])
    same = b.withColumn("origin", F.lit(-31.0))
    assert joins.overlap_filter(a, same, ("x", "y", "r"), ("px", "py", "pr"), origin=["origin"]).count() == 1


def test_grid_triangles_without_slivers(spark):
    cells = [(c, r, r * 10 + c, float(c), float(r), 500.0 if (c, r) == (5, 5) else 0.0) for c in range(10) for r in range(10)]
    grid = spark.createDataFrame(cells, "col int, row int, vid int, x double, y double, z double")
    full = mesh.triangulate_grid(grid, "col", "row", "vid", ["x", "y", "z"])
    trimmed = mesh.triangulate_grid(grid, "col", "row", "vid", ["x", "y", "z"], slivers=False)
    touching = full.where("v0 = 55 or v1 = 55 or v2 = 55").count()
    assert full.count() == 162 and trimmed.count() == 162 - touching


def test_normals_of_a_slanted_plane(spark):
    rng = np.random.default_rng(7)
    xy = rng.uniform(-5, 5, (300, 2))
    n = np.array([0.36, -0.48, 0.8])
    z = -(xy @ n[:2]) / n[2]
    df = spark.createDataFrame([(i, float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, z))], "id long, x double, y double, z double")
    for r in aggregates.point_normals(df, "id", ["x", "y", "z"], 8).collect():
        assert np.allclose([r.nx, r.ny, r.nz], n, atol=1e-6) and abs(r.spread) < 1e-9


def test_far_queries_do_not_meet_all_boxes(spark, monkeypatch):
    """Queries far above a slab of boxes, with copies, ids that repeat and a box without bounds, against brute force."""
    rng = np.random.default_rng(5)
    n, m = 3000, 20
    low = np.c_[rng.uniform(0, 50, (n, 2)), rng.uniform(0, 10, n)].round(1)
    high = low + rng.integers(1, 4, n)[:, None]
    low[1], high[1] = low[0], high[0]
    boxes = [(i % 2990, *map(float, low[i]), *map(float, high[i])) for i in range(n)] + [(9999, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    at = np.c_[rng.uniform(0, 50, (m, 2)), rng.uniform(60, 90, m)].round(1)
    at[0] = low[0]
    asked = [(q, *map(float, at[q])) for q in range(m)] + [(None, 0.0, 0.0, 0.0)]
    written, stored = [], knn.stored
    monkeypatch.setattr(knn, "stored", lambda df, name: written.append((name, stored(df, name))) or written[-1][1])
    b = spark.createDataFrame(boxes, "b long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    q = spark.createDataFrame(asked, "q long, x double, y double, z double")
    got = knn.nearest_boxes_join(q, b, "q", ["x", "y", "z"], "b", ["x1", "y1", "z1"], ["x2", "y2", "z2"], 3).collect()
    want = []
    for i in range(m):
        d2 = (np.maximum(np.maximum(low - at[i], at[i] - high), 0) ** 2).sum(1)
        rank = [int((d2 < v).sum()) + 1 for v in d2]
        want += [(i, j % 2990, rank[j]) for j in range(n) if rank[j] <= 3]
    assert sorted((r.q, r.b, r.rank) for r in got) == sorted(want)
    near = [df.count() for name, df in written if name == "near"]
    assert near and max(near) < n * m / 4
