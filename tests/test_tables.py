"""Ordering, aggregates, graphs, covers, meshes and streams on small fixtures."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import aggregates as agg
from geoloom.operators import cover, graph, ordering
from geoloom.operators import mesh as M
from geoloom.operators import smooth as S
from geoloom.operators import tiles as T
from geoloom.session import planned_bytes, range_partitions
from geoloom.streaming import oplog


def hot_rows(n=500):
    rng = random.Random(1)
    return [(i, "hot" if i % 3 == 0 else f"k{i % 5}", float(rng.randrange(20)), float(rng.randrange(1, 9))) for i in range(n)]


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(hot_rows(), "id long, k string, v double, w double")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_row_numbers_and_neighbours(hot):
    got = {r.id: r.n for r in ordering.row_numbers(hot, ["v", "id"], "n").collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(hot_rows(), key=lambda r: (r[2], r[0])))}
    for step in (1, -1):
        nb = {r.id: r.o for r in ordering.neighbour_rows(hot, ["k"], ["v", "id"], {"o": "id"}, step).collect()}
        want = {}
        for rows in by_key(hot_rows()).values():
            rows.sort(key=lambda r: (r[2], r[0]))
            for i, r in enumerate(rows):
                j = i + step
                want[r[0]] = rows[j][0] if 0 <= j < len(rows) else None
        assert nb == want


def test_running_sums(hot):
    got = {r.id: r.s for r in ordering.running_sums(hot, ["k"], ["v", "id"], {"s": "w"}).collect()}
    for rows in by_key(hot_rows()).values():
        total = 0.0
        for r in sorted(rows, key=lambda r: (r[2], r[0])):
            assert got[r[0]] == total
            total += r[3]


def test_quantile_kth_and_weighted_median(hot):
    med = {r.k: r.m for r in agg.quantile(hot, ["k"], "v", 0.5, "m").collect()}
    q9 = {r.k: r.m for r in agg.quantile(hot, ["k"], "v", 0.9, "m").collect()}
    kth = {r.k: r.v for r in agg.kth_smallest(hot, ["k"], "v", 3).collect()}
    wm = {r.k: r.wmedian for r in agg.weighted_median(hot, ["k"], "v", "w", ["id"]).collect()}
    for k, rows in by_key(hot_rows()).items():
        v = np.sort([r[2] for r in rows])
        assert med[k] == np.median(v) and np.isclose(q9[k], np.quantile(v, 0.9)) and kth[k] == v[2]
        rows.sort(key=lambda r: (-r[2], r[0]))
        half, cum = sum(r[3] for r in rows) / 2, 0.0
        for i, r in enumerate(rows):
            if cum + r[3] >= half:
                s = (half - cum) / r[3]
                assert np.isclose(wm[k], r[2] if i == 0 else s * r[2] + (1 - s) * rows[i - 1][2])
                break
            cum += r[3]


def test_histogram_truncation(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, 0.0, 0.9, 5.0, 9.99, 10.0, -3.0)], "x double")
    got = agg.histogram(df, "x", 0.0, 10.0, 10).collect()
    assert [r.n for r in got] == [3, 0, 0, 0, 0, 1, 0, 0, 0, 1]
    assert got[0].actual_min == -3.0 and got[0].actual_max == 10.0


def test_principal_axes_plane_and_alignment(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(0, 1, (200, 3)) * [5, 2, 0]
    p[:, 2] = 0.5 * p[:, 0] + 3
    df = spark.createDataFrame([(1, *map(float, r)) for r in p] + [(2, 1.0, 2.0, 3.0)], "k int, x double, y double, z double")
    fit = {r.k: r for r in agg.plane_fit(df, ["k"], ["x", "y", "z"]).collect()}
    n = np.array([-0.5, 0, 1]) / np.sqrt(1.25)
    assert np.allclose([fit[1].nx, fit[1].ny, fit[1].nz], n, atol=1e-6) and fit[1].rms < 1e-6
    assert [r.axes for r in agg.principal_axes(df, ["k"], ["x", "y", "z"]).collect() if r.k == 2] == [np.eye(3).tolist()]
    ang = 0.7
    rot = np.array([[np.cos(ang), -np.sin(ang), 0], [np.sin(ang), np.cos(ang), 0], [0, 0, 1]])
    moved = p @ rot.T * 1.5 + [1, 2, 3]
    m = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(p, moved)], "a double, b double, c double, d double, e double, f double")
    out = agg.rigid_align(m, ["a", "b", "c"], ["d", "e", "f"])
    assert np.allclose(out["rot"], rot) and np.isclose(out["scale"], 1.5) and np.allclose(out["move"], [1, 2, 3])
    plane = agg.ransac_plane(df.where("k = 1").withColumn("id", F.monotonically_increasing_id()), ["x", "y", "z"], ["id"], 8, 1e-6).first()
    assert plane.inliers == 200


def test_point_normals(spark):
    rng = np.random.default_rng(8)
    p = rng.uniform(-5, 5, (120, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(0.3 * a)) for i, (a, b) in enumerate(p)], "id long, x double, y double, z double")
    n = np.array([-0.3, 0, 1]) / np.sqrt(1.09)
    for r in agg.point_normals(df, "id", ["x", "y", "z"], 12).collect():
        assert r.n == 12 and np.allclose([r.nx, r.ny, r.nz], n, atol=1e-6)


def test_weighted_median_looks_at_the_partitions_that_hold_the_half(spark, monkeypatch):
    """Two keys over many partitions: few partitions are summed row by row."""
    kept = []
    store = agg.stored

    def spy(df, name):
        kept.append(store(df, name))
        return kept[-1]

    monkeypatch.setattr(agg, "stored", spy)
    monkeypatch.setattr(ordering, "range_partitions", lambda df: 16)
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", i, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.permutation(4000), rng.integers(1, 9, 4000)))]
    rows += [("c", 9000, 5.0, 2.0), ("d", 9001, None, 1.0), (None, 9002, 1.0, 1.0), ("e", 9003, 4.0, None), ("e", 9004, 2.0, 3.0)]
    got = {r.k: r.wmedian for r in agg.weighted_median(spark.createDataFrame(rows, "k string, id long, v double, w double"), ["k"], "v", "w", ["id"]).collect()}
    assert kept[0].count() <= 8 and set(got) == set("abcde")
    for k in "ab":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[2])
        half, cum = sum(r[3] for r in own) / 2, np.cumsum([r[3] for r in own])
        i = int(np.argmax(cum >= half))
        s = (half - (cum[i] - own[i][3])) / own[i][3]
        assert np.isclose(got[k], s * own[i][2] + (1 - s) * own[i - 1][2])
    assert got["c"] == 5.0 and got["d"] is None and np.isclose(got["e"], 3.0)


@pytest.fixture(params=[False, True])
def small_tasks(monkeypatch, request):
    """With graphs left to the planner, and with links dealt to tasks and hubs apart."""
    if request.param:
        monkeypatch.setattr(graph, "TASK_LINKS", 40)
        monkeypatch.setattr(graph, "HUB_LINKS", 20)


def test_links_of_a_hub_are_not_dealt_to_one_task(spark, monkeypatch):
    """A star of 20,000 links: no task of the joins sees a tenth of them."""
    monkeypatch.setattr(graph, "TASK_LINKS", 1000)
    monkeypatch.setattr(graph, "HUB_LINKS", 1000)
    star = spark.range(20_000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("long").alias("v"))
    flip = star.select(F.col("v").alias("u"), F.col("u").alias("v"))
    met, low = graph._with_lowest(star.unionByName(flip), 20)
    most = met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert met.count() == 40_000 and most < 8000
    assert met.where("m <> 0").count() == 0 and low.count() == 20_001


def test_components_in_small_tasks(spark, small_tasks):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1001 + i) for i in range(150)] + [(7, 7), (None, 3), (5000, 1100)]
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1000 for i in range(1000, 1151)} | {5000: 1000}


def test_components_chain_star_and_random(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 200)] + [(1000, 1001 + i) for i in range(150)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    got = {r.id: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for x in list(parent) if any(x in e and e[0] != e[1] for e in edges)}


def greedy(sets):
    left, out = {i for s in sets.values() for i in s}, []
    while left:
        best = min(sets, key=lambda s: (-len(sets[s] & left), s))
        out.append((best, len(sets[best] & left)))
        left -= sets[best]
    return out


def test_set_cover_equals_sequential_greedy(spark):
    known = {1: {1, 5}, 2: {2, 4, 6, 7}, 3: {1, 2, 3}, 4: {4, 5, 6}, 5: {2, 5, 6}}
    rng = random.Random(4)
    wild = {s: {rng.randrange(60) for _ in range(rng.randrange(1, 12))} for s in range(50)}
    for sets in (known, wild):
        pairs = spark.createDataFrame([(s, i) for s, items in sets.items() for i in items], "s long, i long")
        got = [(r.s, r.gain) for r in cover.greedy_cover(pairs, "s", "i").orderBy("pick").collect()]
        assert got == greedy(sets)


CUBE_V = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
CUBE_F = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


@pytest.fixture(scope="module")
def cube(spark):
    v = spark.createDataFrame(CUBE_V, "vid long, x double, y double, z double")
    f = spark.createDataFrame([(i, *t, 0) for i, t in enumerate(CUBE_F)], "fid long, v0 long, v1 long, v2 long, mesh_id long")
    return v, f


def test_cube_measures(cube):
    from geoloom.operators.filters import face_points, inside_mesh

    v, f = cube
    m = M.face_measures(face_points(f, v)).agg(F.sum("area"), F.sum("volume")).first()
    assert np.isclose(m[0], 6.0) and np.isclose(m[1], 1.0)
    rep = M.mesh_report(f).first()
    assert (rep.n_vertices, rep.n_edges, rep.n_faces, rep.euler, rep.longest_loop) == (8, 18, 12, 2, 0)
    assert np.isclose(M.point_areas(face_points(f, v)).agg(F.sum("area")).first()[0], 6.0)
    assert M.vertex_border(f).where("is_border").count() == 0
    spark = v.sparkSession
    pts = spark.createDataFrame([(1, 0.3, 0.41, 0.52), (2, 1.3, 0.41, 0.52), (3, -0.2, 0.41, 0.52)], "id int, x double, y double, z double")
    assert [r.id for r in inside_mesh(pts, "id", ["x", "y", "z"], face_points(f, v)).collect()] == [1]


def test_orient_and_flip(cube):
    _, f = cube
    mixed = f.where("fid % 2 = 0").unionByName(M.flip(f.where("fid % 2 = 1")))
    got = sorted((r.fid, r.v0, r.v1, r.v2) for r in M.orient(mixed).collect())
    assert got == [(i, *t) for i, t in enumerate(CUBE_F)]


def test_split_crease_and_unshare(cube):
    v, f = cube
    # every cube corner belongs to three flat sides
    parts = M.split_crease(f, v, np.cos(0.5)).groupBy("vid").agg(F.count_distinct("part").alias("n")).collect()
    assert all(r.n == 3 for r in parts)
    uv, uf = M.unshare(f, v)
    assert uv.count() == 36 and uv.select("vid").distinct().count() == 36
    dv, df = M.dedup_vertices(uv, uf, ["x", "y", "z"])
    assert dv.count() == 8 and df.count() == 12


def test_merge_close_with_copies(spark):
    rng = np.random.default_rng(5)
    p = [(0.0, 0.0, 0.0)] * 60 + [(0.4 * i, 0.0, 0.0) for i in range(5)] + [tuple(map(float, r)) for r in rng.uniform(5, 9, (80, 3)).round(2)]
    v = spark.createDataFrame([(i, *r) for i, r in enumerate(p)], "vid long, x double, y double, z double")
    got = {r.vid: r.rep for r in M.close_groups(v, 0.4).collect()}
    a = np.array(p)
    near = ((a[:, None] - a[None]) ** 2).sum(axis=2) <= 0.4 * 0.4
    lab = np.arange(len(p))
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(p))])
        if (new == lab).all():
            break
        lab = new
    assert got == dict(enumerate(lab.tolist()))


def test_smoothing_keeps_border(spark):
    n = 5
    v = spark.createDataFrame([(r * n + c, float(c), float(r), float((r * c) % 3)) for r in range(n) for c in range(n)], "vid long, x double, y double, z double")
    f = []
    for r in range(n - 1):
        for c in range(n - 1):
            a = r * n + c
            f += [(2 * a, a, a + n, a + n + 1), (2 * a + 1, a, a + n + 1, a + 1)]
    fd = spark.createDataFrame(f, "fid long, v0 long, v1 long, v2 long")
    out = {x.vid: x.z for x in S.smooth(v, fd, S.TAUBIN, 3).collect()}
    for r in range(n):
        for c in range(n):
            if r in (0, n - 1) or c in (0, n - 1):
                assert out[r * n + c] == float((r * c) % 3)


def test_tile_border_repeats_outer_strip(spark):
    px = spark.createDataFrame([(c, r, 10 * r + c) for r in range(8) for c in range(8)], "col long, row long, v long")
    got = {(t.tx, t.ty, t.px, t.py): t.v for t in T.tile_border(px, 8, 8, 4, 2).collect()}
    assert len(got) == 4 * 64
    src = lambda p: p + 2 if p < 0 else p - 2 if p >= 8 else p
    for (tx, ty, x, y), v in got.items():
        assert v == 10 * src(ty * 4 + y - 2) + src(tx * 4 + x - 2)


def test_streamed_live_set_in_several_batches(spark):
    rng = random.Random(7)
    log, live, want = [], {}, set()
    for seq in range(400):
        op = rng.choice(["insert", "insert", "delete", "query"])
        i = seq if op == "query" else rng.randrange(30)
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        log.append((seq, op, i, x + 2, y, x, y + 2))
        if op == "insert":
            live[i] = (x, y)
        elif op == "delete":
            live.pop(i, None)
        else:
            want |= {(seq, j) for j, (a, b) in live.items() if abs(a - x) <= 2 and abs(b - y) <= 2}
    src = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "seq long, op string, id long, x1 double, y1 double, x2 double, y2 double"
    for b in range(4):
        spark.createDataFrame(log[b * 100 : b * 100 + 100], schema).coalesce(1).write.mode("append").parquet(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = oplog.run_to_table(oplog.live_set_answers(stream, 4), tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        assert {(r.query_id, r.id) for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_partitions_of_a_join_follow_the_tables_read(spark, tmp_path):
    """The planner takes joins for products, which asked for thousands of partitions for small tables."""
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("id AS k", "id % 7 AS v").write.parquet(path)
    df = spark.read.parquet(path)
    for n in "abc":
        df = df.join(spark.read.parquet(path).toDF("k", n), "k")
    assert planned_bytes(df) > 1 << 40 and range_partitions(df) == spark.sparkContext.defaultParallelism
