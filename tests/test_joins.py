"""Grid joins, nearest neighbours and interval joins against brute force, also with hot cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import cameras, gridjoin, joins, knn, matching, temporal
from geoloom.operators.gridjoin import Axis, box_join, listed, pieces
from geoloom.operators.knn import knn_points, knn_vectors


def boxes(n, tag, seed, hot):
    """Boxes of very different sizes; with ``hot`` a third of them sit in one place."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = (5.0, 5.0) if hot and i % 3 == 0 else (rng.uniform(-50, 50), rng.uniform(-50, 50))
        w, h = (rng.choice([0.0, 0.5, 3.0, 40.0]) for _ in range(2))
        out.append((i, x, x + w, y, y + h))
    return out, [f"{tag}id", f"{tag}x1", f"{tag}x2", f"{tag}y1", f"{tag}y2"]


def meet(a, b):
    return a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4]


@pytest.fixture(params=["10m", "-1"])
def broadcasts(spark, request):
    """With a side small enough for every task, and with both sides dealt."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("task_pairs", [50, 4_000_000])
@pytest.mark.parametrize("sizes", [(300, 200), (300, 40), (40, 300)])
def test_box_join_equals_nested_loop(spark, broadcasts, hot, task_pairs, sizes):
    (la, lc), (ra, rc) = boxes(*sizes[:1], "l", 1, hot), boxes(*sizes[1:], "r", 2, hot)
    axes = [Axis("lx1", "lx2", "rx1", "rx2", 2.0), Axis("ly1", "ly2", "ry1", "ry2", 3.0)]
    got = box_join(spark.createDataFrame(la, lc), spark.createDataFrame(ra, rc), axes, task_pairs=task_pairs)
    pairs = [(r.lid, r.rid) for r in got.select("lid", "rid").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a[0], b[0]) for a in la for b in ra if meet(a, b)}


def most_pairs(ls, rs, keys):
    n = ls.groupBy(*keys).agg(F.count("*").alias("nl")).join(rs.groupBy(*keys).agg(F.count("*").alias("nr")), keys)
    return n.agg(F.max(F.col("nl") * F.col("nr"))).first()[0]


def test_crowded_cell_is_cut_into_pieces(spark):
    """200,000 rows a side in one cell: no task gets much more than its pairs."""
    left = spark.range(200_000).select(F.col("id").alias("l"), F.lit(0.25).alias("lx"), F.lit(0.75).alias("lh"))
    right = spark.range(200_000).select(F.col("id").alias("r"), F.lit(0.5).alias("rx"))
    ls, rs, keys, _ = listed(left, right, [Axis("lx", "lh", "rx", "rx", 1e6)])
    assert most_pairs(ls, rs, keys) == 200_000**2
    pl, pr, on, tasks = pieces(ls, rs, keys, 4_000_000)
    assert most_pairs(pl, pr, on) < 6_000_000 and tasks >= 10_000
    assert pl.count() == 200_000 * 100


def test_what_is_dealt_out_follows_the_rows(spark):
    """Twice the rows in one cell are four times the pairs: pieces grow, and so twice as much is dealt, in as many tasks."""
    dealt, numbers = [], []
    for n in (100_000, 200_000):
        left = spark.range(n).select(F.col("id").alias("l"), F.lit(0.25).alias("lx"), F.lit(0.75).alias("lh"))
        right = spark.range(n).select(F.col("id").alias("r"), F.lit(0.5).alias("rx"))
        ls, rs, keys, _ = listed(left, right, [Axis("lx", "lh", "rx", "rx", 1e6)])
        pl, pr, on, tasks = pieces(ls, rs, keys, None)
        dealt.append(pl.count() + pr.count())
        numbers.append(tasks)
        assert most_pairs(pl, pr, on) < 1.5 * n * n / tasks
    assert dealt[1] < 2.3 * dealt[0] and numbers[1] < 1.1 * numbers[0]


def test_pieces_of_streamed_pairs_lose_none(spark, monkeypatch):
    """Cells cut to a share of the pairs, copies and nulls included."""
    monkeypatch.setattr(gridjoin, "TASK_PAIRS", 50)
    monkeypatch.setattr(gridjoin, "STREAM_TASKS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (la, lc), (ra, rc) = boxes(300, "l", 1, True), boxes(200, "r", 2, True)
        la, ra = [*la, *la[:40], (900, None, 1.0, 0.0, 1.0)], [*ra, *ra[:40]]
        got = joins.boxes_join(spark.createDataFrame(la, lc), spark.createDataFrame(ra, rc), [("lx1", "lx2", "rx1", "rx2"), ("ly1", "ly2", "ry1", "ry2")])
        pairs = [(r.lid, r.rid) for r in got.select("lid", "rid").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(pairs) == sorted((a[0], b[0]) for a in la if a[1] is not None for b in ra if meet(a, b))


def test_boxes_long_on_one_axis_stay_small_on_the_others(spark):
    """Open in time, one unit wide in 1000 x 1000: cells hold neighbours in space only."""
    boxes_ = spark.range(20_000).select(
        F.col("id"), (F.rand(1) * 1000).alias("x"), (F.rand(2) * 1000).alias("y"), F.rand(3).alias("s"), F.lit(1e9).alias("e")
    )
    side = lambda t: boxes_.select(F.col("id").alias(t), *[c.alias(f"{t}{n}") for n, c in (("x1", F.col("x")), ("x2", F.col("x") + 1), ("y1", F.col("y")), ("y2", F.col("y") + 1), ("t1", F.col("s")), ("t2", F.col("e")))])
    axes = [Axis(f"l{c}1", f"l{c}2", f"r{c}1", f"r{c}2", 1.0) for c in "txy"]
    ls, rs, keys, _ = listed(side("l"), side("r"), axes)
    assert most_pairs(ls, rs, keys) < 1000


def test_levels_have_no_end(spark, broadcasts):
    """Extents from nothing to 2^60 and infinity; each row is listed in two cells per axis and level at most."""
    inf = float("inf")
    rows = [(0, 0.0, 0.0), (1, -1.0, 2.0**60), (2, 5.0, 5.0 + 2.0**-30), (3, -inf, inf), (4, 2.0**40, 2.0**47), (5, -(2.0**46), 2.0**46)]
    left = spark.createDataFrame(rows, "l int, l1 double, l2 double")
    right = spark.createDataFrame(rows, "r int, r1 double, r2 double")
    axes = [Axis("l1", "l2", "r1", "r2", 1.0)]
    ls, _, keys, _ = listed(left, right, axes)
    assert ls.groupBy("l", "_m0").count().agg(F.max("count")).first()[0] <= 2
    got = {(r.l, r.r) for r in box_join(left, right, axes).select("l", "r").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[2] and b[1] <= a[2]}


def test_box_join_empty_null_and_equal(spark):
    left = spark.createDataFrame([(1, 0.0, 1.0, "a"), (2, None, 1.0, "a")], "lid int, l1 double, l2 double, lk string")
    right = spark.createDataFrame([(1, 1.0, 2.0, "a"), (2, 0.5, 0.5, "b")], "rid int, r1 double, r2 double, rk string")
    axes = [Axis("l1", "l2", "r1", "r2", 1.0)]
    assert listed(left.limit(0), right, axes) is None
    assert [tuple(r) for r in box_join(left, right, axes, equal=[("lk", "rk")]).select("lid", "rid").collect()] == [(1, 1)]
    assert box_join(left, right.limit(0), axes).count() == 0


def cloud(n, seed, clustered):
    rng = np.random.default_rng(seed)
    p = rng.normal(0, 20, (n, 2)).round(2)
    if clustered:
        p[: n // 3] = p[0]  # copies
        p[n // 3 : n // 2] = p[0] + rng.normal(0, 1e-3, (n // 2 - n // 3, 2)).round(5)
    return p


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("max_dist", [None, 4.0])
def test_knn_points(spark, broadcasts, clustered, max_dist):
    q, d, k = cloud(60, 1, clustered), cloud(400, 2, clustered), 5
    qd = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "q long, x double, y double")
    dd = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(d)], "d long, u double, v double")
    got = {}
    for r in knn_points(qd, dd, "q", ["x", "y"], "d", ["u", "v"], k, max_dist).collect():
        got.setdefault(r.q, []).append((r["rank"], r.nid, r.d2))
    for i, p in enumerate(q):
        d2 = ((p - d) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(d)), d2)) if max_dist is None or d2[j] < max_dist**2][:k]
        mine = sorted(got.get(i, []))
        assert np.allclose([m[2] for m in mine], d2[order])
        assert [m[1] for m in mine] == order


def test_far_queries_do_not_meet_a_whole_cluster(spark):
    """A dense cluster, a few points elsewhere and queries far off: each looks at few points."""
    rng = np.random.default_rng(8)
    d = np.concatenate([rng.uniform(0, 1, (60_000, 2)), rng.uniform(-5000, 5000, (40, 2))])
    q = np.concatenate([rng.uniform(0, 1, (30, 2)), rng.uniform(-4000, 4000, (30, 2))])
    qd = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "_qid long, _q0 double, _q1 double")
    dd = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(d)], "_nid long, _d0 double, _d1 double")
    k = 60  # more than there are points outside the cluster
    low, span = float(min(q.min(), d.min())), float(max(q.max(), d.max()) - min(q.min(), d.min()))
    pyramid = knn._Pyramid.over(dd, ["_d0", "_d1"], [low, low], span, len(d), k)
    look = knn._first_look(qd, dd, pyramid, k, None)
    met = knn._in_ball(look, dd, ["_q0", "_q1"], ["_d0", "_d1"]).groupBy("_qid").count().toPandas()
    assert len(met) == 60 and met["count"].max() < 10_000
    got = {}
    for r in knn_points(qd, dd, "_qid", ["_q0", "_q1"], "_nid", ["_d0", "_d1"], k).collect():
        got.setdefault(r._qid, []).append(r.nid)
    for i, p in enumerate(q):
        d2 = ((p - d) ** 2).sum(1)
        assert sorted(got[i]) == sorted(np.argsort(d2, kind="stable")[:k].tolist())


@pytest.mark.parametrize("one_level", [256, 2])
@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_knn_vectors_blocks_and_pivots(spark, metric, one_level, monkeypatch):
    """One and two levels of pivots, and copies that fall into one leaf."""
    monkeypatch.setattr(knn, "ONE_LEVEL", one_level)
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.normal(c, 0.3, (60, 8)) for c in (-2, 0, 3)])
    base[100:140] = base[100]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    d = spark.createDataFrame(rows, "did long, dvec array<double>")
    q = spark.createDataFrame(rows[::4], "qid long, qvec array<double>")
    out = knn_vectors(q, d, 4, metric=metric, block_rows=16).collect()
    for i in range(0, len(base), 4):
        val = ((base - base[i]) ** 2).sum(axis=1) if metric == "l2" else -(base @ base[i])
        want = np.lexsort((np.arange(len(base)), val))[:4]
        assert [r.nid for r in sorted(out, key=lambda r: r["rank"]) if r.qid == i] == want.tolist()


def test_knn_vectors_errors_eps_and_counts(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (80, 4))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "did long, dvec array<double>")
    q = d.toDF("qid", "qvec")
    with pytest.raises(ValueError):
        knn_vectors(q, d, 81)
    got = knn_vectors(q, d, 2, max_value=1.0, count_in_range=True, exclude_same_id=True, block_rows=16)
    d2 = ((base[:, None] - base[None]) ** 2).sum(axis=2)
    want = {i: int((d2[i] <= 1.0).sum()) - 1 for i in range(80)}
    assert {r.qid: r.n_in_range for r in got.collect()} == {i: n for i, n in want.items() if n}
    with pytest.raises(ValueError):
        knn_vectors(q, d, 2, metric="dot", eps=0.5)
    near = knn_vectors(q, d, 3, eps=0.5, block_rows=16, exclude_same_id=True).collect()
    np.fill_diagonal(d2, np.inf)
    for r in near:
        assert r.value**0.5 <= 1.5 * np.sort(d2[r.qid])[r["rank"] - 1] ** 0.5 + 1e-9


@pytest.mark.parametrize("anti", [False, True])
def test_overlap_filter_strict_and_hot(spark, anti):
    rng = random.Random(5)
    a = [(i, rng.choice([0.0, 3.0, 9.0, 20.0]), rng.uniform(0, 20), float(1 + i % 4)) for i in range(80)]
    b = [(i, 0.0 if i % 3 == 0 else rng.uniform(0, 20), rng.uniform(0, 20), float(1 + i % 3)) for i in range(40)]
    b.append((99, 3.0 + a[1][3], a[1][2], 0.5))  # touching only: strict
    left = spark.createDataFrame(a, "id int, x double, y double, r double")
    right = spark.createDataFrame(b, "pid int, px double, py double, pr double")
    got = {r.id for r in joins.overlap_filter(left, right, ("x", "y", "r"), ("px", "py", "pr"), anti).collect()}
    hit = {p[0] for p in a if any(((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 < max(p[3], q[3]) for q in b)}
    assert got == ({p[0] for p in a} - hit if anti else hit)


def test_interval_join_half_open_and_open_end(spark):
    left = spark.createDataFrame([(1, 0, 10), (2, 10, 20), (3, 50, None)], "l int, ls long, le long")
    right = spark.createDataFrame([(1, 10, 12), (2, 5, 10), (3, 0, None), (4, 60, 61)], "r int, rs long, re long")
    got = {(r.l, r.r) for r in temporal.interval_join(left, right, ("ls", "le", "rs", "re")).select("l", "r").collect()}
    assert got == {(1, 2), (1, 3), (2, 1), (2, 3), (3, 3), (3, 4)}


def test_version_history_hot_key_and_deletes(spark):
    rows = [(i, 1 if i % 3 else i, i * 10, "delete" if i % 7 == 0 else "insert") for i in range(1, 300)]
    log = spark.createDataFrame(rows, "seq long, id long, t long, op string")
    got = {(r.seq, r.id, r.valid_from, r.valid_to) for r in temporal.version_history(log, "id", "t", "seq", F.col("op") == "delete").collect()}
    want, last = set(), {}
    for seq, i, t, op in rows:
        if i in last:
            s, f = last.pop(i)
            want.add((s, i, f, t))
        if op == "insert":
            last[i] = (seq, t)
    want |= {(s, i, f, None) for i, (s, f) in last.items()}
    assert got == want


def test_moving_points_against_steps(spark, broadcasts):
    rng = random.Random(6)
    pts = [(i, rng.uniform(-30, 30), rng.choice([0.0, 1.5, -2.0, 0.1]), rng.uniform(-30, 30), rng.choice([0.0, 1.0, -3.0]), rng.uniform(0, 5)) for i in range(60)]
    rects = [(j, x := rng.uniform(-30, 20), x + 8, y := rng.uniform(-30, 20), y + 6, 0.0, rng.choice([5.0, 20.0])) for j in range(15)]
    p = spark.createDataFrame(pts, "id int, ax double, vx double, ay double, vy double, t_ref double")
    r = spark.createDataFrame(rects, "rid int, xl double, xh double, yl double, yh double, t1 double, t2 double")
    out = temporal.moving_range_join(p, r, [("ax", "vx"), ("ay", "vy")], "t_ref", [("xl", "xh"), ("yl", "yh")], ("t1", "t2"))
    got = [(x.id, x.rid) for x in out.select("id", "rid").collect()]
    assert len(got) == len(set(got))
    clip = p.crossJoin(r).where(
        temporal.crosses_during([(F.col("ax"), F.col("vx")), (F.col("ay"), F.col("vy"))], F.col("t_ref"), [F.col("xl"), F.col("yl")], [F.col("xh"), F.col("yh")], F.col("t1"), F.col("t2"))
    )
    assert set(got) == {(x.id, x.rid) for x in clip.select("id", "rid").collect()}
    for i, ax, vx, ay, vy, t0 in pts:
        for j, xl, xh, yl, yh, t1, t2 in rects:
            steps = [t1 + (t2 - t1) * s / 400 for s in range(401)]
            if any(xl <= ax + vx * (t - t0) <= xh and yl <= ay + vy * (t - t0) <= yh for t in steps):
                assert (i, j) in got


def test_neighbour_predicate_and_own_distance(spark):
    rng = np.random.default_rng(9)
    q, d = rng.uniform(0, 10, (20, 2)), rng.uniform(0, 10, (150, 2))
    d[:50] = d[0]
    qd = spark.createDataFrame([(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(q)], "q long, x double, y double, qk int")
    dd = spark.createDataFrame([(i, float(a), float(b), i % 3) for i, (a, b) in enumerate(d)], "d long, u double, v double, dk int")
    out = knn_points(qd, dd, "q", ["x", "y"], "d", ["u", "v"], 3, accept=F.col("qk") != F.col("dk"), carry=(["qk"], ["dk"]))
    got = {}
    for r in out.collect():
        got.setdefault(r.q, {})[r["rank"]] = r.nid
    for i, p in enumerate(q):
        d2 = ((p - d) ** 2).sum(axis=1)
        want = [j for j in np.lexsort((np.arange(150), d2)) if j % 3 != i % 3][:3]
        assert [got[i][n] for n in (1, 2, 3)] == want
    from geoloom.operators.knn import nearest_boxes

    b = spark.createDataFrame([(1, 0.0, 1.0), (2, 5.0, 6.0), (3, 9.0, 9.5), (4, -3.0, -2.0)], "id int, lo double, hi double")
    near = nearest_boxes(b, ["lo"], ["hi"], [3.0], 1)
    assert {r.id for r in near.collect()} == {1, 2}
    far = nearest_boxes(b, ["lo"], ["hi"], [3.0], 1, distance=-F.col("hi"))
    assert [r.id for r in far.collect()] == [3]


def test_patch_groups_count_copies(spark):
    from geoloom.operators.patches import drop_small_patch_groups

    rows = [(i, 0.0, 0.0, 0.0) for i in range(6)] + [(10, 50.0, 0.0, 0.0), (11, 50.5, 0.0, 0.0), (12, 90.0, 0.0, 0.0)]
    p = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], "id long, x double, y double, z double, nx double, ny double, nz double, scale double")
    got = {r.id for r in drop_small_patch_groups(p, "id", 1.0, 0.3, 1.0, 2).collect()}
    assert got == {0, 1, 2, 3, 4, 5, 10, 11}


def test_knn_vectors_visited_limit(spark):
    """A limit on compared rows: always k rows, never better than exact, exact with a large limit."""
    rng = np.random.default_rng(6)
    base = rng.normal(0, 1, (400, 6))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "did long, dvec array<double>")
    q = d.toDF("qid", "qvec").where("qid % 10 = 0")
    d2 = ((base[::10, None] - base[None]) ** 2).sum(axis=2)
    want = np.sort(d2, axis=1)[:, 1:4]
    for limit, exact in ((64, False), (10_000, True)):
        rows = knn_vectors(q, d, 3, exclude_same_id=True, max_visited=limit, block_rows=16).collect()
        got = np.array([r.value for r in sorted(rows, key=lambda r: (r.qid, r["rank"]))]).reshape(-1, 3)
        assert (got >= want - 1e-9).all()
        assert np.allclose(got, want) == exact


def test_knn_vectors_write_no_list_of_queries_and_leaves(spark, monkeypatch):
    """Where pivots tell little apart a query sees nearly all leaves; what is written stays at a row per query or vector."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (300, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "did long, dvec array<double>")
    written = []

    def spy(df):
        out = checkpoint(df)
        written.append(out.count())
        return out

    checkpoint = knn.checkpoint
    monkeypatch.setattr(knn, "checkpoint", spy)
    rows = knn_vectors(d.toDF("qid", "qvec"), d, 3, exclude_same_id=True, block_rows=16).collect()
    d2 = ((base[:, None] - base[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    assert {(r.qid, r.nid) for r in rows} == {(i, int(j)) for i in range(300) for j in np.argsort(d2[i], kind="stable")[:3]}
    assert max(written) <= 300


@pytest.mark.parametrize("crowd", [False, True])
def test_guided_matches_write_no_list_of_pairs(spark, monkeypatch, crowd):
    """Against all pairs, null and equal ids of competitors included; of a crowd only the two best per row are written."""
    rng = np.random.default_rng(9)
    n, eye, epipolar, written = 60, [1, 0, 0, 0, 1, 0, 0, 0, 1], [0, -1, -1, 1, 0, 4, 1, -4, 0], []

    def spy(df):
        out = checkpoint(df)
        written.append(out.count())
        return out

    checkpoint = matching.checkpoint
    monkeypatch.setattr(matching, "checkpoint", spy)
    monkeypatch.setattr(matching, "PAIRS", 400)
    sides = []
    for tag in "ab":
        vec = rng.integers(0, 300, (n, 4))
        at = np.full((n, 2), 3.0) if crowd else rng.integers(0, 40, (n, 2)).astype(float)
        ids = [None if i == 5 else 7 if i == 8 else i for i in range(n)]
        rows = [(i, v.tolist(), *p.tolist()) for i, v, p in zip(ids, vec, at)]
        sides.append((ids, vec, at, spark.createDataFrame(rows, f"{tag}_id long, {tag}_vec array<int>, {tag}x double, {tag}y double")))
    (ai, av, ap, a), (bi, bv, bp, b) = sides
    got = {(r.a_id, r.b_id) for r in matching.guided_matches(a, b, 4, eye, epipolar, 12.0, 9.0, 2.0, 0.999).collect()}
    f = np.array(epipolar, dtype=float).reshape(3, 3)
    lines = np.column_stack([ap, np.ones(n)]) @ f.T
    gate = ((ap[:, None] - bp[None]) ** 2).sum(2) <= 144
    gate &= np.abs(lines @ np.column_stack([bp, np.ones(n)]).T) / np.hypot(lines[:, 0], lines[:, 1])[:, None] <= 9.0
    dot = av @ bv.T

    def choices(me, other, dots, may):
        out = set()
        for i in set(me) - {None}:
            own = [(-dots[x, y], -1 if other[y] is None else other[y]) for x in range(n) if me[x] == i for y in range(n) if may[x, y]]
            angle = [float(np.arccos(min(-d / 512**2, 1.0))) for d, _ in sorted(own)[:2]] + [1e30]
            if own and angle[0] < 2.0 and angle[0] < angle[1] * 0.999:
                out.add((i, sorted(own)[0][1]))
        return out

    want = choices(ai, bi, dot, gate) & {(y, x) for x, y in choices(bi, ai, dot.T, gate.T)}
    assert got == {p for p in want if -1 not in p} and got
    assert max(written) <= 4 * 2 * n * (-(-n // 20))


def test_equal_patches_meet_as_one_row(spark):
    """Copies, ids that repeat, and patches without a normal; pairs by brute force, rows of the search by the distinct patches."""
    from geoloom.operators import patches as P

    rows = [(i, float(i % 3), 0.0, 0.0, 0.0, 0.0, 1.0, 0.5) for i in range(120)] + [(5, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5), (500, 0.0, 0.0, 0.0, None, 0.0, 1.0, 0.5), (None, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, nx double, ny double, nz double, scale double")
    got = sorted(map(tuple, P.patch_neighbours(df, "id", 1.1, 0.33, 1.2).collect()))
    flat = [(r[0], r[1]) for r in rows if r[0] is not None and r[4] is not None]
    assert got == sorted((a, b) for a, x in flat for b, y in flat if a < b and abs(x - y) <= 1.2)
    blocks = P._blocks(df, "id").collect()
    assert sum(len(r["ids"]) for r in blocks) == 121 and len(blocks) <= 6


def test_points_are_sought_in_touched_cells_only(spark):
    """A box one cell wide meets points in at most two cells an axis, also where points are many."""
    from geoloom.operators.gridjoin import Axis, listed

    points = spark.range(400).selectExpr("id", "id % 20 + 0.5 as x", "id div 20 + 0.5 as y")
    boxes = spark.range(10).selectExpr("id as b", "2.0 * id as x1", "2.0 * id + 2 as x2", "3.0 as y1", "5.0 as y2")
    left, right, *_ = listed(points, boxes, [Axis("x", "x", "x1", "x2", 2.0), Axis("y", "y", "y1", "y2", 2.0)])
    assert left.count() <= 400 and right.count() <= 40


def test_nearest_cameras_equal_a_ranking_of_all(spark):
    """Copies, ties, vertices with few cameras and repeated ids; far fewer pairs than the windows hold."""
    rng = random.Random(9)
    verts = [(i % 40, rng.randrange(40), float(rng.randrange(40))) for i in range(60)] + [(99, 500, 500.0)]
    cams = [(i // 2, rng.randrange(30), float(rng.randrange(30))) for i in range(300)] + [(900 + i, 3, 3.0) for i in range(50)] + [(990, 505, 505.0)]
    v = spark.createDataFrame(verts, "vid long, x long, y double")
    c = spark.createDataFrame([(*r, r[1] - 12.0, r[1] + 12.0, r[2] - 12.0, r[2] + 12.0) for r in cams], "cam long, cx long, cy double, lx double, hx double, ly double, hy double")
    see = lambda **more: cameras.cameras_of_vertices(v, ["x", "y"], c, [("lx", "hx"), ("ly", "hy")], [24.0, 24.0], **more).select("vid", "cam", F.expr("(x - cx) * (x - cx) + (y - cy) * (y - cy)").alias("d"))
    near = see(nearest=(4, "cam", ["cx", "cy"])).cache()
    first = lambda df: sorted(tuple(r) for r in cameras.best_per_key(df, "vid", ["d", "cam"], 4).collect())
    assert first(near) == first(see())
    assert near.count() < see().count() / 4


def test_moving_points_are_dealt_by_stages(spark, monkeypatch):
    """Points that cross hundreds of rectangle widths: what is shuffled follows stages, and pairs equal those of all pairs."""
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.uniform(0, 1000, 2)), int(rng.integers(-3, 4)), int(rng.integers(-3, 4)), float(rng.uniform(0, 400))) for i in range(300)]
    rects = [(i, float(x), float(x) + 1 + (i % 50 == 0) * 300, float(y), float(y) + 1 + i % 3, float(t), float(t) + 40 + i % 7) for i, (x, y, t) in enumerate(rng.uniform(0, 1000, (400, 3)))]
    rects += [(400, None, 5.0, 1.0, 2.0, 0.0, 9.0), (401, 0.0, 1000.0, 0.0, 1000.0, 0.0, 1000.0)]
    p = spark.createDataFrame(rows, "pid long, ax double, ay double, vx int, vy int, t_ref double")
    r = spark.createDataFrame(rects, "rid long, xl double, xh double, yl double, yh double, t1 double, t2 double")
    dealt, keep = [], temporal.pieces
    monkeypatch.setattr(temporal, "pieces", lambda ls, *a: dealt.append(ls.count()) or keep(ls, *a))
    join = lambda: temporal.moving_range_join(p, r, [("ax", "vx"), ("ay", "vy")], "t_ref", [("xl", "xh"), ("yl", "yh")], ("t1", "t2"))
    got = sorted((x.pid, x.rid) for x in join().collect())
    crosses = temporal.crosses_during([(F.col("ax"), F.col("vx")), (F.col("ay"), F.col("vy"))], F.col("t_ref"), [F.col("xl"), F.col("yl")], [F.col("xh"), F.col("yh")], F.col("t1"), F.col("t2"))
    assert got == sorted((x.pid, x.rid) for x in p.crossJoin(r).where(crosses).collect()) and len(got) > 300
    slices = p.agg(F.sum(F.lit(1000) * F.greatest(F.abs("vx"), F.abs("vy")))).first()[0]
    assert dealt[0] < slices / 4
    monkeypatch.setattr(temporal, "STAGES", 3)
    monkeypatch.setattr(temporal, "RECTS", 5)
    monkeypatch.setattr(temporal, "TOLD", 7)
    assert sorted((x.pid, x.rid) for x in join().collect()) == got
