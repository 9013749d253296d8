"""Spatial and temporal joins on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import cameras, joins, patches, temporal
from geoloom.operators.filters import window_filter
from geoloom.operators.gridjoin import Axis, box_join
from geoloom.operators.knn import nearest_boxes, nearest_boxes_join
from geoloom.operators.voxel import assign_subvolumes, subvolume_size
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table

# 3-D boxes of parts (meshes) and suppliers (tiles)
BOX3 = (
    "WITH pb AS (SELECT p_partkey, CAST(p_partkey % 50 AS DOUBLE) AS ax, CAST(p_size AS DOUBLE) AS ay, "
    "p_retailprice / 100 AS az, 1.0 + p_partkey % 3 AS aw FROM part), "
    "sb AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS bx, CAST(s_nationkey AS DOUBLE) AS by_, "
    "s_acctbal / 100 AS bz, 4.0 + s_suppkey % 5 AS bw FROM supplier) "
)


def part_boxes(spark, sf):
    k = F.col("p_partkey")
    w = F.lit(1.0) + k % 3
    x, y, z = (k % 50).cast("double"), F.col("p_size").cast("double"), F.col("p_retailprice") / 100
    cols = [c for n, v in (("x", x), ("y", y), ("z", z)) for c in (v.alias(f"pl{n}"), (v + w).alias(f"ph{n}"))]
    return table(spark, sf, "part").select("p_partkey", *cols)


def supplier_boxes(spark, sf, grow: float = 0.0):
    k = F.col("s_suppkey")
    w = F.lit(4.0) + k % 5
    x, y, z = (k % 50).cast("double"), F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 100
    cols = [
        c
        for n, v in (("x", x), ("y", y), ("z", z))
        for c in ((v - grow).alias(f"sl{n}"), (v + w + grow).alias(f"sh{n}"))
    ]
    return table(spark, sf, "supplier").select("s_suppkey", *cols)


@query(
    "box_box_join",
    BOX3 + "SELECT s_suppkey, p_partkey FROM pb JOIN sb ON ax <= bx + bw AND bx <= ax + aw "
    "AND ay <= by_ + bw AND by_ <= ay + aw AND az <= bz + bw AND bz <= az + aw",
)
def box_box_join(spark, sf):
    bounds = [(f"pl{c}", f"ph{c}", f"sl{c}", f"sh{c}") for c in "xyz"]
    return joins.boxes_join(part_boxes(spark, sf), supplier_boxes(spark, sf), bounds).select("s_suppkey", "p_partkey")


@query(
    "box_self_join",
    with_sql("boxes") + ", q AS (SELECT * FROM boxes WHERE x1 <= 20 AND x2 >= 10 AND y1 <= 40000 AND y2 >= 20000) "
    "SELECT a.l_orderkey AS a_order, a.l_partkey AS a_part, a.l_linenumber AS a_line, "
    "b.l_orderkey AS b_order, b.l_partkey AS b_part, b.l_linenumber AS b_line FROM q a JOIN q b "
    "ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 "
    "AND (a.l_orderkey, a.l_partkey, a.l_linenumber) <> (b.l_orderkey, b.l_partkey, b.l_linenumber)",
)
def box_self_join(spark, sf):
    names = {"l_orderkey": "order", "l_partkey": "part", "l_linenumber": "line", "x1": "x1", "y1": "y1", "x2": "x2", "y2": "y2"}
    hit = window_filter(B.boxes(spark, sf), ["x1", "y1"], ["x2", "y2"], [(10, 20), (20000, 40000)])
    a, b = (hit.select(*[F.col(c).alias(f"{t}_{n}") for c, n in names.items()]) for t in "ab")
    other = ~(
        (F.col("a_order") == F.col("b_order")) & (F.col("a_part") == F.col("b_part")) & (F.col("a_line") == F.col("b_line"))
    )
    pairs = joins.boxes_join(a, b, [("a_x1", "a_x2", "b_x1", "b_x2"), ("a_y1", "a_y2", "b_y1", "b_y2")], other)
    return pairs.select("a_order", "a_part", "a_line", "b_order", "b_part", "b_line")


# the global box is cut into sub-volumes of 8 units; parts list with a border of 1.25 units
@query(
    "subvolume_assign",
    BOX3 + ", e AS (SELECT MIN(ax) - 1.25 AS gx, MIN(ay) - 1.25 AS gy, MIN(az) - 1.25 AS gz, MAX(ax + aw) + 1.25 AS hx, "
    "MAX(ay + aw) + 1.25 AS hy, MAX(az + aw) + 1.25 AS hz FROM pb), "
    "v AS (SELECT i, j, k, gx + 8 * i AS vx, gy + 8 * j AS vy, gz + 8 * k AS vz FROM e, "
    "range(0, 400) a(i), range(0, 400) b(j), range(0, 400) c(k) WHERE i < ceil((hx - gx) / 8) AND j < ceil((hy - gy) / 8) AND k < ceil((hz - gz) / 8)) "
    "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, p_partkey FROM v JOIN pb "
    "ON ax <= vx + 8 + 1.25 AND vx - 1.25 <= ax + aw AND ay <= vy + 8 + 1.25 AND vy - 1.25 <= ay + aw "
    "AND az <= vz + 8 + 1.25 AND vz - 1.25 <= az + aw",
)
def subvolume_assign(spark, sf):
    """Cubes of at most 600,000 voxels of 0.125, border included: 64 voxels and 10 on each side."""
    size, border = subvolume_size(0.125, 600_000)
    return assign_subvolumes(part_boxes(spark, sf), ["plx", "ply", "plz"], ["phx", "phy", "phz"], size, border).select(
        "i", "j", "k", "p_partkey"
    )


NEAR = with_sql("cust", "supp")


@query(
    "overlap_fraction",
    NEAR + ", n AS (SELECT c_custkey FROM cust WHERE EXISTS (SELECT 1 FROM supp "
    "WHERE sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) < 4)) "
    "SELECT (SELECT COUNT(*) FROM n) AS matched, (SELECT COUNT(*) FROM cust) AS total, "
    "round((SELECT COUNT(*) FROM n) * 1.0 / (SELECT COUNT(*) FROM cust), 6) AS fraction",
)
def overlap_fraction(spark, sf):
    near = joins.nearest_within(B.customers(spark, sf), B.suppliers(spark, sf), "c_custkey", ["cx", "cy"], "s_suppkey", ["sx", "sy"], 4.0)
    out = near.agg(F.count("nid").alias("matched"), F.count("*").alias("total"))
    return out.withColumn("fraction", rnd(F.col("matched") / F.col("total")))


ORIGIN = ("origin_latitude", "origin_longitude")


def _about_one_origin(spark, sf):
    return [df.withColumns({ORIGIN[0]: F.lit(-31.8125), ORIGIN[1]: F.lit(115.5)}) for df in (B.customers(spark, sf), B.suppliers(spark, sf))]


OVER = "sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) < greatest(cr, sr)"


@query(
    "overlap_semi_join",
    NEAR + f"SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS new_id FROM cust WHERE EXISTS (SELECT 1 FROM supp WHERE {OVER})",
)
def overlap_semi_join(spark, sf):
    return joins.overlap_renumbered(
        *_about_one_origin(spark, sf), ("cx", "cy", "cr"), ("sx", "sy", "sr"), ["c_custkey"], origin=ORIGIN
    ).select("c_custkey", "new_id")


@query("overlap_anti_join", NEAR + f"SELECT c_custkey FROM cust WHERE NOT EXISTS (SELECT 1 FROM supp WHERE {OVER})")
def overlap_anti_join(spark, sf):
    return joins.overlap_filter(
        *_about_one_origin(spark, sf), ("cx", "cy", "cr"), ("sx", "sy", "sr"), anti=True, origin=ORIGIN
    ).select("c_custkey")


@query(
    "knn_query",
    with_sql("boxes") + ", d AS (SELECT *, pow(greatest(x1 - 25, 25 - x2, 0), 2) + pow(greatest(y1 - 50000, 50000 - y2, 0), 2) AS d2 FROM boxes) "
    "SELECT l_orderkey, l_linenumber, x1, y1, round(d2, 6) + 0.0 AS d2 FROM (SELECT *, RANK() OVER (ORDER BY d2) AS rk FROM d) WHERE rk <= 10",
)
def knn_query(spark, sf):
    near = nearest_boxes(B.boxes(spark, sf), ["x1", "y1"], ["x2", "y2"], [25.0, 50000.0], 10)
    return near.select("l_orderkey", "l_linenumber", "x1", "y1", rnd("d2").alias("d2"))


@query(
    "knn_boxes_join",
    BOX3 + ", q AS (SELECT c_custkey, c_custkey % 47 + 0.5 AS qx, CAST(c_nationkey * 2 AS DOUBLE) AS qy, c_acctbal / 100 AS qz FROM customer WHERE c_custkey % 100 = 0), "
    "d AS (SELECT c_custkey, p_partkey, pow(greatest(ax - qx, qx - (ax + aw), 0), 2) + pow(greatest(ay - qy, qy - (ay + aw), 0), 2) "
    "+ pow(greatest(az - qz, qz - (az + aw), 0), 2) AS d2 FROM q, pb) "
    "SELECT c_custkey, p_partkey, round(d2, 6) + 0.0 AS d2, rank FROM (SELECT *, RANK() OVER (PARTITION BY c_custkey ORDER BY d2) AS rank FROM d) WHERE rank <= 3",
)
def knn_boxes_join(spark, sf):
    """The three nearest part boxes, with ties, of every customer whose id is divisible by 100."""
    c = F.col("c_custkey")
    q = table(spark, sf, "customer").where(c % 100 == 0).select(
        c, (c % 47 + 0.5).alias("qx"), (F.col("c_nationkey") * 2).cast("double").alias("qy"), (F.col("c_acctbal") / 100).alias("qz")
    )
    near = nearest_boxes_join(q, part_boxes(spark, sf), "c_custkey", ["qx", "qy", "qz"], "p_partkey", ["plx", "ply", "plz"], ["phx", "phy", "phz"], 3)
    return near.select("c_custkey", "p_partkey", rnd("d2").alias("d2"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "radius_join",
    NEAR + "SELECT c_custkey, s_suppkey, round(sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)), 6) + 0.0 AS dist "
    "FROM cust JOIN supp ON (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy) <= 25",
)
def radius_join(spark, sf):
    pairs = joins.radius_join(B.customers(spark, sf), B.suppliers(spark, sf), ["cx", "cy"], ["sx", "sy"], 5.0)
    return pairs.select("c_custkey", "s_suppkey", rnd("dist").alias("dist"))


@query(
    "nearest_within",
    NEAR + ", d AS (SELECT c_custkey, s_suppkey, (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy) AS d2 FROM cust JOIN supp "
    "ON (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy) < 36), "
    "m AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS rn FROM d) WHERE rn = 1) "
    "SELECT c.c_custkey, m.s_suppkey AS nid, round(sqrt(d2), 6) AS dist FROM cust c LEFT JOIN m ON c.c_custkey = m.c_custkey",
)
def nearest_within(spark, sf):
    out = joins.nearest_within(B.customers(spark, sf), B.suppliers(spark, sf), "c_custkey", ["cx", "cy"], "s_suppkey", ["sx", "sy"], 6.0)
    return out.select("c_custkey", "nid", rnd("dist").alias("dist"))


RAYS = [
    {"id": 0, "origin": (0.0, 0.0, 0.0), "dir": (0.6, 0.8, 0.0)},
    {"id": 1, "origin": (50.0, 1.0, 5.0), "dir": (0.0, 1.0, 0.0)},
    {"id": 2, "origin": (25.0, 50.0, 0.0), "dir": (0.0, 0.6, 0.8)},
    {"id": 3, "origin": (500.0, 500.0, 500.0), "dir": (1.0, 0.0, 0.0)},
]


def _ray_sql(r) -> str:
    (ox, oy, oz), (dx, dy, dz) = r["origin"], r["dir"]
    t = f"((x - {ox}) * {dx} + (y - {oy}) * {dy} + (z - {oz}) * {dz})"
    d2 = f"(pow(x - {ox} - {t} * {dx}, 2) + pow(y - {oy} - {t} * {dy}, 2) + pow(z - {oz} - {t} * {dz}, 2))"
    near = f"(SELECT l_orderkey, l_linenumber, l_partkey, {d2} AS d2 FROM pts WHERE {d2} < 900 ORDER BY d2, l_orderkey, l_linenumber, l_partkey LIMIT 1)"
    return f"SELECT {r['id']} AS ray_id, l_orderkey, l_linenumber, l_partkey, round(sqrt(d2), 5) AS dist FROM (SELECT 1) LEFT JOIN {near} ON TRUE"


@query("nearest_to_ray", with_sql("pts") + " UNION ALL ".join(_ray_sql(r) for r in RAYS))
def nearest_to_ray(spark, sf):
    pts = B.points(spark, sf).withColumn("pid", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    near = joins.nearest_to_rays(pts, "xyz", "pid", RAYS, 30.0)
    return near.select("ray_id", "point_id.l_orderkey", "point_id.l_linenumber", "point_id.l_partkey", rnd("dist", 5).alias("dist"))


@query(
    "version_history",
    with_sql("ev", "vers") + "SELECT event_id, user_id, valid_from, valid_to, value FROM vers",
)
def version_history(spark, sf):
    return _versions(spark, sf).select("event_id", "user_id", "valid_from", "valid_to", "value")


def _versions(spark, sf):
    return temporal.version_history(B.events(spark, sf), "user_id", "t", "event_id", F.col("event_type") == "error")


T0 = 1704067200000000
DAY = 86400000000


@query(
    "snapshot_as_of",
    with_sql("ev", "vers") + "SELECT event_id, user_id, value FROM vers "
    f"WHERE valid_from < {T0 + 11 * DAY} AND (valid_to IS NULL OR valid_to > {T0 + 10 * DAY})",
)
def snapshot_as_of(spark, sf):
    alive = temporal.alive_between(_versions(spark, sf), F.lit(T0 + 10 * DAY), F.lit(T0 + 11 * DAY))
    return alive.select("event_id", "user_id", "value")


# versions as boxes value x [event_id % 101, + 6] against purchase queries of two hours
@query(
    "temporal_overlap_join",
    with_sql("ev", "vers") + ", q AS (SELECT event_id AS q_id, t AS q_from, t + 7200000000 AS q_to, value - 10 AS qx1, value + 10 AS qx2, "
    "CAST(event_id % 101 AS DOUBLE) AS qy1, CAST(event_id % 101 + 10 AS DOUBLE) AS qy2 FROM ev WHERE event_type = 'purchase') "
    "SELECT q_id, event_id FROM q JOIN vers ON value <= qx2 AND qx1 <= value + 5 AND event_id % 101 <= qy2 AND qy1 <= event_id % 101 + 6 "
    "AND (valid_to IS NULL OR valid_to > q_from) AND valid_from < q_to",
)
def temporal_overlap_join(spark, sf):
    e = F.col("event_id")
    v = _versions(spark, sf).select(
        "event_id",
        "valid_from",
        "valid_to",
        F.col("value").alias("vx1"),
        (F.col("value") + 5).alias("vx2"),
        (e % 101).cast("double").alias("vy1"),
        (e % 101 + 6).cast("double").alias("vy2"),
    )
    q = (
        B.events(spark, sf)
        .where("event_type = 'purchase'")
        .select(
            e.alias("q_id"),
            F.col("t").alias("q_from"),
            (F.col("t") + 7200000000).alias("q_to"),
            (F.col("value") - 10).alias("qx1"),
            (F.col("value") + 10).alias("qx2"),
            (e % 101).cast("double").alias("qy1"),
            (e % 101 + 10).cast("double").alias("qy2"),
        )
    )
    out = temporal.interval_join(
        q, v, ("q_from", "q_to", "valid_from", "valid_to"), [("qx1", "qx2", "vx1", "vx2"), ("qy1", "qy2", "vy1", "vy2")]
    )
    return out.select("q_id", "event_id")


# rectangles from suppliers; the SQL twin intersects the time spans inside each slab
SPANS = (
    ", rect AS (SELECT s_suppkey, s_acctbal / 20 AS xl, s_acctbal / 20 + 15 AS xh, CAST(s_suppkey % 90 AS DOUBLE) AS yl, "
    "CAST(s_suppkey % 90 + 12 AS DOUBLE) AS yh, 0.0 AS t1, 60.0 + s_suppkey % 7 * 20 AS t2 FROM supplier), "
    "m AS (SELECT event_id, value AS ax, (user_id % 7) - 3 AS vx, event_id % 101 AS ay, (event_id % 5) - 2 AS vy, CAST(event_id % 60 AS DOUBLE) AS t_ref FROM ev) "
)


@query(
    "moving_range_join",
    with_sql("ev") + SPANS + "SELECT s_suppkey, event_id FROM m JOIN rect ON "
    "(vx <> 0 OR ax BETWEEN xl AND xh) AND (vy <> 0 OR ay BETWEEN yl AND yh) AND "
    "greatest(t1, CASE WHEN vx = 0 THEN t1 ELSE t_ref + least((xl - ax) / vx, (xh - ax) / vx) END, "
    "CASE WHEN vy = 0 THEN t1 ELSE t_ref + least((yl - ay) / vy, (yh - ay) / vy) END) <= "
    "least(t2, CASE WHEN vx = 0 THEN t2 ELSE t_ref + greatest((xl - ax) / vx, (xh - ax) / vx) END, "
    "CASE WHEN vy = 0 THEN t2 ELSE t_ref + greatest((yl - ay) / vy, (yh - ay) / vy) END)",
)
def moving_range_join(spark, sf):
    m = B.moving(spark, sf).withColumn("t_ref", (F.col("event_id") % 60).cast("double"))
    k = F.col("s_suppkey")
    rect = table(spark, sf, "supplier").select(
        "s_suppkey",
        (F.col("s_acctbal") / 20).alias("xl"),
        (F.col("s_acctbal") / 20 + 15).alias("xh"),
        (k % 90).cast("double").alias("yl"),
        (k % 90 + 12).cast("double").alias("yh"),
        F.lit(0.0).alias("t1"),
        (F.lit(60.0) + k % 7 * 20).alias("t2"),
    )
    out = temporal.moving_range_join(m, rect, [("ax", "vx"), ("ay", "vy")], "t_ref", [("xl", "xh"), ("yl", "yh")], ("t1", "t2"))
    return out.select("s_suppkey", "event_id")


def _while(tests: list[tuple[str, str]], t1: int, t2: int) -> tuple[str, str, str]:
    """SQL for the time in which all c + v t <= 0 hold: from, to, and whether they can."""
    start = ", ".join(f"CASE WHEN {v} < 0 THEN -({c}) / ({v}) ELSE {t1} END" for c, v in tests)
    end = ", ".join(f"CASE WHEN {v} > 0 THEN -({c}) / ({v}) ELSE {t2} END" for c, v in tests)
    return f"greatest({t1}, {start})", f"least({t2}, {end})", " AND ".join(f"({v} <> 0 OR {c} <= 0)" for c, v in tests)


_LOW, _HIGH = ("ax", "vx"), ("(ax + 8)", "(vx + dv)")
_PV = "(event_id % 4)"  # speed of a point that is at 120 at time 0
_MEET = _while([("(ax - 150)", "vx"), ("(100 - (ax + 8))", "(0 - (vx + dv))")], 0, 60)
_HOLD = _while([("(ax - 120)", f"(vx - {_PV})"), ("(120 - (ax + 8))", f"({_PV} - (vx + dv))")], 0, 60)


def _span_sql(name: str, span: tuple[str, str, str]) -> str:
    return ", ".join(f"round(CASE WHEN {span[2]} AND {span[0]} <= {span[1]} THEN {end} END, 6) + 0.0 AS {name}_{n}" for n, end in (("from", span[0]), ("to", span[1])))


@query(
    "moving_region_ops",
    with_sql("ev", "mov") + ", b AS (SELECT event_id, ax + vx * 30 AS lo30, ax + 8 + (vx + event_id % 3 - 1) * 30 AS hi30, "
    "event_id % 3 - 1 < 0 AS shrinking, ax, vx, event_id % 3 - 1 AS dv FROM mov) "
    "SELECT event_id, round(lo30, 6) + 0.0 AS lo30, round(hi30, 6) + 0.0 AS hi30, shrinking, lo30 <= 150 AND hi30 >= 100 AS meets_30, "
    f"lo30 <= 110 AND hi30 >= 111 AS holds_30, {_span_sql('meets', _MEET)}, {_span_sql('holds', _HOLD)} FROM b",
)
def moving_region_ops(spark, sf):
    """At one time, and over an interval: a growing or shrinking region against a region and a moving point."""
    e = F.col("event_id")
    t = F.lit(30)
    dv = e % 3 - 1
    lo = temporal.position_at(F.col("ax"), F.col("vx"), F.lit(0), t)
    hi = temporal.position_at(F.col("ax") + 8, F.col("vx") + dv, F.lit(0), t)
    region = [((F.col("ax"), F.col("vx")), (F.col("ax") + 8, F.col("vx") + dv))]
    still, zero = [((F.lit(100), F.lit(0)), (F.lit(150), F.lit(0)))], (F.lit(0), F.lit(60))
    point = [((F.lit(120), e % 4),) * 2]
    spans = {"meets": temporal.regions_meet(region, still, *zero), "holds": temporal.region_holds(region, point, *zero)}
    ends = [
        rnd(F.when(may & (start <= end), v)).alias(f"{name}_{n}")
        for name, (start, end, may) in spans.items()
        for n, v in (("from", start), ("to", end))
    ]
    return (
        B.moving(spark, sf)
        .select("event_id", lo.alias("lo"), hi.alias("hi"), (dv < 0).alias("shrinking"), *ends)
        .select(
            "event_id",
            rnd("lo").alias("lo30"),
            rnd("hi").alias("hi30"),
            "shrinking",
            ((F.col("lo") <= 150) & (F.col("hi") >= 100)).alias("meets_30"),
            ((F.col("lo") <= 110) & (F.col("hi") >= 111)).alias("holds_30"),
            *[f"{name}_{n}" for name in spans for n in ("from", "to")],
        )
    )


# patches: one per part, normals from a few directions
PATCH = (
    "WITH pt AS (SELECT p_partkey AS id, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, "
    "CAST((p_partkey * 7) % 5 AS DOUBLE) / 4 AS z, CASE WHEN p_partkey % 3 = 1 THEN 0.6 ELSE 0.0 END AS nx, "
    "CASE WHEN p_partkey % 3 = 2 THEN 0.6 ELSE 0.0 END AS ny, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.8 END AS nz, "
    "0.5 + (p_partkey % 4) * 0.25 AS scale FROM part), "
    "d AS (SELECT a.id AS a, b.id AS b, a.scale + b.scale AS vs, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, "
    "a.nx AS n0x, a.ny AS n0y, a.nz AS n0z, b.nx AS n1x, b.ny AS n1y, b.nz AS n1z FROM pt a JOIN pt b ON a.id < b.id "
    "AND abs(a.x - b.x) < 8 AND abs(a.y - b.y) < 8), "
    "f AS (SELECT *, n0x * dx + n0y * dy + n0z * dz AS f0, n1x * dx + n1y * dy + n1z * dz AS f1 FROM d "
    "WHERE n0x * n1x + n0y * n1y + n0z * n1z >= -0.5), "
    "h AS (SELECT *, sqrt(pow(2*dx - n0x*f0 - n1x*f1, 2) + pow(2*dy - n0y*f0 - n1y*f1, 2) + pow(2*dz - n0z*f0 - n1z*f1, 2)) / 2 / 1.1 AS hs FROM f), "
    "nb AS (SELECT a, b FROM h WHERE hs <= 1.7 / 1.1 AND (abs(f0) + abs(f1)) / 2 / vs / CASE WHEN hs > 1 THEN least(2.0, hs) ELSE 1.0 END < 0.33) "
)


def _patches(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"),
        (k % 40).cast("double").alias("x"),
        F.col("p_size").cast("double").alias("y"),
        (((k * 7) % 5).cast("double") / 4).alias("z"),
        F.when(k % 3 == 1, 0.6).otherwise(0.0).alias("nx"),
        F.when(k % 3 == 2, 0.6).otherwise(0.0).alias("ny"),
        F.when(k % 3 == 0, 1.0).otherwise(0.8).alias("nz"),
        (F.lit(0.5) + (k % 4) * 0.25).alias("scale"),
    )


@query("patch_neighbors", PATCH + "SELECT a, b FROM nb")
def patch_neighbors(spark, sf):
    return patches.patch_neighbours(_patches(spark, sf), "id", 1.1, 0.33, 1.7)


@query(
    "patch_group_filter",
    # groups by repeated label passing; USING KEY keeps one label per patch
    PATCH.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", lnk AS (SELECT a AS s, b AS d FROM nb UNION ALL SELECT b, a FROM nb), "
    "reach(id, lab) USING KEY (id) AS (SELECT id, id AS lab FROM pt UNION "
    "SELECT l.d AS id, MIN(r.lab) AS lab FROM reach r JOIN lnk l ON r.id = l.s JOIN recurring.reach o ON o.id = l.d "
    "WHERE r.lab < o.lab GROUP BY l.d) "
    "SELECT id FROM reach WHERE lab IN (SELECT lab FROM reach GROUP BY lab HAVING COUNT(*) >= 5)",
)
def patch_group_filter(spark, sf):
    return patches.drop_small_patch_groups(_patches(spark, sf), "id", 1.1, 0.33, 1.7, 5).select("id")


CAMV = (
    "WITH v AS (SELECT c_custkey AS vid, c_custkey % 97 AS x, c_acctbal / 100 AS y, c_nationkey AS z FROM customer), "
    "c AS (SELECT s_suppkey AS cam, s_suppkey % 97 AS cx, s_acctbal / 100 AS cy, 12.0 AS half FROM supplier), "
    "j AS (SELECT vid, cam, 500 * (x - cx) / (z + 40) + 160 AS u, 500 * (y - cy) / (z + 40) + 120 AS v FROM v JOIN c "
    "ON x BETWEEN cx - half AND cx + half AND y BETWEEN cy - half AND cy + half) "
)


def _views(spark, sf, best=None):
    v = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("vid"),
        (F.col("c_custkey") % 97).alias("x"),
        (F.col("c_acctbal") / 100).alias("y"),
        F.col("c_nationkey").alias("z"),
    )
    k = F.col("s_suppkey")
    c = table(spark, sf, "supplier").select(
        k.alias("cam"), (k % 97).alias("cx"), (F.col("s_acctbal") / 100).alias("cy")
    )
    for n in "xy":
        c = c.withColumn(f"l{n}", F.col(f"c{n}") - 12.0).withColumn(f"h{n}", F.col(f"c{n}") + 12.0)
    see = lambda v, **more: cameras.cameras_of_vertices(v, ["x", "y"], c, [("lx", "hx"), ("ly", "hy")], [24.0, 24.0], **more)
    if best is None:
        j = see(v)
    else:
        # without a depth there is no distance in the image, and cameras rank by their id
        j = see(v.where("z is not null"), nearest=(best, "cam", ["cx", "cy"])).unionByName(see(v.where("z is null"), ranked=True))
    u = F.lit(500) * (F.col("x") - F.col("cx")) / (F.col("z") + 40) + 160
    w = F.lit(500) * (F.col("y") - F.col("cy")) / (F.col("z") + 40) + 120
    return j.select("vid", "cam", u.alias("u"), w.alias("v"))


@query("camera_vertex_join", CAMV + "SELECT vid, cam, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v FROM j")
def camera_vertex_join(spark, sf):
    return _views(spark, sf).select("vid", "cam", rnd("u").alias("u"), rnd("v").alias("v"))


@query(
    "win_topk_cameras",
    CAMV + ", d AS (SELECT vid, cam, (u - 160) * (u - 160) + (v - 120) * (v - 120) AS d FROM j) "
    "SELECT vid, cam, rank, round(d, 4) + 0.0 AS d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vid ORDER BY d, cam) AS rank FROM d) WHERE rank <= 4",
)
def win_topk_cameras(spark, sf):
    du, dv = F.col("u") - 160, F.col("v") - 120
    d = _views(spark, sf, best=4).select("vid", "cam", (du * du + dv * dv).alias("d"))
    best = cameras.best_per_key(d, "vid", ["d", "cam"], 4)
    return best.select("vid", "cam", F.col("rank").cast("bigint").alias("rank"), rnd("d", 4).alias("d"))


# sky map of heights: one cell per (col, row); customers are draped onto it
@query(
    "height_lookup",
    with_sql("pix") + ", p AS (SELECT c_custkey, c_custkey % 620 / 10.0 AS px, (c_custkey * 13) % 620 / 10.0 AS py FROM customer), "
    "f AS (SELECT *, CAST(floor(px) AS BIGINT) AS ci, CAST(floor(py) AS BIGINT) AS ri, px - floor(px) AS fx, py - floor(py) AS fy FROM p) "
    "SELECT c_custkey, round((1 - fy) * ((1 - fx) * a.value + fx * b.value) + fy * ((1 - fx) * c.value + fx * d.value), 4) + 0.0 AS z FROM f "
    "JOIN pix a ON a.col = ci AND a.row = ri JOIN pix b ON b.col = ci + 1 AND b.row = ri "
    "JOIN pix c ON c.col = ci AND c.row = ri + 1 JOIN pix d ON d.col = ci + 1 AND d.row = ri + 1",
)
def height_lookup(spark, sf):
    from geoloom.operators.tiles import drape

    k = F.col("c_custkey")
    pts = table(spark, sf, "customer").select("c_custkey", (k % 620 / 10.0).alias("px"), ((k * 13) % 620 / 10.0).alias("py"))
    return drape(pts, "c_custkey", "px", "py", B.pixels(spark, sf)).select("c_custkey", rnd("z", 4).alias("z"))
