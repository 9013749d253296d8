"""Column expressions applied to whole tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from geoloom.functions import angles as A
from geoloom.functions import colour as C
from geoloom.functions import geom as G
from geoloom.functions import numeric as N
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table
from geoloom.sources.text import fields

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
KEYS = ", ".join(KEY)
PTS = with_sql("pts")


def r6(e: str, name: str, n: int = 6) -> str:
    return f"round({e}, {n}) + 0.0 AS {name}"


def named(cols, names, digits: int = 6):
    return [rnd(c, digits).alias(n) for c, n in zip(cols, names)]


@query(
    "fn_vec_ops",
    PTS + f"SELECT {KEYS}, {r6('x / sqrt(x*x + y*y + z*z)', 'ux')}, {r6('z / sqrt(x*x + y*y + z*z)', 'uz')}, {r6('y * 3 - z * 2', 'cx')}, {r6('z * 1 - x * 3', 'cy')}, "
    f"{r6('x * 2 - y * 1', 'cz')}, {r6('sqrt(x*x + y*y + z*z)', 'len')}, {r6('(x + 1) * 0.5', 'half')}, {r6('-(y - 2)', 'back')} FROM pts",
)
def fn_vec_ops(spark, sf):
    p, q = G.cols("x", "y", "z"), [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    u, c = G.normalise(p), G.cross(p, q)
    cols = [u[0], u[2], *c, G.magnitude(p), G.scale(G.add(p, q), 0.5)[0], G.flip(G.sub(p, q))[1]]
    return B.points(spark, sf).select(*KEY, *named(cols, ("ux", "uz", "cx", "cy", "cz", "len", "half", "back")))


@query(
    "fn_mat_ops",
    PTS + ", a AS (SELECT *, l_linenumber * 0.3 AS t FROM pts), b AS (SELECT *, cos(t) * y - sin(t) * z AS y1, sin(t) * y + cos(t) * z AS z1 FROM a) "
    f"SELECT {KEYS}, {r6('cos(0.7) * x + sin(0.7) * z1', 'x')}, {r6('y1', 'y')}, {r6('cos(0.7) * z1 - sin(0.7) * x', 'z')} FROM b",
)
def fn_mat_ops(spark, sf):
    p = G.rotate(G.cols("x", "y", "z"), "x", F.col("l_linenumber") * 0.3)
    p = G.rotate(p, "y", 0.7)
    return B.points(spark, sf).select(*KEY, *named(p, "xyz"))


@query(
    "fn_deg_rad_wrap",
    with_sql("ev") + ", a AS (SELECT event_id, radians((event_id % 2000 - 1000) * 1.7) AS t FROM ev) "
    f"SELECT event_id, {r6('t', 'rad')}, {r6('degrees(t)', 'deg')}, {r6('t - 2 * pi() * CASE WHEN t >= 0 THEN floor((t + pi()) / (2 * pi())) ELSE ceil((t - pi()) / (2 * pi())) END', 'wrapped')} FROM a",
)
def fn_deg_rad_wrap(spark, sf):
    t = F.radians((F.col("event_id") % 2000 - 1000) * 1.7)
    return B.events(spark, sf).select("event_id", *named([t, F.degrees(t), A.wrap(t)], ("rad", "deg", "wrapped")))


@query(
    "fn_pose_algebra",
    with_sql("ev") + ", p AS (SELECT event_id, value AS x, event_id % 17 * 1.0 AS y, event_id % 60 / 10.0 - 3 AS a FROM ev) "
    f"SELECT event_id, {r6('x + cos(a) * 2 - sin(a) * 1', 'ox')}, {r6('y + sin(a) * 2 + cos(a) * 1', 'oy')}, {r6('cos(a) * (10 - x) + sin(a) * (5 - y)', 'tx')}, "
    f"{r6('-sin(a) * (10 - x) + cos(a) * (5 - y)', 'ty')}, {r6('cos(0.5) * (x - 2) + sin(0.5) * (y - 1)', 'mx')}, {r6('a - 0.5', 'ma')}, "
    f"{r6('atan2(sin(a + 2.5), cos(a + 2.5))', 'ea')} FROM p",
)
def fn_pose_algebra(spark, sf):
    e = F.col("event_id")
    pose = [F.col("value"), e % 17 * 1.0, e % 60 / 10.0 - 3]
    out = A.from_frame(pose, [F.lit(2.0), F.lit(1.0)])
    into = A.to_frame(pose, [F.lit(10.0), F.lit(5.0)])
    rel = A.pose_difference(pose, [F.lit(2.0), F.lit(1.0), F.lit(0.5)])
    near = A.nudge(pose, [F.lit(0.0), F.lit(0.0), F.lit(2.5)])
    same = A.pose_sum(pose, [F.lit(2.0), F.lit(1.0), F.lit(0.0)])
    cols = [same[0], out[1], into[0], into[1], rel[0], rel[2], near[2]]
    return B.events(spark, sf).select("event_id", *named(cols, ("ox", "oy", "tx", "ty", "mx", "ma", "ea")))


SONAR = {"bearing_fov": 0.9, "elevation_fov": 0.4, "bearings": 96, "ranges": 512, "r_min": 2.0, "r_max": 90.0}


@query(
    "fn_sonar_project",
    PTS + ", s AS (SELECT *, y - 25 AS sy, z - 5 AS sz FROM pts), b AS (SELECT *, (atan2(sy, x) / 0.9 + 0.5) * 96 AS bb, (sqrt(x*x + sy*sy + sz*sz) - 2) / 88 * 512 AS rr, "
    "atan2(sz, sqrt(x*x + sy*sy)) / 0.4 AS el FROM s) "
    f"SELECT {KEYS}, {r6('bb', 'bearing')}, {r6('rr', 'range')}, bb >= 0 AND bb < 96 AND rr >= 0 AND rr < 512 AND el BETWEEN -0.5 AND 0.5 AS visible FROM b",
)
def fn_sonar_project(spark, sf):
    b, r, seen = A.sonar_project([F.col("x"), F.col("y") - 25, F.col("z") - 5], SONAR)
    return B.points(spark, sf).select(*KEY, rnd(b).alias("bearing"), rnd(r).alias("range"), seen.alias("visible"))


@query(
    "fn_plane_distance",
    PTS + ", d AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE least(abs(0.1 * x - 0.05 * y + 0.2 * z - 0.5) * 1.1, 1.0) END AS d, l_partkey % 100 / 100.0 AS nov FROM pts) "
    f"SELECT {KEYS}, round(d * (1 - 0.66) + nov * 0.66, 9) + 0.0 AS score, nov > 0.26 AS novel, d * (1 - 0.66) + nov * 0.66 > 0.26 AS changed FROM d",
)
def fn_plane_distance(spark, sf):
    on = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(1.0)
    plane = [on * 0.1, on * -0.05, on * 0.2, on * -0.5]
    score, novel, changed = C.plane_novelty(G.cols("x", "y", "z"), plane, F.col("l_partkey") % 100 / 100.0)
    return B.points(spark, sf).select(*KEY, rnd(score, 9).alias("score"), novel.alias("novel"), changed.alias("changed"))


def _cl(e: str) -> str:
    return f"least(greatest({e}, 0.0), 1.0)"


@query(
    "fn_colour_maps",
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 100000 AS v FROM lineitem), b AS (SELECT *, least(v, 1.0) AS c, least(v, 1.0) * 3 AS t, floor(least(v, 1.0) * 3) AS i, floor(v * 6) % 6 AS h, v * 6 - floor(v * 6) AS f FROM a) "
    f"SELECT {KEYS}, {r6(_cl('least(4 * c - 1.5, -4 * c + 4.5)'), 'jet_r', 11)}, {r6(_cl('least(4 * c - 0.5, -4 * c + 3.5)'), 'jet_g', 11)}, {r6(_cl('least(4 * c + 0.5, -4 * c + 2.5)'), 'jet_b', 11)}, "
    f"{r6('CASE h WHEN 0 THEN 1 WHEN 1 THEN 1 - f WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN f ELSE 1 END', 'rain_r', 11)}, "
    f"{r6('CASE h WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - f ELSE 0 END', 'rain_g', 11)}, "
    f"{r6('CASE WHEN v < 1 / 3.0 THEN 3 * v ELSE 1 END', 'cold_b', 11)}, {r6('CASE WHEN v < 1 / 3.0 THEN 0 WHEN v < 2 / 3.0 THEN 3 * v - 1 ELSE 1 END', 'cold_g', 11)}, "
    f"{r6('CASE WHEN v < 2 / 3.0 THEN 0 WHEN v < 1 THEN 3 * v - 2 ELSE 1 END', 'hot_b', 11)}, "
    f"{r6('CASE i WHEN 0 THEN 0.3194 * t WHEN 1 THEN 0.6528 * (t - 1) WHEN 2 THEN t - 2 ELSE 1 END', 'bone_r', 11)}, "
    f"{r6('CASE i WHEN 0 THEN 0.4444 * t WHEN 1 THEN 0.7778 * (t - 1) WHEN 2 THEN t - 2 ELSE 0 END', 'bone_b', 11)} FROM b",
)
def fn_colour_maps(spark, sf):
    v = F.col("l_extendedprice") / 100000
    j, rain, cold, hot, bone = C.jet(v), C.rainbow(v), C.cold(v), C.hot(v), C.bone(v)
    cols = [*j, rain[0], rain[1], cold[2], cold[1], hot[2], bone[0], bone[2]]
    names = ("jet_r", "jet_g", "jet_b", "rain_r", "rain_g", "cold_b", "cold_g", "hot_b", "bone_r", "bone_b")
    return table(spark, sf, "lineitem").select(*KEY, *named(cols, names, 11))


def _lin(c: str) -> str:
    return f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"


def _lab(e: str) -> str:
    return f"CASE WHEN {e} > 0.008856 THEN pow({e}, 1 / 3.0) ELSE 7.787 * {e} + 16 / 116.0 END"


@query(
    "fn_colour_distance",
    with_sql("vert") + f", n AS (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb, r / 255.0 AS fr, g / 255.0 AS fg, b / 255.0 AS fb FROM vert), "
    "x AS (SELECT *, 0.4125 * lr + 0.3576 * lg + 0.1804 * lb AS cx, 0.2125 * lr + 0.7154 * lg + 0.0721 * lb AS cy, 0.0193 * lr + 0.1192 * lg + 0.9502 * lb AS cz, "
    "(0.4124 * fr + 0.3576 * fg + 0.1805 * fb) / 0.9505 AS px, 0.2126 * fr + 0.7152 * fg + 0.0722 * fb AS py, (0.0193 * fr + 0.1192 * fg + 0.9505 * fb) / 1.089 AS pz, "
    "greatest(fr, fg, fb) AS mx, least(fr, fg, fb) AS mn FROM n), "
    "l AS (SELECT *, CASE WHEN cy > 0.008856 THEN 116 * pow(cy, 1 / 3.0) - 16 ELSE 903.3 * cy END AS lum, cx + 15 * cy + 3 * cz AS tt, "
    f"{_lab('px')} AS ax, {_lab('py')} AS ay, {_lab('pz')} AS az FROM x) "
    f"SELECT vid, {r6('CAST(0.30 * r + 0.59 * g + 0.11 * b AS DOUBLE)', 'luma')}, {r6('pow(r - 100, 2) + pow(g - 50, 2) + pow(b - 25, 2)', 'd2', 3)}, "
    f"{r6('0.30 * pow(r - 100, 2) + 0.59 * pow(g - 50, 2) + 0.11 * pow(b - 25, 2)', 'wd2', 3)}, {r6('sqrt(pow(r - 100, 2) + pow(g - 50, 2) + pow(b - 25, 2))', 'd', 5)}, "
    f"{r6('lum', 'l', 4)}, {r6('13 * lum * (CASE WHEN tt = 0 THEN 4 ELSE 4 * cx / tt END - 0.19784977571475)', 'u', 4)}, {r6('13 * lum * (CASE WHEN tt = 0 THEN 0.6 ELSE 9 * cy / tt END - 0.46834507665248)', 'v', 4)}, "
    f"{r6('CASE WHEN mx = mn THEN 0 WHEN fr = mx AND fg >= fb THEN (fg - fb) / (mx - mn) / 6 WHEN fr = mx THEN (fg - fb) / (mx - mn) / 6 + 1 WHEN fg = mx THEN (fb - fr) / (mx - mn) / 6 + 1 / 3.0 ELSE (fr - fg) / (mx - mn) / 6 + 2 / 3.0 END', 'hue')}, "
    f"{r6('CASE WHEN mx = 0 THEN 0 ELSE 1 - mn / mx END', 'sat')}, {r6('(116 * ay - 16) / 100', 'lab_l')}, {r6('0.5 + 500 * (ax - ay) / 254', 'lab_a')}, {r6('0.5 + 200 * (ay - az) / 254', 'lab_b')} FROM l",
)
def fn_colour_distance(spark, sf):
    c = G.cols("r", "g", "b")
    o = [F.lit(100), F.lit(50), F.lit(25)]
    unit = [v / 255.0 for v in c]
    d2 = C.distance2(c, o)
    hsv = C.rgb_to_hsv(unit)
    return B.vertices(spark, sf).select(
        "vid",
        rnd(C.luma(c)).alias("luma"),
        rnd(d2, 3).alias("d2"),
        rnd(C.distance2(c, o, C.LUMA_WEIGHTS), 3).alias("wd2"),
        rnd(F.sqrt(d2), 5).alias("d"),
        *named(C.rgb_to_luv(c), "luv", 4),
        *named(hsv[:2], ("hue", "sat")),
        *named(C.rgb_to_lab(unit), ("lab_l", "lab_a", "lab_b")),
    )


def _w(t: str) -> str:
    return (
        f"(pow(greatest({t} + 2, 0), 3) - 4 * pow(greatest({t} + 1, 0), 3) + 6 * pow(greatest({t}, 0), 3) - 4 * pow(greatest({t} - 1, 0), 3)) / 6"
    )


_BIC = " + ".join(f"({m} * l_linenumber + {n} * {n} + l_quantity) * ({_w(f'({m} - 1 - fy)')}) * ({_w(f'({n} - 1 - fx)')})" for m in range(4) for n in range(4))


@query(
    "fn_interpolate",
    "WITH a AS (SELECT *, l_discount * 9 AS fx, l_tax * 11 AS fy FROM lineitem) "
    f"SELECT {KEYS}, {r6('l_quantity + (l_linenumber - l_quantity) * fx', 'lin')}, "
    f"{r6('(1 - fy) * ((1 - fx) * l_quantity + fx * l_linenumber) + fy * ((1 - fx) * 3 + fx * 8)', 'bi')}, "
    f"{r6('(-l_quantity + 3 * l_linenumber - 9 + 8) * fx * fx * fx + (3 * l_quantity - 6 * l_linenumber + 9) * fx * fx + (-2 * l_quantity - 3 * l_linenumber + 18 - 8) * fx + l_linenumber', 'cub')}, "
    f"{r6(_BIC, 'bicub')} FROM a",
)
def fn_interpolate(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    fx, fy = F.col("l_discount") * 9, F.col("l_tax") * 11
    patch = [[n * m + float(k * k) + q for k in range(4)] for m in range(4)]
    cols = [
        N.lerp([q, n], fx),
        N.bilinear([q, n, F.lit(3.0), F.lit(8.0)], fx, fy),
        N.cubic([q, n, F.lit(3.0), F.lit(8.0)], fx),
        N.bicubic(patch, fx, fy),
    ]
    return table(spark, sf, "lineitem").select(*KEY, *named(cols, ("lin", "bi", "cub", "bicub")))


@query(
    "fn_photo_scores",
    "WITH a AS (SELECT vec_id, CAST(embedding[1:30] AS DOUBLE[]) AS p, CAST(embedding[31:60] AS DOUBLE[]) AS q FROM embeddings), "
    "m AS (SELECT *, list_avg(p) AS mp, list_avg(q) AS mq, list_stddev_pop(p) AS sp, list_stddev_pop(q) AS sq FROM a), "
    "n AS (SELECT *, list_transform(p, lambda v: (v - mp) / sp) AS zp, list_transform(q, lambda v: (v - mq) / sq) AS zq FROM m) "
    "SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda v: pow(v[1] * 100 - v[2] * 100, 2))) / (10 * 255.0 * 255.0 * 3), 6) AS ssd, "
    "round(1 - list_sum(list_transform(list_zip(zp, zq), lambda v: v[1] * v[2])) / 30, 6) + 0.0 AS ncc, round(zp[1], 6) + 0.0 AS z0 FROM n",
)
def fn_photo_scores(spark, sf):
    e = F.col("embedding").cast("array<double>")
    t = table(spark, sf, "embeddings").select("vec_id", F.slice(e, 1, 30).alias("p"), F.slice(e, 31, 30).alias("q"))
    z = N.normalise_textures(t, {"zp": "p", "zq": "q"})
    return z.select(
        "vec_id",
        rnd(N.ssd(F.col("p"), F.col("q")) * 10000).alias("ssd"),
        rnd(N.one_minus_dot(F.col("zp"), F.col("zq"))).alias("ncc"),
        rnd(F.col("zp")[0]).alias("z0"),
    )


@query(
    "fn_patch_score",
    "SELECT p_partkey, round(greatest(0.0, p_size / 50.0 - 0.7) * (1 + p_partkey % 4), 6) AS score FROM part",
)
def fn_patch_score(spark, sf):
    images = F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf, "part").select("p_partkey", rnd(N.patch_score(F.col("p_size") / 50.0, 0.7, images)).alias("score"))


@query(
    "fn_number_utils",
    f"SELECT {KEYS}, least(greatest(l_quantity, 10.0), 40.0) AS clamped, CAST(CASE WHEN l_partkey <= 1 THEN 0 ELSE floor(log2(l_partkey)) END AS INTEGER) AS lg, bit_count(l_partkey) <= 1 AS pow2, "
    "CAST(CASE WHEN l_partkey = 0 THEN 0 ELSE pow(2, ceil(log2(l_partkey))) END AS BIGINT) AS up, CAST(round(l_discount * 50 - 2.3) AS BIGINT) AS near FROM lineitem",
)
def fn_number_utils(spark, sf):
    return table(spark, sf, "lineitem").select(
        *KEY,
        N.clamp(F.col("l_quantity"), F.lit(10.0), F.lit(40.0)).alias("clamped"),
        N.floor_log2("l_partkey").alias("lg"),
        N.is_power_of_two(F.col("l_partkey")).alias("pow2"),
        N.next_power_of_two("l_partkey").alias("up"),
        N.round_away(F.col("l_discount") * 50 - 2.3).alias("near"),
    )


@query(
    "fn_string_split",
    "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n]'), lambda s: s <> '') AS w FROM documents) "
    "SELECT doc_id, CAST(len(w) AS INTEGER) AS n, w[1] AS first, w[len(w)] AS last FROM w",
)
def fn_string_split(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", fields("text").alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.get("w", F.lit(0)).alias("first"), F.get("w", F.size("w") - 1).alias("last"))


@query(
    "fn_timestamp_math",
    "WITH a AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 1000000.0 AS d, (event_id % 300000) * 1.25 AS e, ts < TIMESTAMP '2024-01-10 00:00:00' AS before FROM events) "
    "SELECT event_id, round(d, 6) + 0.0 AS diff, round(d + 90.5, 6) + 0.0 AS later, before, CASE WHEN e >= 86400 THEN printf('%dd %02d:%02d:%02d', CAST(floor(e / 86400) AS BIGINT), CAST(floor(e) AS BIGINT) // 3600 % 24, CAST(floor(e) AS BIGINT) // 60 % 60, CAST(floor(e) AS BIGINT) % 60) "
    "WHEN e >= 3600 THEN printf('%02d:%02d:%02d', CAST(floor(e) AS BIGINT) // 3600, CAST(floor(e) AS BIGINT) // 60 % 60, CAST(floor(e) AS BIGINT) % 60) "
    "WHEN e >= 60 THEN printf('%02d:%02d', CAST(floor(e) AS BIGINT) // 60, CAST(floor(e) AS BIGINT) % 60) ELSE printf('%.6f', CAST(e AS DOUBLE)) END AS shown FROM a",
)
def fn_timestamp_math(spark, sf):
    day = 1704844800000000
    d = (F.col("t") - day) / 1000000.0
    return B.events(spark, sf).select(
        "event_id",
        rnd(d).alias("diff"),
        rnd(d + 90.5).alias("later"),
        (F.col("t") < day).alias("before"),
        N.elapsed(F.col("event_id") % 300000 * 1.25).alias("shown"),
    )


@query("fn_tile_name", with_sql("pix") + "SELECT col, row, printf('r%04d_c%04d', row, col) AS name FROM pix")
def fn_tile_name(spark, sf):
    return B.pixels(spark, sf).select("col", "row", F.format_string("r%04d_c%04d", "row", "col").alias("name"))


# the twin undoes the distortion by construction: the source is a distorted known place
@query(
    "fn_camera_project",
    PTS + ", a AS (SELECT *, x / (z + 30.7) AS px, y / (z + 30.7) AS py FROM pts), b AS (SELECT *, px * px + py * py AS r2 FROM a) "
    f"SELECT {KEYS}, {r6('500 * (1 + 0.01 * r2 + 0.001 * r2 * r2) * px', 'u', 4)}, {r6('500 * (1 + 0.01 * r2 + 0.001 * r2 * r2) * py', 'v', 4)}, {r6('500 * px', 'iu', 3)}, {r6('500 * py', 'iv', 3)} FROM b",
)
def fn_camera_project(spark, sf):
    f = F.lit(500.0)
    uv = N.radial_project([F.col("x"), F.col("y"), F.col("z") + 30.7], f, 0.01, 0.001)
    placed = B.points(spark, sf).select(*KEY, uv[0].alias("pu"), uv[1].alias("pv"))
    back = N.radial_undistort(F.col("pu"), F.col("pv"), f, 0.01, 0.001)
    return placed.select(*KEY, *named([F.col("pu"), F.col("pv")], "uv", 4), *named(back, ("iu", "iv"), 3))


@query(
    "fn_camera_centres",
    "WITH c AS (SELECT s_suppkey, s_nationkey * 0.1 AS a, CAST(s_suppkey % 7 AS DOUBLE) AS tx, s_acctbal / 100 AS ty, CAST(4.0 AS DOUBLE) AS tz, s_suppkey % 11 <> 0 AS placed FROM supplier) "
    f"SELECT s_suppkey, {r6('-(cos(a) * tx + sin(a) * ty)', 'x')}, {r6('-(-sin(a) * tx + cos(a) * ty)', 'y')}, {r6('-tz', 'z')} FROM c WHERE placed",
)
def fn_camera_centres(spark, sf):
    k, a = F.col("s_suppkey"), F.col("s_nationkey") * 0.1
    focal = F.when(k % 11 != 0, 500.0)  # cameras without a focal length were not placed
    zero, one = F.lit(0.0), F.lit(1.0)
    rot = [[F.cos(a), -F.sin(a), zero], [F.sin(a), F.cos(a), zero], [zero, zero, one]]
    c = N.camera_centre(rot, [(k % 7).cast("double"), F.col("s_acctbal") / 100, F.lit(4.0)])
    return table(spark, sf, "supplier").where(focal.isNotNull()).select("s_suppkey", *named(c, "xyz"))


# quadrilaterals whose third corner moves inward for some rows
@query(
    "fn_polygon_measures",
    "WITH q AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, CASE WHEN p_partkey % 3 = 0 THEN p_size / 4.0 ELSE CAST(p_size AS DOUBLE) END AS c FROM part), "
    "a AS (SELECT *, (w * c - c * 0 + c * w - 0 * c) / 2 AS area FROM q) "
    "SELECT p_partkey, round(w * c, 6) + 0.0 AS area, c >= w / 2 AS convex, "
    "((c - w) * 2 - c * (2 - w) >= 0) AND ((0 - c) * (2 - c) - (w - c) * (2 - c) >= 0) AS kernel, "
    "round(CASE WHEN c <= 3 THEN CASE WHEN w <= 3 THEN w * c ELSE w * c - pow(w - 3, 2) * c / (w - c) / 2 END ELSE 0 END, 6) + 0.0 AS clipped FROM a WHERE c <= 3".replace(" WHERE c <= 3", ""),
)
def fn_polygon_measures(spark, sf):
    w = F.col("p_size").cast("double")
    c = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 4.0).otherwise(w)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    poly = F.array(pt(zero, zero), pt(w, zero), pt(c, c), pt(zero, w))
    out = table(spark, sf, "part").select("p_partkey", poly.alias("poly"), c.alias("c"))
    cut = N.clip_half_plane(F.col("poly"), (3.0, 0.0), (3.0, 1.0))
    return out.select(
        "p_partkey",
        rnd(N.signed_area(F.col("poly"))).alias("area"),
        N.is_convex(F.col("poly")).alias("convex"),
        N.in_kernel(F.col("poly"), F.lit(2.0), F.lit(2.0)).alias("kernel"),
        rnd(F.when(F.col("c") <= 3, N.signed_area(cut)).otherwise(0.0)).alias("clipped"),
    )


