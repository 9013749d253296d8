"""Aggregates on points, voxels and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import aggregates as agg
from geoloom.operators import cameras, joins, voxel
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table

XYZ = ["x", "y", "z"]


def _line_points(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        (F.col("l_tax") * 100 + 1).alias("w"),
    )


LP = (
    "lp AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity AS x, l_extendedprice / 1000 AS y, "
    "l_discount * 100 AS z, l_tax * 100 + 1 AS w FROM lineitem) "
)


@query(
    "agg_bbox",
    f"WITH {LP} SELECT l_returnflag, MIN(x) AS min_x, MAX(x) AS max_x, MIN(y) AS min_y, MAX(y) AS max_y, MIN(z) AS min_z, MAX(z) AS max_z "
    "FROM lp GROUP BY ROLLUP (l_returnflag)",
)
def agg_bbox(spark, sf):
    return agg.bbox(_line_points(spark, sf), XYZ, "l_returnflag")


_DIRS = ["x", "y", "z", "x + y + z", "x + y - z", "x - y + z", "x - y - z"]
_ENDS = ", ".join(
    f"l{i} AS (SELECT * FROM lp ORDER BY {d}, x, y, z LIMIT 1), h{i} AS (SELECT * FROM lp ORDER BY {d} DESC, x DESC, y DESC, z DESC LIMIT 1)"
    for i, d in enumerate(_DIRS)
)
_PAIRS = " UNION ALL ".join(
    f"SELECT {i} AS i, pow(h.x - l.x, 2) + pow(h.y - l.y, 2) + pow(h.z - l.z, 2) AS w, (h.x + l.x) / 2 AS cx, (h.y + l.y) / 2 AS cy, "
    f"(h.z + l.z) / 2 AS cz FROM l{i} l, h{i} h"
    for i in range(7)
)


@query(
    "agg_bsphere",
    f"WITH {LP}, {_ENDS}, c AS (SELECT * FROM ({_PAIRS}) ORDER BY w DESC, i LIMIT 1) "
    "SELECT round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, "
    "round(sqrt(MAX(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))), 6) AS radius FROM lp, c GROUP BY ALL",
)
def agg_bsphere(spark, sf):
    return agg.bounding_sphere(_line_points(spark, sf), XYZ).select(*[rnd(c).alias(c) for c in ("cx", "cy", "cz", "radius")])


@query(
    "agg_mean_stdev",
    "SELECT l_returnflag, COUNT(*) AS n, round(AVG(l_extendedprice), 3) AS mean, round(COALESCE(stddev_samp(l_extendedprice), 0), 3) AS stdev "
    "FROM lineitem GROUP BY l_returnflag",
)
def agg_mean_stdev(spark, sf):
    out = agg.mean_stdev(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", rnd("mean", 3).alias("mean"), rnd("stdev", 3).alias("stdev"))


@query(
    "agg_histogram",
    "WITH h AS (SELECT CAST(trunc((l_extendedprice - 5000) * 20.0 / 90000) AS INTEGER) AS bin FROM lineitem), "
    "c AS (SELECT bin, COUNT(*) AS n FROM h GROUP BY bin) "
    "SELECT CAST(i AS INTEGER) AS bin, CAST(5000 + i * 4500 AS DOUBLE) AS edge, COALESCE(n, 0) AS n, (SELECT MIN(l_extendedprice) FROM lineitem) AS actual_min, "
    "(SELECT MAX(l_extendedprice) FROM lineitem) AS actual_max FROM range(0, 20) r(i) LEFT JOIN c ON c.bin = i",
)
def agg_histogram(spark, sf):
    return agg.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 5000.0, 95000.0, 20)


@query("agg_median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY l_returnflag")
def agg_median(spark, sf):
    out = agg.quantile(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5, "median")
    return out.select("l_returnflag", rnd("median", 4).alias("median"))


@query(
    "agg_weighted_median",
    "WITH o AS (SELECT l_returnflag, l_extendedprice AS v, l_quantity AS w, "
    "SUM(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS cum, "
    "SUM(l_quantity) OVER (PARTITION BY l_returnflag) / 2 AS half, "
    "LAG(l_extendedprice) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS prev FROM lineitem) "
    "SELECT l_returnflag, round(CASE WHEN prev IS NULL THEN v ELSE (half - (cum - w)) / w * v + (1 - (half - (cum - w)) / w) * prev END, 4) AS wmedian "
    "FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY cum) AS rn FROM o WHERE cum >= half) WHERE rn = 1",
)
def agg_weighted_median(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    out = agg.weighted_median(li, ["l_returnflag"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"])
    return out.select("l_returnflag", rnd("wmedian", 4).alias("wmedian"))


@query(
    "agg_weight_mean_quirk",
    "SELECT l_suppkey, round(SUM(l_extendedprice) / SUM(greatest(l_quantity, 1e-30)), 4) AS wmean FROM lineitem GROUP BY l_suppkey",
)
def agg_weight_mean_quirk(spark, sf):
    out = agg.plain_weight_mean(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")
    return out.select("l_suppkey", rnd("wmean", 4).alias("wmean"))


@query(
    "agg_kth",
    "SELECT l_suppkey, l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, "
    "ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn FROM lineitem) WHERE rn = 25",
)
def agg_kth(spark, sf):
    return agg.kth_smallest(table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", 25)


@query(
    "agg_centroid",
    f"WITH {LP} SELECT l_returnflag, round(AVG(x), 6) AS cx, round(AVG(y), 6) AS cy, round(AVG(z), 6) AS cz FROM lp GROUP BY l_returnflag",
)
def agg_centroid(spark, sf):
    return _line_points(spark, sf).groupBy("l_returnflag").agg(*[rnd(F.avg(c)).alias(f"c{c}") for c in XYZ])


COV = ", ".join(f"round(covar_pop({a}, {b}), 5) + 0.0 AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
COV_NAMES = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]


@query("agg_covariance", f"WITH {LP} SELECT l_returnflag, COUNT(*) AS n, {COV} FROM lp GROUP BY l_returnflag")
def agg_covariance(spark, sf):
    out = agg.moments(_line_points(spark, sf), ["l_returnflag"], XYZ)
    return out.select("l_returnflag", "n", *[rnd(c, 5).alias(c) for c in COV_NAMES])


# closed form of the eigenvalues of a symmetric 3x3 matrix, for the SQL twins
EIG3 = (
    "q3 AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM mom), "
    "p3 AS (SELECT *, sqrt((pow(cxx - q, 2) + pow(cyy - q, 2) + pow(czz - q, 2) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM q3), "
    "r3 AS (SELECT *, greatest(-1.0, least(1.0, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) "
    "+ cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p))) AS r FROM p3), "
    "eig AS (SELECT *, q + 2 * p * cos(acos(r) / 3) AS e1, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS e3, "
    "3 * q - (q + 2 * p * cos(acos(r) / 3)) - (q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3)) AS e2 FROM r3) "
)
WMOM = (
    ", cen AS (SELECT l_returnflag, COUNT(*) AS n, SUM(w) AS sw, SUM(w * x) / SUM(w) AS mx, SUM(w * y) / SUM(w) AS my, SUM(w * z) / SUM(w) AS mz FROM lp GROUP BY l_returnflag), "
    "mom AS (SELECT c.l_returnflag, n, mx, my, mz, SUM(w * (x - mx) * (x - mx)) / sw AS cxx, SUM(w * (x - mx) * (y - my)) / sw AS cxy, "
    "SUM(w * (x - mx) * (z - mz)) / sw AS cxz, SUM(w * (y - my) * (y - my)) / sw AS cyy, SUM(w * (y - my) * (z - mz)) / sw AS cyz, "
    "SUM(w * (z - mz) * (z - mz)) / sw AS czz FROM lp JOIN cen c ON c.l_returnflag = lp.l_returnflag GROUP BY c.l_returnflag, n, mx, my, mz, sw), "
)


@query(
    "agg_principal_axes",
    f"WITH {LP}{WMOM}{EIG3} SELECT l_returnflag, n, round(mx, 6) AS mx, round(my, 6) AS my, round(mz, 6) AS mz, "
    "round(e1, 4) AS e1, round(e2, 4) AS e2, round(e3, 4) AS e3, TRUE AS axes_fit FROM eig",
)
def agg_principal_axes(spark, sf):
    """Also whether each axis is a unit vector that the covariance only stretches, by its value."""
    pts = _line_points(spark, sf)
    out = agg.principal_axes(pts, ["l_returnflag"], XYZ, F.col("w"))
    mom = agg.moments(pts, ["l_returnflag"], XYZ, F.col("w")).select("l_returnflag", *[f"c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    out = out.join(mom, "l_returnflag")
    tests = []
    for i in range(3):
        v = [F.col("axes")[i][j] for j in range(3)]
        tests.append(F.abs(v[0] * v[0] + v[1] * v[1] + v[2] * v[2] - 1) < 1e-9)
        for a in XYZ:
            row = sum((F.col("c" + "".join(sorted(a + b))) * v[j] for j, b in enumerate(XYZ)), start=F.lit(0.0))
            tests.append(F.abs(row - F.col("values")[i] * v[XYZ.index(a)]) < 1e-6 * F.col("values")[0])
    fit = tests[0]
    for t in tests[1:]:
        fit = fit & t
    return out.select(
        fit.alias("axes_fit"),
        "l_returnflag",
        "n",
        *[rnd(f"m{c}").alias(f"m{c}") for c in XYZ],
        *[rnd(F.col("values")[i], 4).alias(f"e{i + 1}") for i in range(3)],
    )


# the twin takes the normal as the cross product of two rows of (C - e3 I)
@query(
    "agg_plane_fit",
    f"WITH {LP.replace('l_tax * 100 + 1 AS w', '1.0 AS w').replace('l_returnflag,', 'l_linenumber AS l_returnflag,').replace('l_linenumber, l_partkey', 'l_partkey')}{WMOM}{EIG3}, "
    "nn AS (SELECT *, cxy * cyz - cxz * (cyy - e3) AS a, cxz * cxy - (cxx - e3) * cyz AS b, (cxx - e3) * (cyy - e3) - cxy * cxy AS c FROM eig), "
    "nu AS (SELECT *, sqrt(a * a + b * b + c * c) * CASE WHEN c < 0 THEN -1 ELSE 1 END AS s FROM nn) "
    "SELECT l_returnflag AS l_linenumber, n, round(a / s, 5) + 0.0 AS nx, round(b / s, 5) + 0.0 AS ny, round(c / s, 5) + 0.0 AS nz, "
    "round(-(a * mx + b * my + c * mz) / s, 3) + 0.0 AS d0, round(sqrt(e3), 5) AS rms FROM nu",
)
def agg_plane_fit(spark, sf):
    out = agg.plane_fit(_line_points(spark, sf), ["l_linenumber"], XYZ)
    return out.select(
        "l_linenumber",
        "n",
        *[rnd(f"n{c}", 5).alias(f"n{c}") for c in XYZ],
        rnd("d0", 3).alias("d0"),
        rnd("rms", 5).alias("rms"),
    )


@query(
    "agg_plane_ransac",
    f"WITH {LP}, s AS (SELECT x, y, z, ROW_NUMBER() OVER (ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lp), "
    "t AS (SELECT a.i // 3 AS try, a.x, a.y, a.z, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS vx, c.y - a.y AS vy, c.z - a.z AS vz "
    "FROM s a JOIN s b ON b.i = a.i + 1 JOIN s c ON c.i = a.i + 2 WHERE a.i % 3 = 0 AND a.i < 48), "
    "n AS (SELECT *, uy * vz - uz * vy AS a, uz * vx - ux * vz AS b, ux * vy - uy * vx AS c FROM t), "
    "u AS (SELECT try, a / l AS nx, b / l AS ny, c / l AS nz, -(a * x + b * y + c * z) / l AS d0 FROM (SELECT *, sqrt(a * a + b * b + c * c) AS l FROM n) WHERE l > 0), "
    "k AS (SELECT try, nx, ny, nz, d0, COUNT(*) FILTER (abs(nx * x + ny * y + nz * z + d0) <= 1.5) AS inliers, COUNT(*) AS n FROM u, lp GROUP BY ALL) "
    "SELECT round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz, round(d0, 5) + 0.0 AS d0, inliers, n FROM k ORDER BY inliers DESC, try LIMIT 1",
)
def agg_plane_ransac(spark, sf):
    pts = _line_points(spark, sf)
    out = agg.ransac_plane(pts, XYZ, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 16, 1.5)
    return out.select(rnd("nx").alias("nx"), rnd("ny").alias("ny"), rnd("nz").alias("nz"), rnd("d0", 5).alias("d0"), "inliers", "n")


@query(
    "agg_line_fit",
    "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, "
    "round(atan2(2 * covar_pop(l_quantity, l_extendedprice / 1000), var_pop(l_quantity) - var_pop(l_extendedprice / 1000)) / 2, 6) + 0.0 AS angle "
    "FROM lineitem GROUP BY l_suppkey",
)
def agg_line_fit(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    flat = agg.line_fit(li, ["l_suppkey"], "l_quantity", "y")
    return flat.select(
        "l_suppkey",
        rnd(F.col("slope") * 1000, 4).alias("slope"),
        rnd(F.col("intercept") * 1000, 3).alias("intercept"),
        rnd("angle").alias("angle"),
    )


# matched points: the second set is the first one turned by (0.6, 0.8) about z, doubled and
# moved, so the twin states the known map
RIGID = {
    **{"scale": 2.0, "r00": 0.6, "r01": -0.8, "r02": 0.0, "r10": 0.8, "r11": 0.6, "r12": 0.0},
    **{"r20": 0.0, "r21": 0.0, "r22": 1.0, "t0": 3.0, "t1": -1.0, "t2": 0.5},
}


@query(
    "agg_rigid_align",
    "SELECT COUNT(*) AS n, "
    + ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in RIGID.items())
    + " FROM lineitem",
)
def agg_rigid_align(spark, sf):
    """Points at map coordinates, far from the origin."""
    e = [F.col("l_quantity") + 6e6, F.col("l_extendedprice") / 1000 + 6e6, F.col("l_discount") * 100]
    pts = table(spark, sf, "lineitem").select(
        *[v.alias(f"a{i}") for i, v in enumerate(e)],
        ((e[0] * 0.6 - e[1] * 0.8) * 2 + 3).alias("b0"),
        ((e[0] * 0.8 + e[1] * 0.6) * 2 - 1).alias("b1"),
        (e[2] * 2 + 0.5).alias("b2"),
    )
    fit = agg.rigid_align(pts, ["a0", "a1", "a2"], ["b0", "b1", "b2"])
    vals = {f"r{i}{j}": (float(fit["rot"][i, j]), 6) for i in range(3) for j in range(3)}
    vals |= {f"t{i}": (float(fit["move"][i]), 3) for i in range(3)}
    return spark.range(1).select(
        F.lit(fit["n"]).cast("bigint").alias("n"),
        rnd(F.lit(fit["scale"])).alias("scale"),
        *[rnd(F.lit(v), digits).alias(k) for k, (v, digits) in vals.items()],
    )


@query(
    "agg_affine_align",
    "WITH p AS (SELECT l_quantity AS a0, l_extendedprice / 1000 AS a1, l_discount * 100 AS b0, l_tax * 100 + l_quantity / 8 AS b1 FROM lineitem), "
    "c AS (SELECT var_pop(a0) AS s00, var_pop(a1) AS s11, covar_pop(a0, a1) AS s01, covar_pop(a0, b0) AS u0, covar_pop(a1, b0) AS u1, "
    "covar_pop(a0, b1) AS v0, covar_pop(a1, b1) AS v1, AVG(a0) + 6000000 AS ma, AVG(a1) + 5000000 AS mb, AVG(b0) AS mc, AVG(b1) AS md FROM p), "
    "m AS (SELECT *, (u0 * s11 - u1 * s01) / (s00 * s11 - s01 * s01) AS m00, (u1 * s00 - u0 * s01) / (s00 * s11 - s01 * s01) AS m01, "
    "(v0 * s11 - v1 * s01) / (s00 * s11 - s01 * s01) AS m10, (v1 * s00 - v0 * s01) / (s00 * s11 - s01 * s01) AS m11 FROM c) "
    "SELECT round(m00, 6) + 0.0 AS m00, round(m01, 6) + 0.0 AS m01, round(m10, 6) + 0.0 AS m10, round(m11, 6) + 0.0 AS m11, "
    "round(mc - m00 * ma - m01 * mb, 3) + 0.0 AS t0, round(md - m10 * ma - m11 * mb, 3) + 0.0 AS t1 FROM m",
)
def agg_affine_align(spark, sf):
    q = F.col("l_quantity")
    pts = table(spark, sf, "lineitem").select(
        (q + 6e6).alias("a0"), (F.col("l_extendedprice") / 1000 + 5e6).alias("a1"), (F.col("l_discount") * 100).alias("b0"), (F.col("l_tax") * 100 + q / 8).alias("b1")
    )
    fit = agg.affine_align(pts, ["a0", "a1"], ["b0", "b1"])
    vals = {f"m{i}{j}": (float(fit["matrix"][i, j]), 6) for i in range(2) for j in range(2)}
    vals |= {f"t{i}": (float(fit["move"][i]), 3) for i in range(2)}
    return spark.range(1).select(*[rnd(F.lit(v), digits).alias(k) for k, (v, digits) in vals.items()])


# observations are line items: part = point, supplier = camera
@query(
    "agg_reproj_mse",
    "WITH o AS (SELECT l_partkey, l_suppkey, l_quantity AS u, l_discount * 100 AS v FROM lineitem), "
    "e AS (SELECT l_suppkey AS cam_id, pow((10 + s_nationkey) * (p_size - s_suppkey % 7) / (p_retailprice / 100 + 5) - u, 2) "
    "+ pow((10 + s_nationkey) * (p_partkey % 40 - s_suppkey % 11) / (p_retailprice / 100 + 5) - v, 2) AS e2 FROM o "
    "JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey) "
    "SELECT cam_id, COUNT(*) AS n, round(AVG(e2), 4) AS mse FROM e GROUP BY cam_id",
)
def agg_reproj_mse(spark, sf):
    obs = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("point_id"), F.col("l_suppkey").alias("cam_id"), F.col("l_quantity").alias("u"), (F.col("l_discount") * 100).alias("v")
    )
    k = F.col("s_suppkey")
    cams = table(spark, sf, "supplier").select(
        k.alias("cam_id"), (k % 7).alias("tx"), (k % 11).alias("ty"), F.lit(-5.0).alias("tz"), (10 + F.col("s_nationkey")).alias("f")
    )
    pts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("point_id"), F.col("p_size").alias("x"), (F.col("p_partkey") % 40).alias("y"), (F.col("p_retailprice") / 100).alias("z")
    )
    err = cameras.reprojection(obs, cams, pts)
    return err.groupBy("cam_id").agg(F.count("*").alias("n"), rnd(F.avg("err2"), 4).alias("mse"))


PN = (
    "WITH pt AS (SELECT p_partkey AS id, p_partkey * 37 % 101 + p_size / 100.0 AS x, p_size + (p_partkey * 13 % 29) / 30.0 AS y, "
    "p_retailprice / 50 AS z FROM part), "
    "d AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY "
    "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.id) AS rk FROM pt a JOIN pt b ON a.id <> b.id), "
    "mom AS (SELECT id, COUNT(*) AS n, SUM(dx * dx) AS cxx, SUM(dx * dy) AS cxy, SUM(dx * dz) AS cxz, SUM(dy * dy) AS cyy, SUM(dy * dz) AS cyz, "
    "SUM(dz * dz) AS czz FROM d WHERE rk <= 12 GROUP BY id), "
)


@query("agg_point_normals", PN + EIG3 + "SELECT id, n, round(e3, 5) + 0.0 AS spread FROM eig")
def agg_point_normals(spark, sf):
    k = F.col("p_partkey")
    pts = table(spark, sf, "part").select(
        k.alias("id"),
        (k * 37 % 101 + F.col("p_size") / 100.0).alias("x"),
        (F.col("p_size") + (k * 13 % 29) / 30.0).alias("y"),
        (F.col("p_retailprice") / 50).alias("z"),
    )
    return agg.point_normals(pts, "id", XYZ, 12).select("id", "n", rnd("spread", 5).alias("spread"))


VOX = f"WITH {LP}, v AS (SELECT CAST(floor(x / 5) AS BIGINT) AS ix, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(z / 2) AS BIGINT) AS iz, * FROM lp) "


@query(
    "agg_voxel_accumulate",
    VOX + "SELECT ix, iy, iz, COUNT(*) AS cnt, round(AVG(y), 6) AS y, round(AVG(w), 6) AS w FROM v GROUP BY ix, iy, iz HAVING COUNT(*) >= 30",
)
def agg_voxel_accumulate(spark, sf):
    pts = _line_points(spark, sf).withColumn("zz", F.col("z") / 2).withColumn("xx", F.col("x") / 5).withColumn("yy", F.col("y") / 10)
    out = voxel.accumulate(pts, ["xx", "yy", "zz"], 1.0, ["y", "w"], 30)
    return out.select("ix", "iy", "iz", "cnt", rnd("y").alias("y"), rnd("w").alias("w"))


def _voxels(spark, sf):
    return _line_points(spark, sf).select(
        F.floor(F.col("x") / 5).alias("ix"), F.floor(F.col("y") / 10).alias("iy"), F.floor(F.col("z") / 2).alias("iz"), "x", "y", "w"
    )


@query(
    "agg_voxel_merge",
    VOX + "SELECT ix, iy, iz, round(SUM(x * w) / SUM(w), 6) AS x, round(SUM(y * w) / SUM(w), 6) AS y, round(SUM(w), 4) AS w FROM v GROUP BY ix, iy, iz",
)
def agg_voxel_merge(spark, sf):
    out = voxel.fuse(_voxels(spark, sf), ["ix", "iy", "iz"], ["x", "y"], "w")
    return out.select("ix", "iy", "iz", rnd("x").alias("x"), rnd("y").alias("y"), rnd("w", 4).alias("w"))


@query(
    "agg_voxel_downsample",
    VOX + "SELECT CAST(floor(ix / 2) AS BIGINT) AS ix, CAST(floor(iy / 2) AS BIGINT) AS iy, CAST(floor(iz / 2) AS BIGINT) AS iz, "
    "round(SUM(x * w) / SUM(w), 6) AS x, round(SUM(w), 4) AS w FROM v GROUP BY ALL",
)
def agg_voxel_downsample(spark, sf):
    fused = voxel.fuse(_voxels(spark, sf), ["ix", "iy", "iz"], ["x"], "w")
    out = voxel.downsample(fused, ["x"], "w")
    return out.select("ix", "iy", "iz", rnd("x").alias("x"), rnd("w", 4).alias("w"))


# three bands of a view: fine, middle, coarse; a part without a valid view keeps its own price
BANDS = ((0.71, "l_quantity - l_discount * 50"), (0.65, "l_discount * 50 - l_tax * 10"), (0.07, "l_tax * 10"))


def _blend_sql() -> str:
    r = "sqrt(pow(u - 0.5, 2) + pow(v - 0.5, 2))"
    parts = [f"SUM(exp(-{r} * {160.0 * c!r}) * ({e})) / SUM(exp(-{r} * {160.0 * c!r}))" for c, e in BANDS]
    return (
        "WITH w AS (SELECT *, l_discount * 12 - 0.08 AS u, l_tax * 14 - 0.05 AS v FROM lineitem), "
        f"b AS (SELECT l_partkey, {' + '.join(parts)} AS blended FROM w WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AND l_linestatus = 'O' GROUP BY l_partkey) "
        "SELECT p_partkey, round(COALESCE(blended, p_retailprice), 5) + 0.0 AS colour FROM part LEFT JOIN b ON l_partkey = p_partkey"
    )


@query("agg_blend_weights", _blend_sql())
def agg_blend_weights(spark, sf):
    li = table(spark, sf, "lineitem")
    u, v = F.col("l_discount") * 12 - 0.08, F.col("l_tax") * 14 - 0.05
    out = agg.blend_views(li, "l_partkey", [(F.expr(e), c) for c, e in BANDS], u, v, F.col("l_linestatus") == "O")
    part = table(spark, sf, "part").join(out, F.col("p_partkey") == F.col("l_partkey"), "left")
    return part.select("p_partkey", rnd(F.coalesce("blended", "p_retailprice"), 5).alias("colour"))


@query(
    "agg_track_stats",
    "WITH p AS (SELECT l_partkey, l_suppkey, COUNT(*) AS k FROM lineitem GROUP BY ALL), s AS (SELECT l_partkey, COUNT(*) AS views FROM p GROUP BY l_partkey) "
    "SELECT l_suppkey, CAST(SUM(k) AS BIGINT) AS n_obs, COUNT(*) AS n_points, COUNT(*) FILTER (views >= 2) AS n_shared FROM p JOIN s USING (l_partkey) GROUP BY l_suppkey",
)
def agg_track_stats(spark, sf):
    return agg.track_stats(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query(
    "agg_normalize_variance",
    f"WITH {LP}, m AS (SELECT AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz, 1 / sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS k FROM lp) "
    "SELECT l_orderkey, l_linenumber, l_partkey, round((x - mx) * k, 6) + 0.0 AS x, round((y - my) * k, 6) + 0.0 AS y, round((z - mz) * k, 6) + 0.0 AS z FROM lp, m",
)
def agg_normalize_variance(spark, sf):
    out = agg.normalise_variance(_line_points(spark, sf), XYZ)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[rnd(c).alias(c) for c in XYZ])


@query(
    "agg_pca_rotate",
    f"WITH {LP.replace('l_tax * 100 + 1 AS w', '1.0 AS w').replace('l_returnflag,', '1 AS l_returnflag,')}{WMOM}{EIG3} "
    "SELECT round(e1, 4) AS vx, round(e2, 4) AS vy, round(e3, 4) AS vz FROM eig",
)
def agg_pca_rotate(spark, sf):
    """Variances along the principal axes: after the rotation they are the eigenvalues."""
    out = agg.rotate_to_axes(_line_points(spark, sf), XYZ)
    return out.agg(*[rnd(F.var_pop(c), 4).alias(f"v{c}") for c in XYZ])


DIST = with_sql("cust", "supp") + ", d AS (SELECT c_custkey, MIN(sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy))) AS d FROM cust, supp GROUP BY c_custkey) "


_BACK = "b AS (SELECT s_suppkey, MIN(sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy))) AS d FROM cust, supp GROUP BY s_suppkey) "


def _distances(spark, sf):
    near = joins.nearest_within(B.customers(spark, sf), B.suppliers(spark, sf), "c_custkey", ["cx", "cy"], "s_suppkey", ["sx", "sy"], 0.0)
    return near.select("dist")


def _distances_back(spark, sf):
    near = joins.nearest_within(B.suppliers(spark, sf), B.customers(spark, sf), "s_suppkey", ["sx", "sy"], "c_custkey", ["cx", "cy"], 0.0)
    return near.select("dist")


@query(
    "agg_mesh_distance",
    DIST.rstrip() + ", " + _BACK + "SELECT *, greatest(max, back_max) AS hausdorff FROM "
    "(SELECT COUNT(*) AS n, round(MAX(d), 6) AS max, round(AVG(d), 6) AS mean, round(sqrt(AVG(d * d)), 6) AS rms FROM d), "
    "(SELECT COUNT(*) AS back_n, round(MAX(d), 6) AS back_max, round(AVG(d), 6) AS back_mean, round(sqrt(AVG(d * d)), 6) AS back_rms FROM b)",
)
def agg_mesh_distance(spark, sf):
    """Both ways between the two point sets."""
    out = agg.two_sided_distance(_distances(spark, sf), _distances_back(spark, sf), "dist")
    return out.select("n", "back_n", *[rnd(c).alias(c) for c in ("max", "mean", "rms", "back_max", "back_mean", "back_rms", "hausdorff")])


@query(
    "agg_mesh_distance_hist",
    DIST + ", c AS (SELECT CAST(trunc(d * 256 / 50) AS INTEGER) AS bin, COUNT(*) AS n FROM d GROUP BY 1) "
    "SELECT CAST(i AS INTEGER) AS bin, COALESCE(n, 0) AS n FROM range(0, 256) r(i) LEFT JOIN c ON c.bin = i",
)
def agg_mesh_distance_hist(spark, sf):
    return agg.histogram(_distances(spark, sf), "dist", 0.0, 50.0, 256).select("bin", "n")


@query(
    "agg_cell_rollup",
    "SELECT level, row, CAST(SUM(n) AS BIGINT) AS n, round(MAX(value), 4) AS top FROM (SELECT CAST(col % 7 AS BIGINT) AS level, row, n, value FROM "
    "(SELECT l_partkey % 64 AS col, l_suppkey % 64 AS row, COUNT(*) AS n, MAX(l_extendedprice) AS value FROM lineitem GROUP BY ALL)) GROUP BY ROLLUP (level, row)",
)
def agg_cell_rollup(spark, sf):
    cells = (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_partkey") % 64).alias("col"), (F.col("l_suppkey") % 64).alias("row"))
        .agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("value"))
        .withColumn("level", F.col("col") % 7)
    )
    return cells.rollup("level", "row").agg(F.sum("n").alias("n"), rnd(F.max("value"), 4).alias("top"))
