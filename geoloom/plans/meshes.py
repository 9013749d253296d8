"""Measures and rewrites of the survey mesh built from the orders."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.functions import geom as G
from geoloom.operators import mesh as M
from geoloom.operators import smooth as S
from geoloom.operators.filters import face_points
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table

MESH = with_sql("vert", "face")
TRI = with_sql("vert", "face", "tri")
TOPO = with_sql("vert", "face", "corner", "dedge", "uedge", "nbr", "bdy")
# label passing over nodes(id) and lnk(s, d); one label per node
REACH = (
    "reach(id, lab) USING KEY (id) AS (SELECT id, id AS lab FROM nodes UNION "
    "SELECT l.d AS id, MIN(r.lab) AS lab FROM reach r JOIN lnk l ON r.id = l.s JOIN recurring.reach o ON o.id = l.d "
    "WHERE r.lab < o.lab GROUP BY l.d) "
)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _mesh(spark, sf):
    return B.vertices(spark, sf), B.faces(spark, sf)


def _tri(spark, sf):
    v, f = _mesh(spark, sf)
    return face_points(f, v)


NX = "((by_ - ay) * (cz - az) - (bz - az) * (cy - ay))"
NY = "((bz - az) * (cx - ax) - (bx - ax) * (cz - az))"
NZ = "((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax))"
AREA = f"(sqrt({NX} * {NX} + {NY} * {NY} + {NZ} * {NZ}) / 2)"


@query("agg_surface_area", TRI + f"SELECT mesh_id, round(SUM({AREA}), 5) AS area FROM tri GROUP BY mesh_id")
def agg_surface_area(spark, sf):
    return M.face_measures(_tri(spark, sf)).groupBy("mesh_id").agg(rnd(F.sum("area"), 5).alias("area"))


@query(
    "agg_signed_volume",
    TRI + "SELECT mesh_id, round(SUM(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6, 5) + 0.0 AS volume FROM tri GROUP BY mesh_id",
)
def agg_signed_volume(spark, sf):
    return M.face_measures(_tri(spark, sf)).groupBy("mesh_id").agg(rnd(F.sum("volume"), 5).alias("volume"))


@query(
    "agg_mesh_centroid",
    TRI + f", m AS (SELECT mesh_id, {AREA} AS a, (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y, (az + bz + cz) / 3 AS z FROM tri), "
    "c AS (SELECT mesh_id, SUM(a) AS sa, SUM(a * x) / SUM(a) AS mx, SUM(a * y) / SUM(a) AS my, SUM(a * z) / SUM(a) AS mz FROM m GROUP BY mesh_id) "
    "SELECT c.mesh_id, round(mx, 5) AS mx, round(my, 5) AS my, round(mz, 5) AS mz, round(SUM(a * (x - mx) * (x - mx)) / sa, 5) AS cxx, "
    "round(SUM(a * (x - mx) * (y - my)) / sa, 5) + 0.0 AS cxy, round(SUM(a * (z - mz) * (z - mz)) / sa, 5) AS czz FROM m JOIN c ON c.mesh_id = m.mesh_id GROUP BY c.mesh_id, mx, my, mz, sa",
)
def agg_mesh_centroid(spark, sf):
    from geoloom.operators.aggregates import moments

    f = M.face_measures(_tri(spark, sf)).select("mesh_id", "area", F.col("mx").alias("x"), F.col("my").alias("y"), F.col("mz").alias("z"))
    out = moments(f, ["mesh_id"], ["x", "y", "z"], F.col("area"))
    return out.select("mesh_id", *[rnd(c, 5).alias(c) for c in ("mx", "my", "mz", "cxx", "cxy", "czz")])


@query(
    "agg_feature_size",
    TRI + ", e AS (SELECT pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2) AS l2 FROM tri UNION ALL "
    "SELECT pow(cx - bx, 2) + pow(cy - by_, 2) + pow(cz - bz, 2) FROM tri UNION ALL SELECT pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2) FROM tri) "
    "SELECT round(sqrt(median(l2)), 6) AS size FROM e",
)
def agg_feature_size(spark, sf):
    v, f = _mesh(spark, sf)
    return M.feature_size(f, v).select(rnd("size").alias("size"))


@query(
    "agg_mean_sq_edge",
    TOPO + "SELECT COUNT(*) AS n, round(AVG(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)), 6) AS mean FROM uedge JOIN vert p ON p.vid = uedge.a JOIN vert q ON q.vid = uedge.b",
)
def agg_mean_sq_edge(spark, sf):
    v, f = _mesh(spark, sf)
    return M.edge_lengths(f, v).agg(F.count("*").alias("n"), rnd(F.avg("l2")).alias("mean"))


@query(
    "agg_mesh_normals",
    TRI + f", s AS (SELECT v0, v1, v2, {NX} AS nx, {NY} AS ny, {NZ} AS nz, pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2) AS la, "
    "pow(cx - bx, 2) + pow(cy - by_, 2) + pow(cz - bz, 2) AS lb, pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2) AS lc FROM tri), "
    "w AS (SELECT v0 AS vid, nx / (la * lc) AS x, ny / (la * lc) AS y, nz / (la * lc) AS z FROM s UNION ALL SELECT v1, nx / (la * lb), ny / (la * lb), nz / (la * lb) FROM s "
    "UNION ALL SELECT v2, nx / (lb * lc), ny / (lb * lc), nz / (lb * lc) FROM s), "
    "t AS (SELECT vid, SUM(x) AS x, SUM(y) AS y, SUM(z) AS z FROM w GROUP BY vid) "
    "SELECT vid, round(x / sqrt(x*x + y*y + z*z), 6) + 0.0 AS nx, round(y / sqrt(x*x + y*y + z*z), 6) + 0.0 AS ny, round(z / sqrt(x*x + y*y + z*z), 6) + 0.0 AS nz FROM t",
)
def agg_mesh_normals(spark, sf):
    return M.vertex_normals(_tri(spark, sf)).select("vid", *[rnd(c).alias(c) for c in ("nx", "ny", "nz")])


# corner shares in the plane of the face: p at the origin, q at (d, 0), r at (u, v)
def _share(p: str, q: str, r: str) -> str:
    d2 = "+".join(f"pow({q}_{t} - {p}_{t}, 2)" for t in "xyz")
    along = "+".join(f"({q}_{t} - {p}_{t}) * ({r}_{t} - {p}_{t})" for t in "xyz")
    r2 = "+".join(f"pow({r}_{t} - {p}_{t}, 2)" for t in "xyz")
    flat = f"SELECT v0, v1, v2, sqrt({d2}) AS d, ({along}) / sqrt({d2}) AS u, sqrt({r2} - pow(({along}), 2) / ({d2})) AS v FROM flat"
    # the cell is the quadrilateral p, middle of pq, centre of the circle (d/2, h), middle of pr
    round_ = "(d * h / 4 + (d * v / 2 - h * u) / 4)"
    at_q, at_r = "d * d * v / (d - u) / 8", "(u*u + v*v) * v * d / (u*u + v*v - u * d) / 8"
    return (
        f"SELECT v{'abc'.index(p)} AS vid, CASE WHEN u <= 0 THEN d * v / 2 - {at_q} - {at_r} WHEN d - u <= 0 THEN d * d * v / u / 8 "
        f"WHEN u*u + v*v - u * d <= 0 THEN (u*u + v*v) * v / u / 8 ELSE {round_} END AS area "
        f"FROM (SELECT *, (u*u + v*v - d * u) / (2 * v) AS h FROM ({flat}))"
    )


@query(
    "agg_point_areas",
    TRI + ", flat AS (SELECT v0, v1, v2, ax AS a_x, ay AS a_y, az AS a_z, bx AS b_x, by_ AS b_y, bz AS b_z, cx AS c_x, cy AS c_y, cz AS c_z FROM tri), "
    f"w AS ({_share('a', 'b', 'c')} UNION ALL {_share('b', 'c', 'a')} UNION ALL {_share('c', 'a', 'b')}) "
    "SELECT vid, round(SUM(area), 6) + 0.0 AS area FROM w GROUP BY vid",
)
def agg_point_areas(spark, sf):
    return M.point_areas(_tri(spark, sf)).select("vid", rnd("area").alias("area"))


CLUSTER = (
    ", cl AS (SELECT *, floor(x / 2.5) AS i, floor(y / 2.5) AS j, floor(z / 2.5) AS k FROM vert), "
    "rep AS (SELECT mesh_id, i, j, k, MIN(vid) AS rep, COUNT(*) AS merged, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z, AVG(r) AS r FROM cl GROUP BY ALL), "
    "mp AS (SELECT vid, rep FROM cl JOIN rep USING (mesh_id, i, j, k)) "
)


@query(
    "agg_vertex_clustering",
    MESH + CLUSTER + "SELECT rep AS vid, mesh_id, merged, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(r, 6) AS r FROM rep",
)
def agg_vertex_clustering(spark, sf):
    v, f = _mesh(spark, sf)
    out, _ = M.cluster_vertices(v, f, 2.5, ["x", "y", "z", "r"], within=["mesh_id"])
    return out.select("vid", "mesh_id", "merged", *[rnd(c).alias(c) for c in ("x", "y", "z", "r")])


@query(
    "agg_cluster_faces",
    MESH + CLUSTER + ", nf AS (SELECT fid, a.rep AS v0, b.rep AS v1, c.rep AS v2 FROM face JOIN mp a ON a.vid = v0 JOIN mp b ON b.vid = v1 JOIN mp c ON c.vid = v2 "
    "WHERE a.rep <> b.rep AND b.rep <> c.rep AND c.rep <> a.rep) "
    "SELECT fid, v0, v1, v2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY list_sort([v0, v1, v2]) ORDER BY fid) AS rn FROM nf) WHERE rn = 1",
)
def agg_cluster_faces(spark, sf):
    v, f = _mesh(spark, sf)
    _, out = M.cluster_vertices(v, f, 2.5, ["x", "y", "z", "r"], within=["mesh_id"])
    return out.select("fid", "v0", "v1", "v2")


@query(
    "agg_mesh_report",
    recursive(TOPO)
    + ", rim AS (SELECT a, b, a // 500 AS mesh_id FROM uedge WHERE n = 1), nodes AS (SELECT a AS id FROM rim UNION SELECT b FROM rim), "
    "lnk AS (SELECT a AS s, b AS d FROM rim UNION ALL SELECT b, a FROM rim), " + REACH
    + ", lp AS (SELECT mesh_id, lab, COUNT(*) AS len FROM rim JOIN reach ON id = a GROUP BY ALL), "
    "l2 AS (SELECT mesh_id, MAX(len) AS longest_loop FROM lp GROUP BY mesh_id), "
    "e AS (SELECT a // 500 AS mesh_id, COUNT(*) AS n_edges, COUNT(*) FILTER (n = 1) AS n_border FROM uedge GROUP BY 1), "
    "v AS (SELECT mesh_id, COUNT(DISTINCT vid) AS n_vertices FROM corner GROUP BY mesh_id), f AS (SELECT mesh_id, COUNT(*) AS n_faces FROM face GROUP BY mesh_id) "
    "SELECT mesh_id, n_vertices, n_edges, n_faces, n_border, n_vertices - n_edges + n_faces AS euler, longest_loop FROM f JOIN e USING (mesh_id) JOIN v USING (mesh_id) JOIN l2 USING (mesh_id)",
)
def agg_mesh_report(spark, sf):
    return M.mesh_report(B.faces(spark, sf)).withColumn("longest_loop", F.col("longest_loop").cast("bigint"))


@query(
    "face_adjacency",
    TOPO + "SELECT e.fid, e.s, e.d, COALESCE(MIN(o.fid), -1) AS across FROM dedge e LEFT JOIN dedge o ON o.s = e.d AND o.d = e.s GROUP BY e.fid, e.s, e.d",
)
def face_adjacency(spark, sf):
    return M.face_adjacency(B.faces(spark, sf)).drop("k")


# rewrites


@query("mesh_union", MESH + "SELECT fid, mesh_id, v0, v1, v2 FROM face")
def mesh_union(spark, sf):
    v, f = _mesh(spark, sf)
    local_v = v.select("mesh_id", (F.col("vid") % 500).alias("local"), "x", "y", "z")
    local_f = f.select("fid", "mesh_id", *[(F.col(c) % 500).alias(c) for c in M.CORNERS])
    _, out = M.merge_meshes(local_v, local_f, "mesh_id", "local")
    return out.select("fid", "mesh_id", "v0", "v1", "v2")


@query(
    "mesh_unshare",
    with_sql("vert", "face", "corner") + ", n AS (SELECT fid, ROW_NUMBER() OVER (ORDER BY fid) - 1 AS f FROM face) "
    "SELECT 3 * f + k AS vid, x, y, z FROM corner c JOIN n ON n.fid = c.fid JOIN vert v ON v.vid = c.vid",
)
def mesh_unshare(spark, sf):
    v, f = _mesh(spark, sf)
    return M.unshare(f, v)[0].select("vid", "x", "y", "z")


@query(
    "dedup_vertices",
    with_sql("vert", "face", "corner") + ", n AS (SELECT fid, ROW_NUMBER() OVER (ORDER BY fid) - 1 AS f FROM face), "
    "m AS (SELECT c.vid, MIN(3 * f + k) AS rep FROM corner c JOIN n ON n.fid = c.fid GROUP BY c.vid) "
    "SELECT fid, a.rep AS v0, b.rep AS v1, c.rep AS v2 FROM face JOIN m a ON a.vid = v0 JOIN m b ON b.vid = v1 JOIN m c ON c.vid = v2",
)
def dedup_vertices(spark, sf):
    v, f = _mesh(spark, sf)
    uv, uf = M.unshare(f, v)
    return M.dedup_vertices(uv, uf, ["mesh_id", "x", "y", "z"])[1].select("fid", "v0", "v1", "v2")


@query(
    "merge_close_vertices",
    recursive(MESH)
    + ", w AS (SELECT vid, x + 40 * mesh_id AS x, y, z FROM vert), "
    "near AS (SELECT p.vid AS a, q.vid AS b FROM w p JOIN w q ON p.vid < q.vid AND q.vid - p.vid <= 20 "
    "AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= 1.01 * 1.01), "
    "nodes AS (SELECT vid AS id FROM vert), lnk AS (SELECT a AS s, b AS d FROM near UNION ALL SELECT b, a FROM near), " + REACH
    + "SELECT fid, a.lab AS v0, b.lab AS v1, c.lab AS v2 FROM face JOIN reach a ON a.id = v0 JOIN reach b ON b.id = v1 JOIN reach c ON c.id = v2 "
    "WHERE a.lab <> b.lab AND b.lab <> c.lab AND c.lab <> a.lab",
)
def merge_close_vertices(spark, sf):
    v, f = _mesh(spark, sf)
    world = v.withColumn("x", F.col("x") + F.col("mesh_id") * 40)
    return M.merge_close(world, f, 1.01)[1].select("fid", "v0", "v1", "v2")


@query(
    "dedup_faces",
    MESH + "SELECT fid, v0, v1, v2 FROM face",
)
def dedup_faces(spark, sf):
    f = B.faces(spark, sf)
    again = f.where("fid % 5 = 0").select((F.col("fid") + 1000000000).alias("fid"), "mesh_id", F.col("v1").alias("v0"), F.col("v2").alias("v1"), F.col("v0").alias("v2"))
    return M.dedup_faces(f.unionByName(again)).select("fid", "v0", "v1", "v2")


# flattened sheet: x is halved to whole numbers, so some faces lose their area
@query(
    "drop_degenerate_faces",
    MESH.replace("CAST((o_orderkey % 500) % 20 AS DOUBLE) AS x", "CAST((o_orderkey % 500) % 20 // 2 AS DOUBLE) AS x")
    .replace("/ 4 AS z", "* 0 AS z")
    .replace("x < 19", "vid % 500 % 20 < 19")
    + ", t AS (SELECT f.fid, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS ar FROM face f JOIN vert a ON a.vid = v0 JOIN vert b ON b.vid = v1 JOIN vert c ON c.vid = v2) "
    "SELECT fid FROM t WHERE ar <> 0",
)
def drop_degenerate_faces(spark, sf):
    v, f = _mesh(spark, sf)
    flat = v.withColumn("x", F.floor(F.col("x") / 2).cast("double")).withColumn("z", F.lit(0.0))
    return M.drop_degenerate(f, flat).select("fid")


@query("drop_unreferenced", with_sql("vert", "face", "corner") + "SELECT vid, x, y, z FROM vert WHERE vid IN (SELECT vid FROM corner)")
def drop_unreferenced(spark, sf):
    v, f = _mesh(spark, sf)
    return M.drop_unreferenced(v, f).select("vid", "x", "y", "z")


@query(
    "drop_listed",
    "WITH o AS (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders) "
    "SELECT o_orderkey, o_totalprice FROM o WHERE place NOT IN (SELECT l_partkey * 11 FROM lineitem)",
)
def drop_listed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    bad = table(spark, sf, "lineitem").select((F.col("l_partkey") * 11).alias("i"))
    return M.drop_listed(o, ["o_totalprice", "o_orderkey"], bad, "i")


LENS = (
    ", el AS (SELECT sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS len FROM uedge JOIN vert p ON p.vid = uedge.a JOIN vert q ON q.vid = uedge.b), "
    "sd AS (SELECT f.fid, greatest(pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2), pow(c.x - b.x, 2) + pow(c.y - b.y, 2) + pow(c.z - b.z, 2), "
    "pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2)) AS l2 FROM face f JOIN vert a ON a.vid = v0 JOIN vert b ON b.vid = v1 JOIN vert c ON c.vid = v2) "
)


@query("drop_long_edges", TOPO + LENS + "SELECT fid FROM sd WHERE sqrt(l2) <= (SELECT quantile_cont(len, 0.9) FROM el)")
def drop_long_edges(spark, sf):
    v, f = _mesh(spark, sf)
    return M.drop_long_edges(f, v, quantile=0.9).select("fid")


# steep sheet: z cubed, columns pressed together
@query(
    "drop_slivers",
    MESH + ", w AS (SELECT vid, x / 10 AS x, y, z * z * z AS z FROM vert), "
    "s AS (SELECT f.fid, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + pow(b.z - a.z, 2) AS p, pow(c.x - b.x, 2) + pow(c.y - b.y, 2) + pow(c.z - b.z, 2) AS q, "
    "pow(a.x - c.x, 2) + pow(a.y - c.y, 2) + pow(a.z - c.z, 2) AS r FROM face f JOIN w a ON a.vid = v0 JOIN w b ON b.vid = v1 JOIN w c ON c.vid = v2), "
    "fs AS (SELECT median(l) AS m FROM (SELECT p AS l FROM s UNION ALL SELECT q FROM s UNION ALL SELECT r FROM s)) "
    "SELECT fid FROM s, fs WHERE NOT (greatest(p, q, r) >= m * 16 AND pow(p + q + r - 2 * least(p, q, r), 2) * least(p, q, r) / (4 * p * q * r) >= 0.85)",
)
def drop_slivers(spark, sf):
    v, f = _mesh(spark, sf)
    steep = v.withColumn("x", F.col("x") / 10).withColumn("z", F.col("z") * F.col("z") * F.col("z"))
    return M.drop_slivers(f, steep).select("fid")


COMP = (
    ", nodes AS (SELECT DISTINCT vid AS id FROM corner), lnk AS (SELECT vid AS s, nb AS d FROM nbr), " + REACH
)


@query(
    "drop_small_components",
    recursive(TOPO) + COMP + ", d AS (SELECT lab, sqrt(pow(MAX(x) - MIN(x), 2) + pow(MAX(y) - MIN(y), 2) + pow(MAX(z) - MIN(z), 2)) AS diag FROM reach JOIN vert ON vid = id GROUP BY lab), "
    "w AS (SELECT sqrt(pow(MAX(x) - MIN(x), 2) + pow(MAX(y) - MIN(y), 2) + pow(MAX(z) - MIN(z), 2)) AS diag FROM reach JOIN vert ON vid = id) "
    "SELECT fid FROM face JOIN reach ON id = v0 JOIN d ON d.lab = reach.lab, w WHERE d.diag >= w.diag * 0.4",
)
def drop_small_components(spark, sf):
    v, f = _mesh(spark, sf)
    return M.drop_small_components(v, f, share=0.4)[1].select("fid")


@query(
    "erode_boundary",
    TOPO + "SELECT fid, v0, v1, v2 FROM face WHERE v0 NOT IN (SELECT vid FROM bdy) AND v1 NOT IN (SELECT vid FROM bdy) AND v2 NOT IN (SELECT vid FROM bdy)",
)
def erode_boundary(spark, sf):
    v, f = _mesh(spark, sf)
    return M.erode(v, f)[1].select("fid", "v0", "v1", "v2")


@query("flip_faces", MESH + "SELECT fid, v2 AS v0, v1, v0 AS v2 FROM face")
def flip_faces(spark, sf):
    return M.flip(B.faces(spark, sf)).select("fid", "v0", "v1", "v2")


# texture charts: faces of even and odd id use different places of the texture
@query(
    "split_attribute_seam",
    with_sql("vert", "face", "corner") + ", uv AS (SELECT c.fid, k, c.vid, c.fid % 2 + x / 20 AS u, y / 25 AS v FROM corner c JOIN vert ON vert.vid = c.vid), "
    "n AS (SELECT vid, u, v, ROW_NUMBER() OVER (ORDER BY vid, u, v) - 1 AS new_vid FROM (SELECT DISTINCT vid, u, v FROM uv)) "
    "SELECT fid, CAST(k AS INTEGER) AS k, new_vid FROM uv JOIN n ON n.vid = uv.vid AND n.u = uv.u AND n.v = uv.v",
)
def split_attribute_seam(spark, sf):
    v, f = _mesh(spark, sf)
    c = M.corners(f).join(v.select("vid", "x", "y"), "vid")
    c = c.select("fid", "k", "vid", (F.col("fid") % 2 + F.col("x") / 20).alias("u"), (F.col("y") / 25).alias("v"))
    return M.split_seam(c, ["u", "v"]).select("fid", "k", "new_vid")


@query(
    "mesh_transform",
    with_sql("pts") + ", r AS (SELECT *, cos(0.5) * x - sin(0.5) * y AS rx, sin(0.5) * x + cos(0.5) * y AS ry FROM pts) "
    "SELECT l_orderkey, l_linenumber, l_partkey, round(2 * rx + 0.5 * z + 10, 5) + 0.0 AS x, round(ry * 1.5 - 20, 5) + 0.0 AS y, round(z * 0.5 + 3, 5) + 0.0 AS z FROM r",
)
def mesh_transform(spark, sf):
    p = G.rotate(G.cols("x", "y", "z"), "z", 0.5)
    p = G.transform(p, [2, 0, 0.5, 10, 0, 1.5, 0, -20, 0, 0, 0.5, 3, 0, 0, 0, 1])
    return B.points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *[rnd(v, 5).alias(n) for v, n in zip(p, "xyz")])


@query(
    "face_normals_flat",
    TRI + f", n AS (SELECT *, {NX} AS nx, {NY} AS ny, {NZ} AS nz, 2 * {AREA} AS l FROM tri), "
    "c AS (SELECT fid, v0 AS vid, ax AS x, ay AS y, az AS z, nx, ny, nz, l FROM n UNION ALL SELECT fid, v1, bx, by_, bz, nx, ny, nz, l FROM n UNION ALL SELECT fid, v2, cx, cy, cz, nx, ny, nz, l FROM n) "
    "SELECT fid, vid, x, y, z, round(nx / l, 6) + 0.0 AS nx, round(ny / l, 6) + 0.0 AS ny, round(nz / l, 6) + 0.0 AS nz FROM c",
)
def face_normals_flat(spark, sf):
    return M.flat_normals(_tri(spark, sf)).select("fid", "vid", "x", "y", "z", *[rnd(c).alias(c) for c in ("nx", "ny", "nz")])


@query(
    "split_crease",
    recursive(with_sql("vert", "face", "tri", "corner", "dedge"))
    + f", nm AS (SELECT fid, {NX} / (2 * {AREA}) AS nx, {NY} / (2 * {AREA}) AS ny, {NZ} / (2 * {AREA}) AS nz FROM tri), "
    "adj AS (SELECT e.fid AS f, MIN(o.fid) AS g, e.s, e.d FROM dedge e JOIN dedge o ON o.s = e.d AND o.d = e.s GROUP BY e.fid, e.s, e.d), "
    f"sm AS (SELECT f, g, s, d FROM adj JOIN nm p ON p.fid = f JOIN nm q ON q.fid = g WHERE f < g AND p.nx * q.nx + p.ny * q.ny + p.nz * q.nz >= {math.cos(1.0)!r}), "
    "ends AS (SELECT f, g, s AS vid FROM sm UNION ALL SELECT f, g, d FROM sm), "
    "cn AS (SELECT fid, k, vid, 3 * fid + k AS id FROM corner), nodes AS (SELECT id FROM cn), "
    "lk AS (SELECT a.id AS s, b.id AS d FROM ends JOIN cn a ON a.fid = f AND a.vid = ends.vid JOIN cn b ON b.fid = g AND b.vid = ends.vid), "
    "lnk AS (SELECT s, d FROM lk UNION ALL SELECT d, s FROM lk), " + REACH
    + "SELECT fid, CAST(k AS INTEGER) AS k, lab AS part FROM cn JOIN reach ON reach.id = cn.id",
)
def split_crease(spark, sf):
    v, f = _mesh(spark, sf)
    return M.split_crease(f, v, math.cos(1.0)).select("fid", "k", "part")


# smoothing


def _step(src: str, dst: str, w: float, fixed: bool) -> str:
    skip = "WHERE n.vid NOT IN (SELECT vid FROM bdy) " if fixed else ""
    return (
        f"{dst}m AS (SELECT n.vid, AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz FROM nbr n JOIN {src} p ON p.vid = n.nb {skip}GROUP BY n.vid), "
        f"{dst} AS (SELECT p.vid, x + COALESCE(mx - x, 0) * {w} AS x, y + COALESCE(my - y, 0) * {w} AS y, z + COALESCE(mz - z, 0) * {w} AS z FROM {src} p LEFT JOIN {dst}m m ON m.vid = p.vid)"
    )


# eleven digits: means of small groups have short decimals, which must not fall on a rounding edge
OUT = "SELECT vid, round(x, 11) + 0.0 AS x, round(y, 11) + 0.0 AS y, round(z, 11) + 0.0 AS z FROM "


@query(
    "mesh_smooth_taubin",
    TOPO + ", " + ", ".join([_step("vert", "s1", 0.33, True), _step("s1", "s2", -0.331, True), _step("s2", "s3", 0.33, True), _step("s3", "s4", -0.331, True)]) + OUT.replace("11", "6") + "s4",
)
def mesh_smooth_taubin(spark, sf):
    v, f = _mesh(spark, sf)
    out = S.smooth(v.select("vid", "x", "y", "z"), f, S.TAUBIN, 2)
    return out.select("vid", *[rnd(c).alias(c) for c in "xyz"])


@query(
    "mesh_smooth_laplace",
    TOPO + ", " + ", ".join([_step("vert", "s1", 1.0, False), _step("s1", "s2", 1.0, False), _step("s2", "s3", 1.0, False)]) + OUT + "s3",
)
def mesh_smooth_laplace(spark, sf):
    v, f = _mesh(spark, sf)
    out = S.smooth(v.select("vid", "x", "y", "z"), f, (1.0,), 3, fix_border=False)
    return out.select("vid", *[rnd(c, 11).alias(c) for c in "xyz"])


DIFF = (
    TOPO + ", ring AS (SELECT vid, nb FROM nbr UNION ALL SELECT vid, vid FROM vert), "
    "p AS (SELECT a.vid, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / (2 * 1.5 * 1.5)) AS w, abs(a.z - b.z) AS dz, b.x, b.y, b.z FROM ring JOIN vert a ON a.vid = ring.vid JOIN vert b ON b.vid = nb) "
)


@query("mesh_diffuse", DIFF + "SELECT vid, round(SUM(w * x) / SUM(w), 6) + 0.0 AS x, round(SUM(w * y) / SUM(w), 6) + 0.0 AS y, round(SUM(w * z) / SUM(w), 6) + 0.0 AS z FROM p GROUP BY vid")
def mesh_diffuse(spark, sf):
    v, f = _mesh(spark, sf)
    return S.diffuse(v.select("vid", "x", "y", "z"), f, ["x", "y", "z"], 1.5).select("vid", *[rnd(c).alias(c) for c in "xyz"])


@query(
    "mesh_diffuse_bilateral",
    DIFF + "SELECT vid, round(SUM(w * exp(-dz * dz / (2 * 0.8 * 0.8)) * z) / SUM(w * exp(-dz * dz / (2 * 0.8 * 0.8))), 6) + 0.0 AS z FROM p GROUP BY vid",
)
def mesh_diffuse_bilateral(spark, sf):
    v, f = _mesh(spark, sf)
    return S.diffuse(v.select("vid", "x", "y", "z"), f, ["z"], 1.5, 0.8).select("vid", rnd("z").alias("z"))


@query(
    "mesh_orient",
    recursive(TOPO) + ", nodes AS (SELECT fid AS id FROM face), "
    "lnk AS (SELECT DISTINCT e.fid AS s, o.fid AS d FROM dedge e JOIN dedge o ON o.s = e.d AND o.d = e.s), " + REACH
    + "SELECT fid, CASE WHEN lab % 3 = 0 THEN v2 ELSE v0 END AS v0, v1, CASE WHEN lab % 3 = 0 THEN v0 ELSE v2 END AS v2 FROM face JOIN reach ON id = fid",
)
def mesh_orient(spark, sf):
    """Faces with an id divisible by 3 come in flipped; the lowest face of a component leads."""
    f = B.faces(spark, sf)
    mixed = f.where("fid % 3 <> 0").unionByName(M.flip(f.where("fid % 3 = 0")))
    return M.orient(mixed).select("fid", "v0", "v1", "v2")


PIXG = with_sql("pix").replace("AVG(l_extendedprice) AS value", "MAX(l_extendedprice) / 50000 AS value")


@query(
    "mesh_grid_triangulate",
    PIXG + ", g AS (SELECT col, row, row * 64 + col AS vid, value AS z FROM pix WHERE n % 7 <> 0), "
    "q AS (SELECT c AS qc, r AS qr, a.vid AS ll, a.z AS zll, b.vid AS lr, b.z AS zlr, d.vid AS ul, d.z AS zul, e.vid AS ur, e.z AS zur "
    "FROM range(0, 63) x(c), range(0, 63) y(r) LEFT JOIN g a ON a.col = c AND a.row = r LEFT JOIN g b ON b.col = c + 1 AND b.row = r "
    "LEFT JOIN g d ON d.col = c AND d.row = r + 1 LEFT JOIN g e ON e.col = c + 1 AND e.row = r + 1), "
    "h AS (SELECT *, (ll IS NULL)::INT + (lr IS NULL)::INT + (ul IS NULL)::INT + (ur IS NULL)::INT AS miss, 2 + pow(zll - zur, 2) < 2 + pow(zlr - zul, 2) AS along FROM q) "
    "SELECT ll AS v0, lr AS v1, CASE WHEN along THEN ur ELSE ul END AS v2 FROM h WHERE miss = 0 UNION ALL "
    "SELECT CASE WHEN along THEN ll ELSE lr END, ur, ul FROM h WHERE miss = 0 UNION ALL "
    "SELECT COALESCE(ll, lr), CASE WHEN ll IS NULL OR lr IS NULL THEN ur ELSE lr END, CASE WHEN ul IS NULL THEN ur ELSE ul END FROM h WHERE miss = 1",
)
def mesh_grid_triangulate(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy((F.col("l_partkey") % 64).alias("col"), (F.col("l_suppkey") % 64).alias("row")).agg(
        F.count("*").alias("n"), (F.max("l_extendedprice") / 50000).alias("z")
    )
    g = g.withColumn("vid", F.when(F.col("n") % 7 != 0, F.col("row") * 64 + F.col("col")))
    return M.triangulate_grid(g, "col", "row", "vid", ["col", "row", "z"]).select("v0", "v1", "v2")
