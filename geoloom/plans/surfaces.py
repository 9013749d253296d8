"""Surfaces of voxel tables, border loops and holes of meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geom as G
from geoloom.operators import loops as L
from geoloom.operators import regions as R
from geoloom.operators import simplify as P
from geoloom.operators import surface as S
from geoloom.operators.filters import face_points
from geoloom.operators.mesh import corner_vectors, corners, edge_lengths, edges
from geoloom.plans import bindings as B
from geoloom.plans.meshes import NX, NY, NZ, TOPO, TRI, recursive
from geoloom.plans.registry import query, rnd, table

# cells with eight voxels, their corners k (bits: axes) and values
CELLS = (
    "WITH v AS (SELECT l_partkey % 12 AS ix, l_suppkey % 10 AS iy, l_linenumber AS iz, avg(l_quantity) - 25.5 AS w FROM lineitem GROUP BY ALL), "
    "corner AS (SELECT ix - dx AS ix, iy - dy AS iy, iz - dz AS iz, dx + 2 * dy + 4 * dz AS k, w FROM v, range(2) a(dx), range(2) b(dy), range(2) c(dz)), "
    "cell AS (SELECT ix, iy, iz FROM corner GROUP BY ALL HAVING COUNT(*) = 8) "
)


def _voxels(spark, sf):
    """Mean quantity about its middle, by part, supplier and line."""
    keys = [(F.col("l_partkey") % 12).alias("ix"), (F.col("l_suppkey") % 10).alias("iy"), F.col("l_linenumber").alias("iz")]
    return table(spark, sf, "lineitem").groupBy(*keys).agg((F.avg("l_quantity") - 25.5).alias("w"))


@query(
    "surface_vertices",
    CELLS + ", e AS (SELECT DISTINCT ix + (a.k & 1) AS ix, iy + ((a.k >> 1) & 1) AS iy, iz + ((a.k >> 2) & 1) AS iz, b.k - a.k AS dir, -a.w / (b.w - a.w) AS t "
    "FROM cell JOIN corner a USING (ix, iy, iz) JOIN corner b USING (ix, iy, iz) WHERE (a.k & b.k) = a.k AND a.k < b.k AND (a.w < 0) <> (b.w < 0)) "
    "SELECT CAST((((ix + 262144) * 524288 + iy + 262144) * 524288 + iz + 262144) * 8 + dir AS BIGINT) AS vid, "
    "round(ix + t * (dir & 1), 6) AS x, round(iy + t * ((dir >> 1) & 1), 6) AS y, round(iz + t * ((dir >> 2) & 1), 6) AS z FROM e",
)
def surface_vertices(spark, sf):
    verts, _ = S.level_surface(_voxels(spark, sf), "w")
    return verts.select("vid", *[rnd(c).alias(c) for c in "xyz"])


@query(
    "surface_faces",
    CELLS + ", way(p, q) AS (VALUES (1, 3), (1, 5), (2, 3), (2, 6), (4, 5), (4, 6)), "
    "t AS (SELECT ix, iy, iz, COUNT(*) FILTER (WHERE c.w < 0) AS own FROM cell JOIN corner c USING (ix, iy, iz), way WHERE c.k IN (0, p, q, 7) GROUP BY ix, iy, iz, p, q), "
    "n AS (SELECT ix, iy, iz, SUM(CASE own WHEN 2 THEN 2 WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END) AS n FROM t GROUP BY ix, iy, iz) "
    "SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, CAST(iz AS BIGINT) AS iz, CAST(n AS BIGINT) AS n_faces FROM n WHERE n > 0",
)
def surface_faces(spark, sf):
    return S.triangles(_voxels(spark, sf), "w").groupBy("ix", "iy", "iz").agg(F.count("*").alias("n_faces"))


BORDER = "b AS (SELECT e.d AS s, e.s AS d FROM dedge e JOIN uedge u ON u.a = least(e.s, e.d) AND u.b = greatest(e.s, e.d) WHERE u.n = 1 AND u.a <> u.b)"


@query(
    "border_loops",
    recursive(
        TOPO + f", {BORDER}, o AS (SELECT s, d, row_number() OVER (PARTITION BY s ORDER BY d) AS k FROM b), i AS (SELECT s, d, row_number() OVER (PARTITION BY d ORDER BY s) AS k FROM b), "
        "nxt AS (SELECT i.s, i.d, o.s AS s2, o.d AS d2 FROM i JOIN o ON o.s = i.d AND o.k = i.k), "
        "w AS (SELECT s AS hs, d AS hd, s, d, 0 AS place FROM nxt UNION ALL SELECT hs, hd, n.s2, n.d2, place + 1 FROM w JOIN nxt n ON n.s = w.s AND n.d = w.d "
        "WHERE n.s2 > hs OR (n.s2 = hs AND n.d2 > hd)), "
        "heads AS (SELECT DISTINCT hs, hd FROM w JOIN nxt n ON n.s = w.s AND n.d = w.d WHERE n.s2 = hs AND n.d2 = hd) "
        "SELECT hs AS loop_s, hd AS loop_d, CAST(place AS BIGINT) AS place, s, d FROM w SEMI JOIN heads USING (hs, hd)"
    ),
)
def border_loops(spark, sf):
    return L.border_loops(B.faces(spark, sf))


# the area vector of what closes a loop does not depend on how it is closed
@query(
    "mesh_fill_holes",
    TOPO + f", {BORDER} SELECT CAST(p.vid // 500 AS BIGINT) AS mesh_id, round(SUM(p.y * q.z - p.z * q.y) / 2, 4) + 0.0 AS ax, round(SUM(p.z * q.x - p.x * q.z) / 2, 4) + 0.0 AS ay, "
    "round(SUM(p.x * q.y - p.y * q.x) / 2, 4) + 0.0 AS az, CAST(0 AS BIGINT) AS n_open FROM b JOIN vert p ON p.vid = b.s JOIN vert q ON q.vid = b.d GROUP BY 1",
)
def mesh_fill_holes(spark, sf):
    """Area vector of the added faces and the border edges that are left, by mesh."""
    faces, verts = B.faces(spark, sf), B.vertices(spark, sf).select("vid", "x", "y", "z")
    more, added = L.fill_holes(faces, verts)
    a, b, c = corner_vectors()
    area = G.cross(G.sub(b, a), G.sub(c, a))
    mesh = F.expr("v0 div 500").alias("mesh_id")
    total = face_points(added, verts.unionByName(more)).groupBy(mesh).agg(*[rnd(F.sum(v) / 2, 4).alias(f"a{x}") for x, v in zip("xyz", area)])
    whole = faces.select("fid", "v0", "v1", "v2").unionByName(added.withColumn("fid", F.lit(-1).cast("bigint")))
    left = L.border_edges(whole).groupBy(F.expr("greatest(s, d) div 500").alias("mesh_id")).agg(F.count("*").alias("n_open"))
    return total.join(left, "mesh_id", "left").select("mesh_id", "ax", "ay", "az", F.coalesce("n_open", F.lit(0).cast("bigint")).alias("n_open"))


# distance and seed as one number, so that the least of both is one minimum
@query(
    "mesh_seed_regions",
    recursive(
        TOPO + ", lnk AS (SELECT uedge.a AS s, uedge.b AS d, CAST(16 * (pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS BIGINT) AS w FROM uedge JOIN vert p ON p.vid = uedge.a JOIN vert q ON q.vid = uedge.b), "
        "way AS (SELECT s, d, w FROM lnk UNION ALL SELECT d, s, w FROM lnk), "
        "reach(id, lab) USING KEY (id) AS (SELECT vid AS id, vid AS lab FROM vert WHERE vid % 60 = 7 UNION "
        "SELECT l.d AS id, MIN(r.lab + l.w * 1000000000) AS lab FROM reach r JOIN way l ON r.id = l.s LEFT JOIN recurring.reach o ON o.id = l.d "
        "WHERE o.id IS NULL OR r.lab + l.w * 1000000000 < o.lab GROUP BY l.d) "
        "SELECT id, CAST(lab // 1000000000 AS BIGINT) AS dist, CAST(lab % 1000000000 AS BIGINT) AS seed FROM reach"
    ),
)
def mesh_seed_regions(spark, sf):
    """Squared edge lengths in sixteenths as weights, so that sums are whole."""
    verts = B.vertices(spark, sf).select("vid", "x", "y", "z")
    links = edge_lengths(B.faces(spark, sf), verts).select("a", "b", F.round(F.col("l2") * 16).cast("bigint").alias("w"))
    return R.seed_regions(links, verts.where("vid % 60 = 7"))


# the faces at each end, an edge at a time; a face at both ends counts twice
SIDES = (
    "side AS (SELECT fid, v0 AS s, v1 AS d FROM tri UNION ALL SELECT fid, v1, v2 FROM tri UNION ALL SELECT fid, v2, v0 FROM tri), "
    "e AS (SELECT least(s, d) AS a, greatest(s, d) AS b, COUNT(*) AS n FROM side GROUP BY ALL) "
)


@query(
    "mesh_quadric_errors",
    TRI + f", {SIDES}, pl AS (SELECT *, {NX} AS nx, {NY} AS ny, {NZ} AS nz FROM tri), "
    "cor AS (SELECT unnest([v0, v1, v2]) AS vid, ax, ay, az, nx, ny, nz, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM pl), "
    "m AS (SELECT e.a, e.b, (p.x + q.x) / 2 AS mx, (p.y + q.y) / 2 AS my, (p.z + q.z) / 2 AS mz FROM e JOIN vert p ON p.vid = e.a JOIN vert q ON q.vid = e.b), "
    "ends AS (SELECT *, unnest([a, b]) AS vid FROM m) "
    "SELECT a, b, round(SUM(pow((mx - ax) * nx + (my - ay) * ny + (mz - az) * nz, 2) / size / 2), 5) + 0.0 AS error FROM ends JOIN cor USING (vid) GROUP BY a, b",
)
def mesh_quadric_errors(spark, sf):
    """Quadric error of both ends' faces in the middle of each edge."""
    faces, verts = B.faces(spark, sf), B.vertices(spark, sf).select("vid", "x", "y", "z")
    known = verts.join(P.vertex_quadrics(faces, verts), "vid")
    whole = face_points(faces, verts).select("fid", "v0", "v1", "v2")
    e = edge_lengths(whole, verts).select("a", "b")
    for t in "ab":
        e = e.join(known.select(*[F.col(c).alias(t if c == "vid" else f"{t}_{c}") for c in known.columns]), t)
    middle = [(F.col(f"a_{c}") + F.col(f"b_{c}")) / 2 for c in "xyz"]
    error = P.quadric_error(middle, [F.col(f"a_{q}") + F.col(f"b_{q}") for q in P.Q])
    return e.select("a", "b", rnd(error, 5).alias("error"))


# collapses keep the border, and with it the area vector, and what is connected how; so the twin reads the mesh as it was
@query(
    "mesh_simplify",
    TRI + f", {SIDES}, k AS (SELECT a // 500 AS mesh_id, COUNT(*) AS ne, COUNT(*) FILTER (WHERE n = 1) AS n_border FROM e GROUP BY 1), "
    "u AS (SELECT vid // 500 AS mesh_id, COUNT(DISTINCT vid) AS nv FROM (SELECT unnest([v0, v1, v2]) AS vid FROM tri) GROUP BY 1), "
    f"f AS (SELECT mesh_id, COUNT(*) AS nf, SUM({NX}) / 2 AS ax, SUM({NY}) / 2 AS ay, SUM({NZ}) / 2 AS az FROM tri GROUP BY 1) "
    "SELECT CAST(f.mesh_id AS BIGINT) AS mesh_id, round(ax, 4) + 0.0 AS ax, round(ay, 4) + 0.0 AS ay, round(az, 4) + 0.0 AS az, CAST(nv - ne + nf AS BIGINT) AS euler, CAST(n_border AS BIGINT) AS n_border "
    "FROM f JOIN k USING (mesh_id) JOIN u USING (mesh_id)",
)
def mesh_simplify(spark, sf):
    """Area vector, Euler number and border edges by mesh of what is left at five sixths of the faces."""
    faces, verts = B.faces(spark, sf), B.vertices(spark, sf).select("vid", "x", "y", "z")
    few, less = P.simplify(faces, verts, faces.count() * 5 // 6)
    a, b, c = corner_vectors()
    area = G.cross(G.sub(b, a), G.sub(c, a))
    vectors = face_points(less, few).groupBy("mesh_id").agg(F.count("*").alias("nf"), *[rnd(F.sum(v) / 2, 4).alias(f"a{x}") for x, v in zip("xyz", area)])
    e = edges(less).groupBy(F.expr("a div 500").alias("mesh_id")).agg(F.count("*").alias("ne"), F.count_if(F.col("n") == 1).alias("n_border"))
    used = corners(less).select("vid").distinct().groupBy(F.expr("vid div 500").alias("mesh_id")).agg(F.count("*").alias("nv"))
    return vectors.join(e, "mesh_id").join(used, "mesh_id").select("mesh_id", "ax", "ay", "az", (F.col("nv") - F.col("ne") + F.col("nf")).alias("euler"), "n_border")
