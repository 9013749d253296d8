"""Text sources and sinks: lines are written from the given tables, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geoloom.operators import mesh as M
from geoloom.operators import tiles as T
from geoloom.operators.filters import face_points
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table
from geoloom.session import checkpoint_root, with_scalars
from geoloom.sources import sinks, text


def _place(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark, name: str, df, *cols) -> str:
    path = _place(spark, name)
    df.select(text.line(*cols).alias("value")).write.text(path)
    return path


def _spoil(spark, path: str, df, *lines) -> None:
    """Add bad lines to a written file: each of ``lines`` once per row."""
    df.select(F.explode(F.array(*lines)).alias("value")).write.mode("append").text(path)


def _counted(good, bad):
    return with_scalars(good, bad.agg(F.count("*").alias("n_bad")))


@query(
    "src_scene_boxes",
    "SELECT s_suppkey AS id, s_name AS file, CAST(s_suppkey % 47 AS DOUBLE) AS xmin, s_acctbal AS ymin, CAST(s_nationkey AS DOUBLE) AS zmin, "
    "CAST(s_suppkey % 47 + 3 AS DOUBLE) AS xmax, s_acctbal + 2.5 AS ymax, CAST(s_nationkey + 1 AS DOUBLE) AS zmax, CAST(s_suppkey AS DOUBLE) AS m3, 16 AS n_matrix, (SELECT 2 * COUNT(*) FROM supplier WHERE s_suppkey % 3 = 0) AS n_bad FROM supplier",
)
def src_scene_boxes(spark, sf):
    s = table(spark, sf, "supplier")
    k, b, n = F.col("s_suppkey"), F.col("s_acctbal"), F.col("s_nationkey")
    matrix = [k if i == 3 else F.lit(1 if i % 5 == 0 else 0) for i in range(16)]
    path = _lines(spark, "scene", s, k, F.col("s_name"), k % 47, b, n, k % 47 + 3, b + 2.5, n + 1, *matrix)
    short, odd = F.concat(F.lit("9 f "), k.cast("string")), F.concat(F.lit("x" + " 1" * 23), k.cast("string"))
    _spoil(spark, path, s.where(k % 3 == 0), short, odd)
    out = _counted(*text.read_scene_boxes(spark, path))
    return out.select("n_bad", "id", "file", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax", F.col("m")[3].alias("m3"), F.size("m").alias("n_matrix"))


@query(
    "src_mosaic_cells",
    with_sql("pix") + "SELECT CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row, CAST(col * 10 AS DOUBLE) AS xmin, CAST(col * 10 + 10 AS DOUBLE) AS xmax, CAST(row * 5 AS DOUBLE) AS ymin, "
    "printf('r%04d_c%04d', row, col) AS file, 64 AS cols, 64 AS rows, (SELECT COUNT(*) FROM pix WHERE n = 13) AS n_bad FROM pix WHERE n >= 10 AND n <> 13",
)
def src_mosaic_cells(spark, sf):
    c, r, n = F.col("col"), F.col("row"), F.col("n")
    name = F.when(n >= 10, F.format_string("r%04d_c%04d", r, c)).otherwise("null")
    cells = B.pixels(spark, sf).select(
        F.concat_ws(" ", *[v.cast("string") for v in (c * 10, c * 10 + 10, r * 5, r * 5 + 5, F.lit(0), n, c, r)], F.when(n != 13, name)).alias("value")
    )
    cells = cells.select("value", F.pmod(F.hash("value"), F.lit(4)).alias("f"), F.lit(1).alias("o"))
    head = spark.range(4).select(F.lit("0 640 0 320 0 99 64 64 total").alias("value"), F.col("id").cast("int").alias("f"), F.lit(0).alias("o"))
    path = _place(spark, "mosaic")
    # several manifests: in each the first line has a meaning
    head.unionByName(cells).repartition("f").sortWithinPartitions("f", "o").drop("o").write.partitionBy("f").text(path)
    good, extent, bad = text.read_mosaic_cells(spark, path)
    grid = extent.agg(F.max("cols").alias("cols"), F.max("rows").alias("rows"))
    out = with_scalars(with_scalars(good, grid), bad.agg(F.count("*").alias("n_bad")))
    return out.select("col", "row", "xmin", "xmax", "ymin", "file", "cols", "rows", "n_bad")


@query(
    "src_poses",
    with_sql("ev") + "SELECT event_id AS pose_id, s AS pose_time, value AS x, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 101 AS DOUBLE) END AS y, (SELECT 2 * COUNT(*) FROM ev WHERE event_id % 50 = 0) AS n_bad, 'L' || event_id || '.png' AS left_image, "
    "CAST(1 + user_id % 5 AS DOUBLE) AS footprint, event_type = 'click' AS overlap, -31.8125 AS origin_latitude, 115.5 AS origin_longitude FROM ev".replace(
        "-31.8125 AS", "CAST(-31.8125 AS DOUBLE) AS"
    ).replace("115.5 AS", "CAST(115.5 AS DOUBLE) AS"),
)
def src_poses(spark, sf):
    e = F.col("event_id")
    poses = B.events(spark, sf).select(
        e.alias("pose_id"),
        F.col("s").alias("pose_time"),
        F.lit(-31.8).alias("latitude"),
        F.lit(115.4).alias("longitude"),
        F.col("value").alias("x"),
        F.when(e % 7 != 0, (e % 101).cast("double")).alias("y"),
        *[F.lit(0.0).alias(n) for n in ("z", "phi", "theta", "psi")],
        F.concat(F.lit("L"), e.cast("string"), F.lit(".png")).alias("left_image"),
        F.concat(F.lit("R"), e.cast("string"), F.lit(".png")).alias("right_image"),
        F.lit(2.0).alias("altitude"),
        (1 + F.col("user_id") % 5).cast("double").alias("footprint"),
        (F.col("event_type") == "click").cast("int").alias("overlap"),
    )
    path = _place(spark, "poses")
    text.write_poses(poses, (-31.8125, 115.5), path)
    _spoil(spark, path, B.events(spark, sf).where(e % 50 == 0), F.concat(e.cast("string"), F.lit(" 1.5 2.5")), F.lit("ORIGIN_LATITUDE none"))
    out = _counted(*text.read_poses(spark, path))
    return out.select(
        "n_bad",
        "pose_id",
        "pose_time",
        F.col("pose")[0].alias("x"),
        F.col("pose")[1].alias("y"),
        "left_image",
        "footprint",
        "overlap",
        "origin_latitude",
        "origin_longitude",
    )


@query(
    "src_patches",
    "SELECT *, (SELECT 2 * COUNT(*) FROM part WHERE p_partkey % 4 = 0) AS n_bad FROM (SELECT p_partkey AS patch_id, CAST(unnest([p_partkey % 7, p_partkey % 11 + 7, p_partkey % 13 + 20]) AS INTEGER) AS image, FALSE AS weak FROM part "
    "UNION ALL SELECT p_partkey, CAST(p_partkey % 5 + 40 AS INTEGER), TRUE FROM part WHERE p_partkey % 3 <> 0)",
)
def src_patches(spark, sf):
    k = F.col("p_partkey")
    lines = table(spark, sf, "part").select(
        F.concat_ws(
            ";",
            k.cast("string"),
            F.concat_ws(",", *[v.cast("string") for v in (k % 7, k % 11 + 7, k % 13 + 20)]),
            F.when(k % 3 != 0, (k % 5 + 40).cast("string")).otherwise(""),
        ).alias("value")
    )
    path = _place(spark, "patches")
    lines.write.text(path)
    _spoil(spark, path, table(spark, sf, "part").where(k % 4 == 0), F.concat(k.cast("string"), F.lit(";1,two;3")), F.concat(k.cast("string"), F.lit(";1")))
    p, bad = text.read_patches(spark, path)
    strong = text.patch_images(p).withColumn("weak", F.lit(False))
    return _counted(strong.unionByName(text.patch_images(p, weak=True).withColumn("weak", F.lit(True))), bad)


@query(
    "src_mesh_bounds",
    "SELECT l_returnflag || l_linestatus AS name, MIN(l_quantity) AS minx, MAX(l_quantity + 1.5) AS maxx, MIN(l_extendedprice) AS miny, MAX(l_extendedprice + 1) AS maxy, "
    "MIN(l_discount) AS minz, MAX(l_discount + 0.25) AS maxz, (SELECT 2 * COUNT(*) FROM lineitem WHERE l_orderkey % 100 = 0) AS n_bad FROM lineitem GROUP BY ROLLUP (l_returnflag || l_linestatus)",
)
def src_mesh_bounds(spark, sf):
    li = table(spark, sf, "lineitem")
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    path = _lines(spark, "bounds", li, F.concat("l_returnflag", "l_linestatus"), q, p, d, q + 1.5, p + 1, d + 0.25)
    _spoil(spark, path, li.where("l_orderkey % 100 = 0"), F.lit("short 1 2 3"), F.lit("odd 1 2 3 4 5 six"))
    return _counted(*text.read_mesh_bounds(spark, path))


@query(
    "src_tracks",
    "WITH v AS (SELECT p_partkey AS point_id, CAST((p_partkey * (i + 1)) % 60 AS INTEGER) AS cam, CAST(i AS INTEGER) AS key, p_size * 1.0 + i AS x, p_retailprice AS y FROM part, range(0, 3) r(i) WHERE i <= p_partkey % 3) "
    "SELECT point_id, cam, key, CAST(x AS DOUBLE) AS x, y, (SELECT COUNT(*) FROM v WHERE cam >= 50) AS n_rejected, (SELECT 2 * COUNT(*) FROM part WHERE p_partkey % 9 = 0) AS n_bad FROM v WHERE cam < 50",
)
def src_tracks(spark, sf):
    k = F.col("p_partkey")
    views = F.transform(
        F.sequence(F.lit(0), (k % 3).cast("int")),
        lambda i: F.struct(
            ((k * (i + 1)) % 60).cast("int").alias("cam"), i.alias("key"), (F.col("p_size") + i).cast("double").alias("x"), F.col("p_retailprice").alias("y")
        ),
    )
    path = _place(spark, "tracks")
    table(spark, sf, "part").select(F.to_json(F.struct(k.alias("point"), views.alias("views"))).alias("value")).write.text(path)
    _spoil(spark, path, table(spark, sf, "part").where(k % 9 == 0), F.lit('{"point": 7, "views": [{"cam"'), F.lit('{"point": "seven", "views": 3}'))
    good, rejected, bad = text.read_tracks(spark, path, 50)
    out = with_scalars(_counted(good, bad), rejected.agg(F.count("*").alias("n_rejected")))
    return out.select("point_id", "cam", "key", "x", "y", "n_rejected", "n_bad")


@query(
    "src_visibility_pairs",
    "SELECT vec_id, CAST(i AS INTEGER) AS cam FROM embeddings, range(0, 64) r(i) WHERE CAST(embedding[i + 1] AS DOUBLE) > 0.2",
)
def src_visibility_pairs(spark, sf):
    mask = F.transform("embedding", lambda v: (v.cast("double") > 0.2).cast("int"))
    return text.visibility_pairs(table(spark, sf, "embeddings"), "vec_id", mask)


@query(
    "src_raster_vertices",
    with_sql("pix") + "SELECT row * 64 + col AS vid, round(-50 + col * 100.0 / 63, 6) + 0.0 AS x, round(-100 + row * 200.0 / 63, 6) + 0.0 AS y, "
    "round(CASE WHEN n = 15 THEN NULL ELSE n * (100.0 / 64 / 0.5) END, 6) AS z, round(col / 64.0, 6) AS u, round(1 - row / 64.0, 6) AS v FROM pix",
)
def src_raster_vertices(spark, sf):
    p = B.pixels(spark, sf).select("col", "row", F.col("n").cast("double").alias("value"))
    out = T.raster_vertices(p, 64, 64, 0.5, -1.0, nodata=15.0)
    return out.select("vid", *[rnd(c).alias(c) for c in ("x", "y", "z", "u", "v")])


@query(
    "sink_oriented_points",
    with_sql("vert", "face", "corner") + "SELECT fid, CAST(k AS INTEGER) AS k, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, 6 AS n_floats FROM corner c JOIN vert ON vert.vid = c.vid",
)
def sink_oriented_points(spark, sf):
    v, f = B.vertices(spark, sf), B.faces(spark, sf)
    path = _place(spark, "oriented")
    sinks.write_oriented_points(f, v, M.vertex_normals(face_points(f, v)), path)
    back = spark.read.parquet(path)
    floats = sum(1 for x in back.schema if x.dataType.simpleString() == "float")
    unit = F.abs(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz") - 1) < 1e-5
    return back.where(unit).select("fid", "k", "x", "y", "z", F.lit(floats).alias("n_floats"))


@query("sink_mesh_merge_write", with_sql("vert", "face") + "SELECT fid, v0, v1, v2, mesh_id, st FROM face JOIN vert USING (mesh_id) WHERE vert.vid = v0")
def sink_mesh_merge_write(spark, sf):
    v, f = B.vertices(spark, sf), B.faces(spark, sf)
    path = _place(spark, "mesh")
    sinks.write_mesh(v, f, path)
    verts, faces = sinks.read_mesh(spark, path)
    own = verts.select(F.col("vid").alias("v0"), "st")
    return faces.join(own, "v0").select("fid", "v0", "v1", "v2", "mesh_id", "st")
