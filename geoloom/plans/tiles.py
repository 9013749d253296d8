"""Raster and tile queries; pixels are (part, supplier) remainders."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import tiles as T
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table

PIX = with_sql("pix")


@query(
    "tile_assign",
    PIX + ", l AS (SELECT col, row, CAST(i AS INTEGER) AS level FROM pix, range(0, 3) r(i)) "
    "SELECT col, row, level, (col >> level) // 16 AS tx, (row >> level) // 16 AS ty, (col >> level) % 16 AS px, (row >> level) % 16 AS py FROM l",
)
def tile_assign(spark, sf):
    return T.tile_assign(B.pixels(spark, sf).select("col", "row"), 16, 3)


# the twin walks every place of every tile back to its source pixel
@query(
    "tile_border",
    PIX + ", p AS (SELECT tx, ty, px, py, tx * 16 + px - 2 AS x, ty * 16 + py - 2 AS y FROM range(0, 4) a(tx), range(0, 4) b(ty), range(0, 20) c(px), range(0, 20) d(py)), "
    "s AS (SELECT *, CASE WHEN x < 0 THEN x + 2 WHEN x >= 64 THEN x - 2 ELSE x END AS sx, CASE WHEN y < 0 THEN y + 2 WHEN y >= 64 THEN y - 2 ELSE y END AS sy FROM p) "
    "SELECT tx, ty, px, py, n FROM s JOIN pix ON col = sx AND row = sy",
)
def tile_border(spark, sf):
    return T.tile_border(B.pixels(spark, sf).select("col", "row", "n"), 64, 64, 16, 2)


LEVELS = (
    ", l0 AS (SELECT col, row, CAST(n AS DOUBLE) AS value FROM pix), "
    + ", ".join(f"l{i} AS (SELECT col // 2 AS col, row // 2 AS row, AVG(value) AS value FROM l{i - 1} GROUP BY ALL)" for i in (1, 2, 3))
    + " "
)


@query(
    "tile_pyramid",
    PIX + LEVELS + " UNION ALL ".join(f"SELECT {i} AS level, col, row, round(value, 6) AS value FROM l{i}" for i in range(4)),
)
def tile_pyramid(spark, sf):
    base = B.pixels(spark, sf).select("col", "row", F.col("n").cast("double").alias("value"))
    return T.tile_pyramid(base, 64, 8).select("level", "col", "row", rnd("value").alias("value"))


MERGE = (
    "WITH s0 AS (SELECT l_linenumber % 4 AS sid, l_partkey % 32 AS col, l_suppkey % 32 AS row, AVG(l_quantity) AS value FROM lineitem GROUP BY ALL), "
    "s1 AS (SELECT sid, col // 2 AS col, row // 2 AS row, AVG(value) AS value FROM s0 GROUP BY ALL), "
    "m0 AS (SELECT 0 AS level, col + (sid % 2) * 32 AS col, row + (sid // 2) * 32 AS row, value FROM s0), "
    "m1 AS (SELECT 1 AS level, col + (sid % 2) * 16 AS col, row + (sid // 2) * 16 AS row, value FROM s1), "
    "m2 AS (SELECT 2 AS level, col // 2 AS col, row // 2 AS row, AVG(value) AS value FROM m1 GROUP BY ALL) "
    "SELECT level, col, row, round(value, 6) AS value FROM (FROM m0 UNION ALL FROM m1 UNION ALL FROM m2)"
)


@query("tile_merge", MERGE)
def tile_merge(spark, sf):
    base = (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_linenumber") % 4).alias("sid"), (F.col("l_partkey") % 32).alias("col"), (F.col("l_suppkey") % 32).alias("row"))
        .agg(F.avg("l_quantity").alias("value"))
    )
    return T.tile_merge(base, "sid", 2, 32, 16).select("level", "col", "row", rnd("value").alias("value"))


@query(
    "tile_grid_fill",
    PIX + ", c AS (SELECT col, row, printf('r%04d_c%04d', row, col) AS file FROM pix WHERE n >= 15) "
    "SELECT 63 - r AS out_row, k AS col, file IS NOT NULL AS valid, file FROM range(0, 64) a(r), range(0, 64) b(k) LEFT JOIN c ON row = r AND col = k",
)
def tile_grid_fill(spark, sf):
    cells = B.pixels(spark, sf).where("n >= 15").select("row", "col", F.format_string("r%04d_c%04d", "row", "col").alias("file"))
    return T.grid_fill(cells, 64, 64, spark)


@query(
    "best_source_file",
    "WITH f AS (SELECT p_type, p_partkey, abs(ln((p_size / 10.0) / (1.0 + p_partkey % 7))) AS score FROM part "
    "WHERE p_brand <> 'Brand#3' AND p_partkey % 200 <= 120 AND p_partkey % 200 + p_size >= 60) "
    "SELECT p_type, p_partkey AS best, round(score, 6) + 0.0 AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY score, p_partkey) AS rn FROM f) WHERE rn = 1",
)
def best_source_file(spark, sf):
    k = F.col("p_partkey")
    ok = (F.col("p_brand") != "Brand#3") & (k % 200 <= 120) & (k % 200 + F.col("p_size") >= 60)
    ratio = (F.col("p_size") / 10.0) / (F.lit(1.0) + k % 7)
    return T.best_source(table(spark, sf, "part"), "p_type", "p_partkey", ok, ratio).select("p_type", "best", rnd("score").alias("score"))


@query(
    "mask_boxmax",
    PIX + "SELECT col // 4 AS col, row // 4 AS row, MAX(CASE WHEN n % 9 = 0 OR n % 13 = 0 THEN 255 ELSE 0 END) AS mask FROM pix GROUP BY ALL",
)
def mask_boxmax(spark, sf):
    c = B.pixels(spark, sf).select(
        "col",
        "row",
        F.when(F.col("n") % 9 == 0, F.col("n")).otherwise(0).alias("r"),
        F.when(F.col("n") % 13 == 0, F.col("n")).otherwise(0).alias("g"),
    )
    return T.mask_boxmax(c, (F.col("r") != 0) | (F.col("g") != 0), 4)


def _dilate_sql(src: str, dst: str) -> str:
    return (
        f"{dst} AS (SELECT c AS col, r AS row, CASE WHEN MAX(CASE WHEN col = c AND row = r THEN value END) IS NOT NULL THEN MAX(CASE WHEN col = c AND row = r THEN value END) "
        f"ELSE CAST(SUM(value) AS BIGINT) // COUNT(*) END AS value FROM range(0, 64) x(c), range(0, 64) y(r), {src} WHERE abs(col - c) <= 1 AND abs(row - r) <= 1 GROUP BY c, r)"
    )


@query(
    "mask_dilate",
    PIX + ", d0 AS (SELECT col, row, n AS value FROM pix WHERE n % 9 = 0), " + _dilate_sql("d0", "d1") + ", " + _dilate_sql("d1", "d2") + " SELECT col, row, value FROM d2",
)
def mask_dilate(spark, sf):
    base = B.pixels(spark, sf).where("n % 9 = 0").select("col", "row", F.col("n").alias("value"))
    return T.mask_dilate(base, 64, 64, 2)


@query(
    "mask_dilate_binary",
    PIX + ", d AS (SELECT col, row FROM pix WHERE n % 9 = 0) SELECT DISTINCT c AS col, r AS row, CAST(255 AS BIGINT) AS value FROM range(0, 64) x(c), range(0, 64) y(r), d "
    "WHERE abs(col - c) <= 2 AND abs(row - r) <= 2",
)
def mask_dilate_binary(spark, sf):
    base = B.pixels(spark, sf).where("n % 9 = 0").select("col", "row", F.col("n").alias("value"))
    return T.mask_dilate(base, 64, 64, 2, binary=True)


@query(
    "raster_subtract",
    PIX + ", a AS (SELECT col, row, CASE WHEN n % 2 = 0 THEN 255 ELSE n END AS va, CASE WHEN n % 3 = 0 THEN 255 ELSE 0 END AS vb FROM pix) "
    "SELECT col, row, va - vb AS diff, CASE WHEN va = 255 AND vb <> 255 THEN 255 ELSE 0 END AS mask FROM a",
)
def raster_subtract(spark, sf):
    p = B.pixels(spark, sf)
    a = p.select("col", "row", F.when(F.col("n") % 2 == 0, 255).otherwise(F.col("n")).alias("value"))
    b = p.select("col", "row", F.when(F.col("n") % 3 == 0, 255).otherwise(0).alias("value"))
    return T.raster_subtract(a, b)


@query(
    "colour_normalize",
    with_sql("vert") + ", w AS (SELECT vid, 40 + r // 2 AS r, 10 + g // 3 AS g, b FROM vert), m AS (SELECT MIN(r) AS r0, MAX(r) AS r1, MIN(g) AS g0, MAX(g) AS g1, MIN(b) AS b0, MAX(b) AS b1 FROM w) "
    "SELECT vid, CAST(round((r - r0) * 1.0 / (r1 - r0) * 255.0) AS INTEGER) AS r, CAST(round((g - g0) * 1.0 / (g1 - g0) * 255.0) AS INTEGER) AS g, "
    "CAST(round((b - b0) * 1.0 / (b1 - b0) * 255.0) AS INTEGER) AS b FROM w, m",
)
def colour_normalize(spark, sf):
    v = B.vertices(spark, sf).select("vid", F.expr("40 + r div 2").alias("r"), F.expr("10 + g div 3").alias("g"), "b")
    return T.stretch_channels(v, ["r", "g", "b"])
