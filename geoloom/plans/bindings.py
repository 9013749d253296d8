"""How geometry is read from the given tables, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans.registry import micros, table


def with_sql(*views: str) -> str:
    """WITH clause from named views."""
    return "WITH " + ", ".join(VIEWS[v] for v in views) + " "


BOXES = (
    "boxes AS (SELECT l_orderkey, l_linenumber, l_partkey, "
    "l_quantity AS x1, l_extendedprice AS y1, "
    "l_quantity + (l_discount * 100 + 1) AS x2, l_extendedprice + (l_tax * 1000 + 1) AS y2 FROM lineitem)"
)
POINTS = (
    "pts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, "
    "l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem)"
)
CUST = "cust AS (SELECT c_custkey, c_custkey % 97 AS cx, c_acctbal / 100 AS cy, 1 + c_custkey % 5 AS cr FROM customer)"
SUPP = "supp AS (SELECT s_suppkey, s_suppkey % 97 AS sx, s_acctbal / 100 AS sy, 1 + s_suppkey % 5 AS sr FROM supplier)"
EV = (
    "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, value, "
    "(epoch_us(ts) - 1704067200000000) / 1000000.0 AS s FROM events)"
)
VERS = (
    "vers AS (SELECT * FROM (SELECT event_id, user_id, event_type, t AS valid_from, value, "
    "LEAD(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS valid_to FROM ev) WHERE event_type <> 'error')"
)
# moving points: position at t_ref and velocity per axis
MOVING = (
    "mov AS (SELECT event_id, s AS t_ref, value AS ax, (user_id % 7) - 3 AS vx, "
    "event_id % 101 AS ay, (event_id % 5) - 2 AS vy FROM ev)"
)
# a survey mesh: one sheet of 20 x 25 vertices per 500 orders; holes where the status is P
VERT = (
    "vert AS (SELECT o_orderkey AS vid, o_orderkey // 500 AS mesh_id, "
    "CAST((o_orderkey % 500) % 20 AS DOUBLE) AS x, CAST((o_orderkey % 500) // 20 AS DOUBLE) AS y, "
    "CAST((o_custkey * 7 + o_orderkey) % 17 AS DOUBLE) / 4 AS z, "
    "o_custkey % 256 AS r, (o_custkey * 3) % 256 AS g, (o_custkey * 5) % 256 AS b, "
    "CAST(1 + o_custkey % 9 AS DOUBLE) AS conf, o_orderstatus AS st FROM orders)"
)
FACE = (
    "face AS (SELECT 2 * vid AS fid, mesh_id, vid AS v0, vid + 20 AS v1, vid + 21 AS v2 FROM vert "
    "WHERE x < 19 AND y < 24 AND st <> 'P' UNION ALL "
    "SELECT 2 * vid + 1 AS fid, mesh_id, vid AS v0, vid + 21 AS v1, vid + 1 AS v2 FROM vert "
    "WHERE x < 19 AND y < 24 AND st <> 'P')"
)
# faces with the coordinates of their corners
TRI = (
    "tri AS (SELECT f.fid, f.mesh_id, f.v0, f.v1, f.v2, a.x AS ax, a.y AS ay, a.z AS az, "
    "b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM face f "
    "JOIN vert a ON a.vid = f.v0 JOIN vert b ON b.vid = f.v1 JOIN vert c ON c.vid = f.v2)"
)
CORNER = (
    "corner AS (SELECT fid, mesh_id, v0 AS vid, 0 AS k FROM face UNION ALL "
    "SELECT fid, mesh_id, v1, 1 FROM face UNION ALL SELECT fid, mesh_id, v2, 2 FROM face)"
)
DEDGE = (
    "dedge AS (SELECT fid, v0 AS s, v1 AS d FROM face UNION ALL SELECT fid, v1, v2 FROM face "
    "UNION ALL SELECT fid, v2, v0 FROM face)"
)
UEDGE = "uedge AS (SELECT least(s, d) AS a, greatest(s, d) AS b, COUNT(*) AS n FROM dedge GROUP BY ALL)"
NBR = "nbr AS (SELECT DISTINCT s AS vid, d AS nb FROM dedge UNION SELECT DISTINCT d, s FROM dedge)"
# border vertices: number of neighbours differs from number of faces
BDY = (
    "bdy AS (SELECT n.vid FROM (SELECT vid, COUNT(*) AS nn FROM nbr GROUP BY vid) n "
    "JOIN (SELECT vid, COUNT(*) AS nf FROM corner GROUP BY vid) c ON n.vid = c.vid WHERE nn <> nf)"
)
PIXELS = (
    "pix AS (SELECT l_partkey % 64 AS col, l_suppkey % 64 AS row, AVG(l_extendedprice) AS value, "
    "COUNT(*) AS n FROM lineitem GROUP BY ALL)"
)
VIEWS = {
    "boxes": BOXES,
    "pts": POINTS,
    "cust": CUST,
    "supp": SUPP,
    "ev": EV,
    "vers": VERS,
    "mov": MOVING,
    "vert": VERT,
    "face": FACE,
    "tri": TRI,
    "corner": CORNER,
    "dedge": DEDGE,
    "uedge": UEDGE,
    "nbr": NBR,
    "bdy": BDY,
    "pix": PIXELS,
}


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        q.alias("x1"),
        p.alias("y1"),
        (q + (F.col("l_discount") * 100 + 1)).alias("x2"),
        (p + (F.col("l_tax") * 1000 + 1)).alias("y2"),
    )


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", (k % 97).alias("cx"), (F.col("c_acctbal") / 100).alias("cy"), (1 + k % 5).alias("cr")
    )


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        "s_suppkey", (k % 97).alias("sx"), (F.col("s_acctbal") / 100).alias("sy"), (1 + k % 5).alias("sr")
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "event_type",
        micros("ts").alias("t"),
        "value",
        ((micros("ts") - F.lit(1704067200000000)) / 1000000.0).alias("s"),
    )


def moving(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "event_id",
        F.col("s").alias("t_ref"),
        F.col("value").alias("ax"),
        (F.col("user_id") % 7 - 3).alias("vx"),
        (F.col("event_id") % 101).alias("ay"),
        (F.col("event_id") % 5 - 2).alias("vy"),
    )


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    local = k % 500
    return table(spark, sf, "orders").select(
        k.alias("vid"),
        F.expr("o_orderkey div 500").alias("mesh_id"),
        (local % 20).cast("double").alias("x"),
        F.expr("(o_orderkey % 500) div 20").cast("double").alias("y"),
        (((c * 7 + k) % 17).cast("double") / 4).alias("z"),
        (c % 256).alias("r"),
        ((c * 3) % 256).alias("g"),
        ((c * 5) % 256).alias("b"),
        (1 + c % 9).cast("double").alias("conf"),
        F.col("o_orderstatus").alias("st"),
    )


def faces(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vid")
    two = F.array(
        F.struct((2 * v).alias("fid"), v.alias("v0"), (v + 20).alias("v1"), (v + 21).alias("v2")),
        F.struct((2 * v + 1).alias("fid"), v.alias("v0"), (v + 21).alias("v1"), (v + 1).alias("v2")),
    )
    return (
        vertices(spark, sf)
        .where("x < 19 AND y < 24 AND st <> 'P'")
        .select("mesh_id", F.inline(two))
        .select("fid", "mesh_id", "v0", "v1", "v2")
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy((F.col("l_partkey") % 64).alias("col"), (F.col("l_suppkey") % 64).alias("row"))
        .agg(F.avg("l_extendedprice").alias("value"), F.count("*").alias("n"))
    )
