"""Graph queries on mesh edges and order-part links, covers and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import cover, graph
from geoloom.operators import mesh as M
from geoloom.operators.smooth import icp
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.meshes import REACH, TOPO, recursive
from geoloom.plans.registry import query, rnd, table


@query("graph_neighbors", TOPO + "SELECT vid, nb FROM nbr")
def graph_neighbors(spark, sf):
    return M.neighbours(B.faces(spark, sf))


@query("graph_adjacent_faces", TOPO + "SELECT vid, fid FROM corner")
def graph_adjacent_faces(spark, sf):
    return M.corners(B.faces(spark, sf)).select("vid", "fid")


@query(
    "graph_nring",
    TOPO + ", s AS (SELECT vid AS id FROM vert WHERE vid % 500 = 210), "
    "h1 AS (SELECT DISTINCT nb AS id FROM s JOIN nbr ON vid = id), h2 AS (SELECT DISTINCT nb AS id FROM h1 JOIN nbr ON vid = id), "
    "h3 AS (SELECT DISTINCT nb AS id FROM h2 JOIN nbr ON vid = id), "
    "a AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) "
    "SELECT id, MIN(hop) AS hop FROM a GROUP BY id",
)
def graph_nring(spark, sf):
    seeds = B.vertices(spark, sf).where("vid % 500 = 210")
    return graph.k_hops(M.edges(B.faces(spark, sf)), "a", "b", seeds, "vid", 3)


@query(
    "graph_boundary",
    TOPO + "SELECT vid, nn AS n_neighbours, nf AS n_faces, nn <> nf AS is_border FROM (SELECT vid, COUNT(*) AS nn FROM nbr GROUP BY vid) a "
    "JOIN (SELECT vid, COUNT(*) AS nf FROM corner GROUP BY vid) b USING (vid)",
)
def graph_boundary(spark, sf):
    return M.vertex_border(B.faces(spark, sf))


@query("graph_boundary_edges", TOPO + "SELECT a, b FROM uedge WHERE n = 1")
def graph_boundary_edges(spark, sf):
    return M.edges(B.faces(spark, sf)).where("n = 1").select("a", "b")


@query(
    "graph_components",
    recursive(TOPO) + ", nodes AS (SELECT DISTINCT vid AS id FROM corner), lnk AS (SELECT vid AS s, nb AS d FROM nbr), " + REACH + "SELECT id, lab AS comp FROM reach",
)
def graph_components(spark, sf):
    return graph.components(M.edges(B.faces(spark, sf)), "a", "b")


@query(
    "graph_components_orders",
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, -1 - l_orderkey AS o FROM lineitem), "
    "nodes AS (SELECT p AS id FROM e UNION SELECT o FROM e), lnk AS (SELECT p AS s, o AS d FROM e UNION ALL SELECT o, p FROM e), " + REACH + "SELECT id, lab AS comp FROM reach",
)
def graph_components_orders(spark, sf):
    """Parts linked through common orders."""
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p"), (-1 - F.col("l_orderkey")).alias("o"))
    return graph.components(e, "p", "o")


# twin: step by step, the pairs that are left after each pick
@query(
    "set_cover_greedy",
    "WITH RECURSIVE g AS (SELECT DISTINCT CAST(1 AS BIGINT) AS pick, l_orderkey AS s, l_partkey AS i FROM lineitem "
    "WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL UNION ALL "
    "SELECT a.pick + 1, a.s, a.i FROM g a CROSS JOIN (SELECT s AS best FROM g GROUP BY s ORDER BY COUNT(*) DESC, s LIMIT 1) b "
    "LEFT JOIN g h ON h.s = b.best AND h.i = a.i WHERE h.i IS NULL), "
    "n AS (SELECT pick, s, COUNT(*) AS gain FROM g GROUP BY pick, s) "
    "SELECT pick, s AS l_orderkey, gain FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY pick ORDER BY gain DESC, s) = 1",
)
def set_cover_greedy(spark, sf):
    """Orders that together hold every part, in greedy order."""
    return cover.greedy_cover(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query(
    "set_intersect_except",
    "WITH e AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_type FROM events), "
    "a AS (SELECT user_id, day FROM e WHERE event_type = 'purchase'), b AS (SELECT user_id, day FROM e WHERE event_type = 'error') "
    "SELECT user_id, day, 'shared' AS kind FROM (FROM a INTERSECT FROM b) UNION ALL SELECT user_id, day, 'only_first' FROM (FROM a EXCEPT FROM b)",
)
def set_intersect_except(spark, sf):
    """Days on which a user has both kinds of events, or only the first."""
    e = B.events(spark, sf).select("user_id", F.expr("t div 86400000000").alias("day"), "event_type")
    a, b = (e.where(F.col("event_type") == t).select("user_id", "day") for t in ("purchase", "error"))
    shared = a.intersect(b).withColumn("kind", F.lit("shared"))
    return shared.unionByName(a.subtract(b).withColumn("kind", F.lit("only_first")))


# one round in the plane: rotation from the cross covariance, then the mean distance of the pairs
@query(
    "icp_iteration",
    with_sql("cust", "supp") + ", d AS (SELECT c_custkey, cx, cy, sx, sy, sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) AS dist, "
    "ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy), s_suppkey) AS rk FROM cust, supp), "
    "p AS (SELECT * FROM d WHERE rk = 1 AND dist < 8), "
    "m AS (SELECT COUNT(*) AS n, AVG(dist) AS md, atan2(covar_pop(cx, sy) - covar_pop(cy, sx), covar_pop(cx, sx) + covar_pop(cy, sy)) AS a, AVG(cx) AS mcx, AVG(cy) AS mcy, AVG(sx) AS msx, AVG(sy) AS msy FROM p) "
    "SELECT n, round(md, 6) AS mean_dist, round(a, 6) + 0.0 AS angle, round(msx - (cos(a) * mcx - sin(a) * mcy), 5) + 0.0 AS tx, round(msy - (sin(a) * mcx + cos(a) * mcy), 5) + 0.0 AS ty FROM m",
)
def icp_iteration(spark, sf):
    import math

    c = B.customers(spark, sf).select("c_custkey", F.col("cx").cast("double").alias("cx"), "cy")
    _, log = icp(c, B.suppliers(spark, sf), "c_custkey", ["cx", "cy"], "s_suppkey", ["sx", "sy"], 8.0, 1)
    r = log[0]
    return spark.range(1).select(
        F.lit(r["n"]).cast("bigint").alias("n"),
        rnd(F.lit(r["mean_dist"])).alias("mean_dist"),
        rnd(F.lit(math.atan2(r["rot"][1, 0], r["rot"][0, 0]))).alias("angle"),
        rnd(F.lit(float(r["move"][0])), 5).alias("tx"),
        rnd(F.lit(float(r["move"][1])), 5).alias("ty"),
    )
