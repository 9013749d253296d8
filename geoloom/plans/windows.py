"""Ranks, renumbering, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.angles import pose_sum
from geoloom.operators import aggregates, ordering, windows
from geoloom.plans import bindings as B
from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import query, rnd, table


@query(
    "win_rank_ties",
    "SELECT l_suppkey, l_orderkey, l_partkey, rank, round(d, 6) + 0.0 AS d FROM (SELECT *, abs(l_quantity - 25) AS d, "
    "RANK() OVER (PARTITION BY l_suppkey ORDER BY abs(l_quantity - 25)) AS rank FROM lineitem) WHERE rank <= 5",
)
def win_rank_ties(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", F.abs(F.col("l_quantity") - 25).alias("d"))
    out = aggregates.rank_with_ties(li, ["l_suppkey"], "d", 5)
    return out.select("l_suppkey", "l_orderkey", "l_partkey", F.col("rank").cast("bigint").alias("rank"), rnd("d").alias("d"))


@query(
    "win_renumber",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE COUNT(*) FILTER (o_orderstatus <> 'P') OVER (ORDER BY o_orderkey) - 1 END AS BIGINT) AS new_id FROM orders",
)
def win_renumber(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return windows.renumber(o, "o_orderkey", F.col("o_orderstatus") != "P").select("o_orderkey", "new_id")


@query(
    "win_chunk_ranges",
    "SELECT (rn - 1) // 700 AS chunk, MIN(o_orderkey) AS first, MAX(o_orderkey) AS last, COUNT(*) AS n FROM "
    "(SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1",
)
def win_chunk_ranges(spark, sf):
    return windows.chunk_ranges(table(spark, sf, "orders"), "o_orderkey", 700)


@query(
    "win_cumulative_offset",
    "SELECT l_suppkey, n, CAST(COALESCE(SUM(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_id "
    "FROM (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey)",
)
def win_cumulative_offset(spark, sf):
    return windows.cumulative_offset(table(spark, sf, "lineitem"), "l_suppkey")


@query(
    "win_pose_delta",
    with_sql("ev") + ", p AS (SELECT event_id, user_id, t AS tt, value AS x, CAST(event_id % 101 AS DOUBLE) AS y, event_id % 63 / 10.0 AS a FROM ev), "
    "l AS (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(a) OVER w AS pa FROM p WINDOW w AS (PARTITION BY user_id ORDER BY tt, event_id)) "
    "SELECT event_id, round(cos(pa) * (x - px) + sin(pa) * (y - py), 6) + 0.0 AS dx, round(-sin(pa) * (x - px) + cos(pa) * (y - py), 6) + 0.0 AS dy, "
    "round(a - pa, 6) + 0.0 AS dt, round(x, 6) + 0.0 AS back_x, round(y, 6) + 0.0 AS back_y FROM l WHERE px IS NOT NULL",
)
def win_pose_delta(spark, sf):
    e = F.col("event_id")
    poses = B.events(spark, sf).select(
        "event_id", "user_id", "t", F.col("value").alias("x"), (e % 101).cast("double").alias("y"), (e % 63 / 10.0).alias("a")
    )
    out = windows.pose_deltas(poses, "user_id", ["t", "event_id"], ["x", "y", "a"])
    back = pose_sum([F.col(f"_p{i}") for i in range(3)], [F.col(c) for c in ("dx", "dy", "dt")])
    return out.select(
        "event_id",
        *[rnd(c).alias(c) for c in ("dx", "dy", "dt")],
        rnd(back[0]).alias("back_x"),
        rnd(back[1]).alias("back_y"),
    )


@query(
    "sort_perm",
    "SELECT l_orderkey, l_linenumber, l_partkey, ROW_NUMBER() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem",
)
def sort_perm(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = ordering.row_numbers(li, [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"], "place")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("place") - 1).alias("place"))


@query(
    "sort_str_tiles",
    "WITH n AS (SELECT CAST(ceil(sqrt(ceil(COUNT(*) / 500.0))) AS BIGINT) * 500 AS per FROM lineitem), "
    "s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, (ROW_NUMBER() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey) - 1) // per AS slice FROM lineitem, n) "
    "SELECT l_orderkey, l_linenumber, l_partkey, slice, (ROW_NUMBER() OVER (PARTITION BY slice ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) - 1) // 500 AS page FROM s",
)
def sort_str_tiles(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    out = ordering.str_tiles(li, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"], 500)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "slice", "page")


def _bits(v: str, shift: int) -> str:
    return " + ".join(f"(({v} >> {i}) & 1) * {1 << (2 * i + shift)}" for i in range(16))


@query(
    "sort_zorder",
    "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity * 1000) AS BIGINT) AS cx, CAST(floor(l_extendedprice / 2) AS BIGINT) AS cy FROM lineitem) "
    f"SELECT l_orderkey, l_linenumber, l_partkey, CAST({_bits('cx', 0)} + {_bits('cy', 1)} AS BIGINT) AS zkey FROM c",
)
def sort_zorder(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    cells = (F.floor(F.col("l_quantity") * 1000), F.floor(F.col("l_extendedprice") / 2))
    return windows.zorder_layout(li, "zkey", cells).select("l_orderkey", "l_linenumber", "l_partkey", "zkey")


@query(
    "topk_queue",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 25",
)
def topk_queue(spark, sf):
    keys = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"]
    return table(spark, sf, "lineitem").select(*keys).orderBy(*keys).limit(25)
