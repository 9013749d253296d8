"""Two-view models of image pairs, on matches derived from the order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators.twoview import two_view_fit
from geoloom.plans.registry import query, rnd, table

TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
WILD = "(l_orderkey + l_linenumber) % 3 = 0"

# pairs are suppliers by number; a third of the matches is moved away from its pair's plane mapping
FLAT_MAP = (
    "l_suppkey % 40 AS pair, CAST(l_quantity AS DOUBLE) AS x1, l_extendedprice / 1000 AS y1, "
    f"CASE WHEN {WILD} THEN 20 + l_partkey % 17 ELSE 0 END AS dx, CASE WHEN {WILD} THEN 10 + l_orderkey % 13 ELSE 0 END AS dy"
)


def _mapped(x: str, y: str) -> tuple[str, str]:
    low = f"(1 + {x} * pair / 50000.0 + {y} / 2000.0)"
    return f"((1 + pair / 100.0) * {x} + 0.1 * {y} + 5) / {low}", f"(-0.05 * {x} + (1 - pair / 200.0) * {y} + pair) / {low}"


U, V = _mapped("x1", "y1")
U0, V0 = _mapped("0", "0")
U1, V1 = _mapped("50", "80")


@query(
    "agg_homography",
    f"WITH m AS (SELECT {FLAT_MAP} FROM lineitem) SELECT pair, COUNT(*) AS n_matches, COUNT(*) FILTER (WHERE dx = 0) AS n_inliers, "
    f"round({U0}, 4) + 0.0 AS u0, round({V0}, 4) + 0.0 AS v0, round({U1}, 4) + 0.0 AS u1, round({V1}, 4) + 0.0 AS v1 FROM m GROUP BY pair",
)
def agg_homography(spark, sf):
    """The plane mapping of every pair: its inliers and where it takes two points."""
    m = table(spark, sf, "lineitem").selectExpr(*TIE, *FLAT_MAP.split(", "))
    m = m.selectExpr("pair", "x1", "y1", f"{U} + dx AS x2", f"{V} - dy AS y2", *TIE)
    fit = two_view_fit(m, ["pair"], TIE, "homography", 0.01)
    h = [F.col("model")[i] for i in range(9)]
    at = lambda i, x, y: h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2]
    ends = [rnd(at(i, x, y) / at(2, x, y), 4).alias(f"{'uv'[i]}{k}") for k, (x, y) in enumerate([(0, 0), (50, 80)]) for i in range(2)]
    return fit.select("pair", "n_matches", "n_inliers", *ends)


# a camera moves sideways by (tx, ty); a third of the matches is moved across its line
SIDEWAYS = (
    "l_suppkey % 30 AS pair, l_quantity / (10 + 100 * l_discount + 100 * l_tax) AS x1, l_extendedprice / 1000 / (10 + 100 * l_discount + 100 * l_tax) AS y1, "
    f"CASE WHEN {WILD} THEN 1 + l_partkey % 7 ELSE 0 END AS off, 3 + l_suppkey % 5 AS tx, 1 + l_suppkey % 3 AS ty, 10 + 100 * l_discount + 100 * l_tax AS z"
)


@query(
    "agg_fundamental",
    f"WITH m AS (SELECT {SIDEWAYS} FROM lineitem) SELECT pair, COUNT(*) AS n_matches, COUNT(*) FILTER (WHERE off = 0) AS n_inliers, "
    "round(ty / sqrt(2.0 * (tx * tx + ty * ty)), 4) AS fx, round(tx / sqrt(2.0 * (tx * tx + ty * ty)), 4) AS fy, CAST(0 AS DOUBLE) AS rest FROM m GROUP BY pair, tx, ty",
)
def agg_fundamental(spark, sf):
    """The epipolar model of every pair: its inliers, its two entries and the greatest of what has to be zero."""
    m = table(spark, sf, "lineitem").selectExpr(*TIE, *SIDEWAYS.split(", "))
    m = m.selectExpr("pair", "x1", "y1", "x1 + tx / z - off * ty AS x2", "y1 + ty / z + off * tx AS y2", *TIE)
    fit = two_view_fit(m, ["pair"], TIE, "fundamental", 0.001, tries=256)
    f = [F.col("model")[i] for i in range(9)]
    zeros = [F.abs(f[i]) for i in (0, 1, 3, 4, 8)] + [F.abs(f[2] + f[6]), F.abs(f[5] + f[7])]
    return fit.select("pair", "n_matches", "n_inliers", rnd(F.abs(f[2]), 4).alias("fx"), rnd(F.abs(f[5]), 4).alias("fy"), rnd(F.greatest(*zeros), 4).alias("rest"))
