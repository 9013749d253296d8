"""Regions of a weighted graph by nearest seed.

Distances from many seeds at once, by a frontier in buckets of distance (delta stepping): a round
relaxes only the vertices whose distance changed and lies in the nearest bucket with any, so work
follows the front and not the graph.  Each round is one join of the front with the edges and one
aggregate that is combined before its shuffle.  Edges and distances are written in buckets by vertex once
and stay there, so a round shuffles only the new distances it sends.  The edges of hubs are not dealt by
vertex: there are few hubs, so what their edges need goes to every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.graph import HUB_LINKS
from geoloom.session import bucketed, stored


def seed_regions(edges: DataFrame, seeds: DataFrame, a: str = "a", b: str = "b", weight: str = "w", seed: str = "vid", bucket: float | None = None) -> DataFrame:
    """(id, dist, seed) for every vertex that a seed reaches.

    ``edges`` join a and b both ways; their weights are not negative, and rows without a weight are no
    edges.  The nearest seed names a vertex, of equally near ones the least.  ``bucket`` is the range of
    distances that is worked on together, by default sixteen mean weights: small ones relax a vertex
    less often, large ones take fewer rounds; the result is the same.  Seeds without edges are their own region.
    """
    ends = [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    pairs = edges.where((F.col(a) != F.col(b)) & F.col(weight).isNotNull()).groupBy(*ends).agg(F.min(weight).alias("w"))
    pairs = stored(pairs.select("a", "b", "w"), "pairs")
    facts = pairs.agg(F.min("w").alias("low"), F.avg("w").alias("mean")).first()
    if facts.low is not None and facts.low < 0:
        raise ValueError("weights must not be negative")
    width = bucket if bucket is not None else 16 * float(facts.mean or 1.0) or 1.0
    kind = pairs.schema["w"].dataType
    two = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("d")), F.struct(F.col("b").alias("s"), F.col("a").alias("d")))
    links = pairs.select(F.inline(two), "w")
    degree = stored(links.groupBy(F.col("s").alias("id")).agg(F.count("*").alias("n")), "degrees")
    hubs = degree.where(F.col("n") >= HUB_LINKS).select(F.col("id").alias("s"))
    at_hubs = None
    if not hubs.isEmpty():
        at_hubs = stored(links.join(F.broadcast(hubs), "s"), "hubs")
        links = links.join(F.broadcast(hubs), "s", "left_anti")
    links = bucketed(links, "links", "s")
    start = seeds.select(F.col(seed).alias("id")).dropna().withColumn("seed", F.col("id"))
    start = degree.select("id", F.lit(None).cast(start.schema["seed"].dataType).alias("seed")).unionByName(start).groupBy("id").agg(F.max("seed").alias("seed"))
    best = F.when(F.col("seed").isNotNull(), F.struct(F.lit(0).cast(kind).alias("dist"), "seed"))
    state = bucketed(start.select("id", best.alias("best"), F.col("seed").isNotNull().alias("open")), "regions", "id")
    while True:
        nearest = state.where("open").agg(F.min("best.dist")).first()[0]
        if nearest is None:
            return state.where("best is not null").select("id", "best.dist", "best.seed")
        now = F.col("open") & (F.col("best.dist") <= F.lit(float(nearest) + width))
        front = state.where(now).select(F.col("id").alias("s"), "best")
        step = F.struct((F.col("best.dist") + F.col("w")).cast(kind).alias("dist"), F.col("best.seed").alias("seed"))
        reached = front.join(links, "s").select(F.col("d").alias("id"), step.alias("new"))
        if at_hubs is not None:
            known = F.broadcast(front.join(F.broadcast(hubs), "s", "left_semi"))
            reached = reached.unionByName(at_hubs.join(known, "s").select(F.col("d").alias("id"), step.alias("new")))
        met = state.join(reached.groupBy("id").agg(F.min("new").alias("new")), "id", "left")
        better = F.col("new").isNotNull() & (F.col("best").isNull() | (F.col("new") < F.col("best")))
        state = bucketed(met.select("id", F.when(better, F.col("new")).otherwise(F.col("best")).alias("best"), (better | (F.col("open") & ~now)).alias("open")), "regions", "id")
