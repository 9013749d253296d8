"""Connected components and k-hop growth on edge tables.

Every step is an aggregate (which combines before the shuffle, so a hub with a third
of all edges is cheap) or an equi-join on vertex ids.  Neighbour lists are never built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import checkpoint, stored

#: Links that one task is meant to see; graphs with fewer are left to the planner.
TASK_LINKS = 1_000_000
#: Links from which on a vertex is a hub, in larger graphs: its links are not dealt to one task.
HUB_LINKS = 100_000


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    two = F.array(
        F.struct(F.col(a).alias("s"), F.col(b).alias("d")), F.struct(F.col(b).alias("s"), F.col(a).alias("d"))
    )
    return edges.where(F.col(a) != F.col(b)).select(F.inline(two)).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every vertex of ``edges``; comp is the lowest id of its component.

    Large-star and small-star rounds (Kiveris et al., 2014): each edge set is rewritten
    so that vertices hang from ever lower ids; it stops when only stars are left.
    """
    links = checkpoint(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while True:
        n, done = _all_stars(links)
        if done:
            break
        if n <= TASK_LINKS:
            links = checkpoint(_small_star(_large_star(links, 1), 1))
        else:
            tasks = n // TASK_LINKS + 1
            links = checkpoint(_small_star(stored(_large_star(links, tasks), "links"), tasks))
    # every remaining edge is (vertex, root); roots are lowest ids
    return (
        links.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        .unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("comp")))
        .groupBy("id")
        .agg(F.min("comp").alias("comp"))
    )


def _all_stars(links: DataFrame) -> tuple[int, bool]:
    """How many links, and whether every vertex hangs from one lower vertex, and that one from nothing."""
    n = links.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u"), F.count_if(F.col("u") < F.col("v")).alias("up")).first()
    if n["n"] != n["u"] or n["up"]:
        return n["n"], False
    # what vertices hang from, each once: a root that holds half the graph is one row
    return n["n"], links.select("v").distinct().join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _lowest(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))


def _with_lowest(directed: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(``directed`` with the lowest id m at and around its u, (u, m) of every u).

    With more than one task, links are dealt to that many by u.  Those of hubs are not: there are at most as many hubs
    as links divided by ``HUB_LINKS``, so their lowest ids go to every task.
    """
    low = _lowest(directed)
    if tasks == 1:
        return directed.join(low.select("u", "m"), "u"), low.select("u", "m")
    low = stored(low, "lowest")
    hubs = F.broadcast(low.where(F.col("_n") >= HUB_LINKS).select("u", F.col("m").alias("_hub")))
    marked = directed.join(hubs, "u", "left")
    rest = low.where(F.col("_n") < HUB_LINKS).select("u", "m").repartition(tasks, "u")
    others = marked.where("_hub is null").select("u", "v").repartition(tasks, "u").join(rest, "u")
    at_hubs = marked.where("_hub is not null").select("u", "v", F.col("_hub").alias("m"))
    return others.unionByName(at_hubs), low.select("u", "m")


def _large_star(links: DataFrame, tasks: int) -> DataFrame:
    """Connect every larger neighbour of u to the lowest id around u."""
    flip = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    full = links.unionByName(flip)
    out, _ = _with_lowest(full, tasks)
    return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame, tasks: int) -> DataFrame:
    """Connect u and its smaller neighbours to the lowest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found, low = _with_lowest(down, tasks)
    moved = found.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))
    out = moved.unionByName(own)
    return (out.repartition(tasks, "u", "v") if tasks > 1 else out).distinct()


def label_all(ids: DataFrame, id_col: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Component per id; ids without edges are their own component."""
    comp = components(edges, a, b).withColumnRenamed("id", id_col)
    return ids.join(comp, id_col, "left").withColumn("comp", F.coalesce("comp", id_col))


def drop_small_groups(ids: DataFrame, id_col: str, edges: DataFrame, a: str, b: str, min_size: int) -> DataFrame:
    """Ids whose component has at least ``min_size`` members."""
    lab = checkpoint(label_all(ids.select(id_col), id_col, edges, a, b))
    big = lab.groupBy("comp").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_size)
    return lab.join(big, "comp", "left_semi").select(id_col)


def k_hops(edges: DataFrame, a: str, b: str, seeds: DataFrame, seed: str, k: int) -> DataFrame:
    """(id, hop) for all vertices at most k edges from the seeds."""
    links = checkpoint(both_ways(edges, a, b))
    seen = checkpoint(seeds.select(F.col(seed).alias("id")).distinct().withColumn("hop", F.lit(0)))
    rim = seen
    for hop in range(1, k + 1):
        step = rim.join(links, rim["id"] == links["s"]).select(F.col("d").alias("id")).distinct()
        rim = checkpoint(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(rim)
    return seen
