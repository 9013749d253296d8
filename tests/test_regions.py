"""Regions by nearest seed against Dijkstra's search."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import regions
from geoloom.operators.regions import seed_regions
from geoloom.session import bucketed


def nearest(edges, seeds):
    """Least (distance, seed) of every vertex, nearest first."""
    near = {}
    for a, b, w in edges:
        if w is not None and a != b:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
    done, queue = {}, [(0, s, s) for s in seeds]
    heapq.heapify(queue)
    while queue:
        d, seed, v = heapq.heappop(queue)
        if v in done:
            continue
        done[v] = (d, seed)
        for u, w in near.get(v, ()):
            heapq.heappush(queue, (d + w, seed, u))
    return {(v, d, s) for v, (d, s) in done.items()}


def got(spark, edges, seeds, **options):
    rows = seed_regions(spark.createDataFrame(edges, "a long, b long, w long"), spark.createDataFrame([(s,) for s in seeds], "vid long"), **options)
    return {tuple(r) for r in rows.collect()}


@pytest.mark.parametrize("bucket", [None, 3.0])
def test_equals_dijkstra(spark, bucket):
    r = random.Random(4)
    edges = [(r.randrange(150), r.randrange(150), r.randrange(0, 12)) for _ in range(260)] + [(3, 4, None), (5, 5, 1), (900, 901, 2)]
    assert got(spark, edges, [3, 77, 120, 500, 3], bucket=bucket) == nearest(edges, [3, 77, 120, 500])


def test_hub_with_a_third_of_all_edges(spark):
    edges = [(0, k, 1 + k % 5) for k in range(1, 2000)] + [(k, k + 1, 1) for k in range(1, 2000)]
    assert got(spark, edges, [1500, 1999]) == nearest(edges, [1500, 1999])


def test_no_edges_and_negative_weights(spark):
    assert got(spark, [], [2]) == {(2, 0, 2)}
    assert got(spark, [(1, 2, 1)], []) == set()
    with pytest.raises(ValueError):
        got(spark, [(1, 2, -1)], [1])


def test_edges_stay_in_their_buckets(spark):
    """What is joined by the key it was written by is not shuffled again."""
    rows = spark.range(5000).select((F.col("id") % 700).alias("s"), F.col("id").alias("w"))
    links, front = bucketed(rows, "links", "s"), bucketed(rows.groupBy("s").agg(F.min("w").alias("least")), "front", "s")
    met = front.hint("merge").join(links, "s")
    assert met.count() == 5000 and "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("links_", "front_"))]


def test_hubs_are_not_dealt_by_vertex(spark, monkeypatch):
    monkeypatch.setattr(regions, "HUB_LINKS", 50)
    edges = [(0, k, 1 + k % 5) for k in range(1, 300)] + [(k, k + 1, 1) for k in range(1, 299)]
    assert got(spark, edges, [150, 299, 900]) == nearest(edges, [150, 299, 900])
