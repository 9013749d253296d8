"""Border loops of a mesh in order, and filling of the holes they go round.

A border edge is a face side without a face across.  Places on a loop come from pointer doubling: in
every round an edge learns what lies twice as far back, the least edge there and how far back that is.  The
number of rounds is the logarithm of the longest loop, and as every edge is its own key a loop with a third of
all edges is spread like any other.  Edges stay in their buckets: a round shuffles questions and answers
of loops that are not known yet, and loops that are known leave the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geoloom.functions import geom as G
from geoloom.operators.graph import label_all
from geoloom.operators.mesh import directed_edges, edges
from geoloom.session import bucketed, stored

#: Places of a loop, at most, that are kept together while its hole is filled, and edges of a cluster that is closed in a task.
BLOCK = 1024
#: Loops at a vertex, at most, whose other common vertices are looked for.
MEETING = 8
#: Edges, about, that one task closes.
TASK_EDGES = 200_000


def border_edges(faces: DataFrame) -> DataFrame:
    """(s, d): sides of faces that no other face shares, turned so that a hole lies to their left."""
    e = directed_edges(faces).select("s", "d")
    alone = e.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.count("*").alias("n"), F.first("s").alias("from"))
    return alone.where((F.col("n") == 1) & (F.col("a") != F.col("b"))).select(F.when(F.col("from") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("s"), F.col("from").alias("d"))


def _linked(border: DataFrame) -> DataFrame:
    """(s, d, p): each border edge with the start of the edge before it, which ends in s.

    Where several loops touch in a vertex its edges in and out are paired in order of their other ends.
    """
    into = border.select(F.col("d").alias("at"), F.col("s").alias("p"), F.row_number().over(Window.partitionBy("d").orderBy("s")).alias("k"))
    out = border.select(F.col("s").alias("at"), "s", "d", F.row_number().over(Window.partitionBy("s").orderBy("d")).alias("k"))
    return out.join(into, ["at", "k"], "left").select("s", "d", "p")


def border_loops(faces: DataFrame) -> DataFrame:
    """(loop_s, loop_d, place, s, d) of every border edge.

    A loop is named by its least edge, where places begin with 0; edges follow each other with the hole
    to their left.  A border that does not close, as in meshes whose faces turn different ways, is a chain:
    it is named by its first edge.
    """
    linked = _linked(border_edges(faces))
    # an edge that nothing precedes ends the walk back, so a chain is led by it
    open_ = F.col("p").isNull()
    back = [F.col("p").alias("bs"), F.when(~open_, F.col("s")).alias("bd")]
    none = F.lit(0).cast("bigint").alias("place")
    jump = bucketed(linked.select("s", "d", *back, F.col("s").alias("ls"), F.col("d").alias("ld"), none, open_.alias("done"), open_.alias("open")), "border", "s", "d")
    settled, span = [], 1
    while not jump.where("not done").isEmpty():
        there = jump.select(F.col("s").alias("bs"), F.col("d").alias("bd"), F.struct("bs", "bd", "ls", "ld", "place", "done", "open").alias("far"))
        told = jump.where("not done").select("s", "d", "bs", "bd").join(there, ["bs", "bd"]).select("s", "d", "far")
        met = jump.where("not done or open").join(told, ["s", "d"], "left")
        mine, other = F.struct("ls", "ld"), F.struct("far.ls", "far.ld")
        # an edge that is known on both halves was met twice, so the loop is shorter than both
        same = (F.col("ls") == F.col("far.ls")) & (F.col("ld") == F.col("far.ld"))
        take = ~same & (F.col("far.done") | (other < mine))
        new = {
            "bs": F.col("far.bs"),
            "bd": F.col("far.bd"),
            "ls": F.when(take, F.col("far.ls")).otherwise(F.col("ls")),
            "ld": F.when(take, F.col("far.ld")).otherwise(F.col("ld")),
            "place": F.when(take, F.col("far.place") + span).otherwise(F.col("place")),
            "done": F.col("far.done") | same,
            "open": F.col("far.open"),
        }
        step = met.select("s", "d", *[F.when(F.col("done"), F.col(c)).otherwise(v).alias(c) for c, v in new.items()])
        # edges of a loop are known within one round of each other, so those that were known before are not asked again
        settled.append(jump.where("done and not open"))
        jump, span = bucketed(step, "border", "s", "d"), 2 * span
    rows = reduce(DataFrame.unionByName, settled, jump)
    return rows.select(F.col("ls").alias("loop_s"), F.col("ld").alias("loop_d"), "place", "s", "d")


def _angle_cost() -> Column:
    """1 minus the cosine at b of the ear a, b, c: sharp corners first; corners without extent last."""
    point = lambda t: [F.col(f"{t}.at")[k] for k in range(3)]
    to = lambda t: G.sub(point(t), point("b"))
    size = F.sqrt(G.dot(to("a"), to("a")) * G.dot(to("c"), to("c")))
    return F.when(size > 0, 1 - G.dot(to("a"), to("c")) / size).otherwise(F.lit(3.0))


def _around(ring: DataFrame, key: list[str], value: str) -> DataFrame:
    """``ring`` with ``value`` of the places before (back) and after (on).

    Neighbours are found inside a block of places; the first and last rows of the blocks, which are few, tell
    the blocks next to them.  No loop is gathered in a task, and what is written by block stays where it is.
    """
    at = [*key, "block"]
    ends = ring.groupBy(*at).agg(F.min(F.struct("place", value)).alias("first"), F.max(F.struct("place", value)).alias("last"))
    order, all_ = Window.partitionBy(*key).orderBy("block"), Window.partitionBy(*key)
    # the last block of a loop goes on with the first
    before = F.coalesce(F.lag("last").over(order), F.max("last").over(all_))
    after = F.coalesce(F.lead("first").over(order), F.min("first").over(all_))
    ends = ends.select(*at, before.getField(value).alias("before"), after.getField(value).alias("after"))
    own = Window.partitionBy(*at).orderBy("place")
    inner = ring.withColumn("_back", F.lag(value).over(own)).withColumn("_on", F.lead(value).over(own))
    return inner.join(ends, at).select(*ring.columns, F.coalesce("_back", "before").alias("back"), F.coalesce("_on", "after").alias("on"))


def _marked(ring: DataFrame, at: list[str], some: DataFrame) -> DataFrame:
    """``ring`` with ``marked`` for the places in ``some``, which are told to blocks."""
    told = some.groupBy(*at).agg(F.collect_set("place").alias("_marks"))
    return ring.join(told, at, "left").withColumn("marked", F.coalesce(F.array_contains("_marks", F.col("place")), F.lit(False))).drop("_marks")


def _clusters(ring: DataFrame) -> tuple[DataFrame, bool]:
    """(loop_s, loop_d, cluster) of the loops that are closed in a task, and whether others are left for the rounds.

    A side that closes an ear of a loop can be brought by another one only where both have its two vertices, so loops that share
    two vertices are in one cluster.  At a vertex of more than ``MEETING`` loops all of them are taken for such.  A cluster
    of more than ``BLOCK`` edges, or with a loop whose vertices are not told once each, is left.
    """
    key = ["loop_s", "loop_d"]
    loop_of = F.xxhash64(*key).alias("loop")  # loops that get the same number only share a cluster
    at = ring.select(loop_of, F.col("v.b").alias("b")).distinct()
    shared = at.groupBy("b").agg(F.count("*").alias("loops"), F.min("loop").alias("least")).where("loops > 1")
    met = stored(at.join(shared, "b"), "meetings")
    few = met.where(F.col("loops") <= MEETING).select("b", F.col("loop").alias("u"))
    twice = few.join(few.withColumnRenamed("u", "v"), "b").where("u < v").groupBy("u", "v").agg(F.count("*").alias("both")).where("both > 1")
    links = stored(twice.select("u", "v").unionByName(met.where((F.col("loops") > MEETING) & (F.col("loop") > F.col("least"))).select(F.col("loop").alias("u"), F.col("least").alias("v"))), "links")
    size = ring.groupBy(*key).agg(F.count("*").alias("rows"), F.count_distinct("place").alias("places"), F.max("n").alias("n"))
    size = size.select(*key, loop_of, "rows", ((F.col("rows") != F.col("n")) | (F.col("places") != F.col("n"))).alias("odd"))
    of = label_all(size.select("loop").distinct(), "loop", links, "u", "v") if not links.isEmpty() else size.select("loop", F.col("loop").alias("comp")).distinct()
    size = stored(size.join(of.select("loop", F.col("comp").alias("cluster")), "loop"), "loops")
    fit = size.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.max("odd").alias("odd")).where((F.col("rows") <= BLOCK) & ~F.col("odd"))
    done = stored(size.join(fit.select("cluster"), "cluster", "left_semi").select(*key, "cluster"), "clusters")
    return done, done.count() < size.count()


_CLOSED = T.StructType([T.StructField(c, T.LongType()) for c in ("v0", "v1", "v2", "loop_s", "loop_d", "place", "n", "b")])


def _closed(ring: DataFrame, sides: DataFrame, clusters: DataFrame) -> DataFrame:
    """Faces (v0, v1, v2) of the ears of the loops in ``clusters``, and rows (loop_s, loop_d, place, n, b) of what is left of them."""
    key = ["loop_s", "loop_d"]
    place_of = [F.col("v.at")[k].alias(c) for k, c in enumerate("xyz")]
    rows = stored(ring.join(clusters, key).select("cluster", *key, "place", "v.b", F.xxhash64("v.b").alias("h"), *place_of), "corners")
    # a vertex is in few clusters, as a vertex of many loops has them in one
    at = rows.select("cluster", "b").distinct()
    own = sides.join(at.withColumnRenamed("b", "lo"), "lo").join(at.withColumnRenamed("b", "hi"), ["cluster", "hi"], "left_semi")
    both = rows.unionByName(own.select("cluster", "lo", "hi"), allowMissingColumns=True)
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK_EDGES + 1)
    dealt = both.repartition(tasks, "cluster").sortWithinPartitions("cluster", *key, "place")
    return dealt.mapInArrow(_close, _CLOSED)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rounds of ``fill_holes`` on whole clusters, some thousand edges at a time."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        of = held["cluster"].to_numpy()
        whole = int(np.searchsorted(of, of[-1])) if len(of) else 0
        if whole:
            yield _cut(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield _cut(held)


def _cut(rows: pa.Table) -> pa.RecordBatch:
    edge = rows["b"].is_valid().to_numpy()
    lo, hi = (rows[c].filter(pa.array(~edge)).to_numpy() for c in ("lo", "hi"))
    rows = rows.filter(pa.array(edge))
    loop = [rows[c].to_numpy() for c in ("cluster", "loop_s", "loop_d")]
    b, h = rows["b"].to_numpy(), rows["h"].to_numpy()
    known = np.all([rows[c].is_valid().to_numpy() for c in "xyz"], axis=0)
    xyz = [rows[c].to_numpy().astype(float) for c in "xyz"]
    of = np.cumsum(np.r_[False, np.any([c[1:] != c[:-1] for c in loop], axis=0)])
    verts, v = np.unique(b, return_inverse=True)
    code = lambda x, y: np.minimum(x, y) * len(verts) + np.maximum(x, y)
    taken = np.unique(code(np.searchsorted(verts, lo), np.searchsorted(verts, hi)))
    live, faces = np.arange(len(b)), []
    while True:
        n = np.bincount(of[live], minlength=of[-1] + 1)
        end = np.cumsum(n)
        ring = np.flatnonzero(n[of[live]] > 3)
        if not len(ring):
            break
        first, last = (end - n)[of[live[ring]]], end[of[live[ring]]] - 1
        back, on = live[np.where(ring == first, last, ring - 1)], live[np.where(ring == last, first, ring + 1)]
        i, place = live[ring], ring - first
        side = code(v[back], v[on])
        legal = (v[back] != v[on]) & ~np.isin(side, taken)
        with np.errstate(all="ignore"):
            p, q = ([x[o] - x[i] for x in xyz] for o in (back, on))
            dot = lambda x, y: x[0] * y[0] + x[1] * y[1] + x[2] * y[2]
            size = np.sqrt(dot(p, p) * dot(q, q))
            cost = np.where(known[i] & known[back] & known[on] & ~(size <= 0), 1 - dot(p, q) / size, 3.0)
        order = np.empty(len(b), np.int64)
        order[i[np.lexsort((place, h[i], cost))]] = np.arange(len(i))
        may = np.zeros(len(b), bool)
        may[i] = legal
        cut = np.flatnonzero(legal & (~may[back] | (order[i] < order[back])) & (~may[on] | (order[i] < order[on])))
        # two ears of one round must not bring the same side, and a ring of four keeps three
        cut = np.sort(cut[np.unique(side[cut], return_index=True)[1]])
        four = cut[n[of[i[cut]]] == 4]
        four = four[np.argsort(order[i[four]])]
        four = four[np.unique(of[i[four]], return_index=True)[1]]
        cut = np.r_[cut[n[of[i[cut]]] > 4], four]
        if not len(cut):
            break
        faces.append(np.stack([b[back[cut]], b[i[cut]], b[on[cut]]]))
        taken = np.union1d(taken, side[cut])
        live = np.delete(live, ring[cut])
    new = np.concatenate(faces, axis=1) if faces else np.empty((3, 0), np.int64)
    left = rows.select(["loop_s", "loop_d", "b"]).take(live)
    n = np.bincount(of[live], minlength=of[-1] + 1)
    place = np.arange(len(live)) - (np.cumsum(n) - n)[of[live]]
    columns = {"v0": new[0], "v1": new[1], "v2": new[2], "loop_s": left["loop_s"], "loop_d": left["loop_d"], "place": place, "n": n[of[live]], "b": left["b"]}
    gap = {True: pa.nulls(new.shape[1], pa.int64()), False: pa.nulls(len(live), pa.int64())}
    join = lambda c, x: pa.concat_arrays([pa.array(x, pa.int64()), gap[False]] if c in ("v0", "v1", "v2") else [gap[True], pa.array(x, pa.int64())])
    return pa.RecordBatch.from_arrays([join(c, np.asarray(x)) for c, x in columns.items()], names=list(columns))


def fill_holes(faces: DataFrame, verts: DataFrame, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(added vertices, added faces) that close every border loop of at most ``max_edges`` edges.

    In each round the ears of a loop (two edges in a row and the side that closes them) that are sharper
    than both ears they overlap are cut at once, which closes loops in rounds by the logarithm of their
    length.  Loops that touch no others twice, and small clusters of such that do, go through these rounds in a task; large ones
    do so as tables.  An ear whose closing side the mesh has already is not cut; what is left of a loop without an
    ear to cut is closed by a fan around a new vertex in its middle.  Added faces have v0, v1 and v2, and v0
    is a vertex of the mesh; added vertices have a vid below 0.  Chains stay open.
    """
    loops = border_loops(faces)
    sizes = loops.groupBy("loop_s", "loop_d").agg(F.count("*").alias("n"), F.min_by("s", "place").alias("begin"), F.max_by("d", "place").alias("end"))
    closed = sizes.where("begin = end and n >= 3")
    if max_edges is not None:
        closed = closed.where(F.col("n") <= max_edges)
    key = ["loop_s", "loop_d"]
    place_of = verts.select(F.col("vid").alias("b"), F.array(*[F.col(c).cast("double") for c in "xyz"]).alias("at"))
    ring = loops.join(closed.select(*key, "n"), key).select(*key, "place", "n", F.col("s").alias("b")).join(place_of, "b")
    # written tables here as well, because checkpoints carry what is known about columns along and planning would slow down with each round
    at = [*key, "block"]
    ring = bucketed(ring.select(*key, F.floor(F.col("place") / BLOCK).alias("block"), "place", "n", F.struct("b", "at").alias("v")), "rings", *at)
    # an ear is closed between vertices of its ring, so sides with another end are never asked for
    sides = edges(faces).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    for c in ("lo", "hi"):
        sides = sides.join(ring.where("n > 3").select(F.col("v.b").alias(c)), c, "left_semi")
    sides = bucketed(sides.select("lo", "hi"), "sides", "lo", "hi")
    clusters, more = _clusters(ring.where("n > 3"))
    closed = stored(_closed(ring.where("n > 3"), sides, clusters), "closed")
    added, brought = closed.where("v0 is not null").select("v0", "v1", "v2"), None
    left = closed.where("v0 is null").select(*key, "place", "n", "b").join(place_of, "b")
    ring = ring.join(clusters.select(*key), key, "left_anti")
    if more:
        ring = bucketed(ring, "rings", *at)
    while more and not ring.where("n > 3").isEmpty():
        ears = _around(ring.where("n > 3"), key, "v").select(*at, "place", "n", *[F.col(x).alias(t) for x, t in (("back", "a"), ("v", "b"), ("on", "c"))])
        # written before they are asked for, as what follows reads them more than once
        ears = bucketed(ears.withColumn("lo", F.least("a.b", "c.b")).withColumn("hi", F.greatest("a.b", "c.b")), "ears", *at)
        asked = ears.select(*at, "place", "lo", "hi")
        taken = asked.join(sides, ["lo", "hi"], "left_semi")
        if brought is not None:
            taken = taken.unionByName(asked.join(brought, ["lo", "hi"], "left_semi"))
        legal = ~F.col("marked") & (F.col("lo") != F.col("hi"))
        rank_of = F.struct(F.when(legal, _angle_cost()).alias("cost"), F.xxhash64("b.b").alias("h"), "place").alias("w")
        ears = _marked(ears, at, taken).select(*at, "place", "n", "lo", "hi", F.col("a.b").alias("v0"), F.col("b.b").alias("v1"), F.col("c.b").alias("v2"), rank_of)
        near = _around(bucketed(ears, "ranks", *at), key, "w")
        beats = lambda o: F.col(f"{o}.cost").isNull() | (F.col("w") < F.col(o))
        cut = near.where(F.col("w.cost").isNotNull() & beats("back") & beats("on"))
        # two ears of one round must not bring the same side, and a ring of four keeps three
        rank = Window.partitionBy("lo", "hi").orderBy(*key, "place")
        four = Window.partitionBy(*key, F.when(F.col("n") > 4, F.col("place"))).orderBy("w")
        cut = cut.withColumn("one", F.row_number().over(rank)).where("one = 1").withColumn("two", F.row_number().over(four)).where("two = 1")
        cut = stored(cut.select(*at, "place", "lo", "hi", "v0", "v1", "v2"), "cut")
        if cut.isEmpty():
            break
        new = cut.select("v0", "v1", "v2")
        added = added.unionByName(new)
        more = cut.select("lo", "hi")
        brought = more if brought is None else stored(brought.unionByName(more), "brought")
        ring = bucketed(_renumbered(_marked(ring, at, cut).where("not marked").drop("marked"), key), "rings", *at)
    ring = ring.select(*key, "place", "n", "v.b", "v.at").unionByName(left)
    fan_of = ring.where("n > 3")
    middle = fan_of.groupBy(*key).agg(*[F.avg(F.col("at")[k]).alias(c) for k, c in enumerate("xyz")])
    centre = stored(middle.select(*key, (-F.abs(F.xxhash64(*key)) - 1).alias("vid"), "x", "y", "z"), "centres")
    ahead = ring.select(*key, ((F.col("place") + F.col("n") - 1) % F.col("n")).alias("place"), F.col("b").alias("c"))
    sides = ring.join(ahead, [*key, "place"])
    fan = sides.where("n > 3").join(centre.select(*key, "vid"), key).select(F.col("b").alias("v0"), F.col("c").alias("v1"), F.col("vid").alias("v2"))
    third = ring.where("n = 3 and place = 2").select(*key, F.col("b").alias("v2"))
    last_face = sides.where("n = 3 and place = 0").join(third, key).select(F.col("b").alias("v0"), F.col("c").alias("v1"), "v2")
    rest = fan.unionByName(last_face)
    return centre.select("vid", "x", "y", "z"), added.unionByName(rest)


def _renumbered(ring: DataFrame, key: list[str]) -> DataFrame:
    """Places from 0 on again and the new size, where some vertices are gone.

    Places are numbered by blocks, which keep their rows: how many are left in a block is counted first, so a
    long loop is not sorted in one task.
    """
    at = [*key, "block"]
    counts = ring.groupBy(*at).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("m").over(Window.partitionBy(*key))
    counts = counts.select(*at, before.alias("base"), total.alias("n"))
    inner = F.row_number().over(Window.partitionBy(*at).orderBy("place")) - 1
    rows = ring.drop("n").withColumn("inner", inner).join(counts, at)
    return rows.select(*at, (F.col("base") + F.col("inner")).alias("place"), "n", "v")
