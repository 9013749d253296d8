"""Exact nearest neighbours: counted cells for points, pivot blocks for vectors.

Neither form lists all pairs.  For points, cell counts bound how far each query must look.  Long vectors are grouped
around pivots in as many leaves as the data needs; a query's own leaf bounds its k-th value, the
triangle inequality says which other leaves it must visit, and one task compares a block of
queries with a block of a leaf and returns at most k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.gridjoin import Axis, box_join, typical_extents
from geoloom.session import checkpoint, spread, stored

#: Points that a query's ball may hold, by the counts, before its radius is made smaller.
CROWD = 4096
#: Levels beyond which a double tells no cells apart.
FINEST = 50
#: Cells that a cell is cut into, at most, when radii are made smaller.
CHILDREN = 64
#: Distinct boxes that the finest cells of a pyramid over boxes hold, at most.
SHAPES = 32


def knn_points(
    queries: DataFrame,
    data: DataFrame,
    qid: str,
    qaxes: Sequence[str],
    did: str,
    daxes: Sequence[str],
    k: int,
    max_dist: float | None = None,
    exclude_same_id: bool = False,
    accept: Column | None = None,
    carry: tuple[Sequence[str], Sequence[str]] = ((), ()),
) -> DataFrame:
    """k nearest data points per query point: (qid, nid, d2, rank), ties by id.

    With ``max_dist`` only points strictly closer count and a query may have fewer
    rows (or none).  ``accept`` is a test on the ``carry`` columns (of queries, of data)
    that a neighbour must pass.  Ids must be unique on their side.

    A pyramid of cell counts tells how far a query must look: the smallest cell around it with enough
    points bounds the k-th distance.  Where a ball of that radius would hold very many points (a query
    far from a dense place), it goes down the pyramid from cell to smaller cells, keeping those that can
    hold a neighbour, until few points are left.  One box join then finds the points in each ball.
    """
    dim = len(qaxes)
    qcarry, dcarry = ([*c] for c in carry)
    q = queries.select(F.col(qid).alias("_qid"), *[F.col(c).alias(f"_q{i}") for i, c in enumerate(qaxes)], *qcarry)
    d = data.select(F.col(did).alias("_nid"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(daxes)], *dcarry)
    daxis = [f"_d{i}" for i in range(dim)]
    qaxis = [f"_q{i}" for i in range(dim)]
    q, d = q.dropna(subset=["_qid", *qaxis]), d.dropna(subset=["_nid", *daxis])
    need = k + int(exclude_same_id)
    # copies of one position (and carried values): the lowest ids are enough
    copies = Window.partitionBy(*daxis, *dcarry).orderBy("_nid")
    d = checkpoint(d.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= need).drop("_copy"))
    b = d.agg(F.count("*").alias("n"), *[f(c) for c in daxis for f in (F.min, F.max)]).first()
    bq = q.agg(F.count("*").alias("n"), *[f(c) for c in qaxis for f in (F.min, F.max)]).first()
    empty = q.select("_qid", F.lit(None).alias("nid"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).limit(0)
    if not b["n"] or not bq["n"]:
        return empty.withColumnRenamed("_qid", qid)
    start = [float(min(b[1 + 2 * i], bq[1 + 2 * i])) for i in range(dim)]
    span = max(float(max(b[2 + 2 * i], bq[2 + 2 * i])) - start[i] for i in range(dim))
    pyramid = _Pyramid.over(d, daxis, start, span if span > 0 else 1.0, b["n"], need)
    far = pyramid.size(0) * dim**0.5
    look = _first_look(q, d, pyramid, need, max_dist)
    d2 = sum(((F.col(a) - F.col(c)) * (F.col(a) - F.col(c)) for a, c in zip(qaxis, daxis)), start=F.lit(0.0))
    settled: DataFrame | None = None
    while look is not None:
        cand = _in_ball(look, d, qaxis, daxis)
        if accept is not None:
            cand = cand.where(accept)
        cand = cand.select("_qid", "_nid", d2.alias("_d2"))
        if exclude_same_id:
            cand = cand.where(F.col("_qid") != F.col("_nid"))
        if max_dist is not None:
            cand = cand.where(F.col("_d2") < F.lit(max_dist * max_dist))
        best = cand.withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy("_d2", "_nid"))).where(F.col("rank") <= k)
        if accept is None:
            settled, look = best, None
            break
        # counts know nothing of the test, so a query that found too few looks four times as far
        best = checkpoint(best)
        count = best.groupBy("_qid").agg(F.count("*").alias("_found"))
        state = look.join(count, "_qid", "left")
        whole = (F.coalesce("_found", F.lit(0)) >= k) | (F.col("_r") >= F.lit(far if max_dist is None else min(far, max_dist)))
        rest = checkpoint(state.where(~whole).select(*look.columns).withColumn("_r", F.col("_r") * 4))
        done = best.join(rest.select("_qid"), "_qid", "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        look = None if rest.isEmpty() else rest
    return settled.select(F.col("_qid").alias(qid), F.col("_nid").alias("nid"), F.col("_d2").alias("d2"), "rank")


class _Pyramid:
    """Grids over one cube: level 0 is a single cell, each next level halves the cells."""

    def __init__(self, start: list[float], span: float, levels: int):
        self.start, self.span, self.levels = start, span * (1 + 1e-9), levels

    @classmethod
    def over(cls, d: DataFrame, axes: Sequence[str], start: list[float], span: float, rows: int, need: int, crowd: int = CROWD // 16, more: int = 8) -> _Pyramid:
        """Levels down to cells without a crowd.

        Where points were spread evenly, the finest cells would hold few; for dense places levels are
        added eight at a time, or ``more``, which takes one or two counts for most data.
        """
        levels = math.ceil(math.log2(max(1.0, rows / need)) / len(start)) + 2
        while True:
            out = cls(start, span, levels)
            most = d.groupBy(*out.cells(axes)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if most <= crowd or levels >= FINEST:
                return out
            levels = min(levels + more, FINEST)

    def size(self, level: int) -> float:
        return self.span / 2.0**level

    def cells(self, cols: Sequence[str]) -> list[Column]:
        """Cell numbers at the finest level."""
        return [F.floor((F.col(c) - F.lit(o)) / F.lit(self.size(self.levels))).cast("bigint") for c, o in zip(cols, self.start)]

    def at_levels(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        """A row per level, with the cell numbers ``_c0``.. there."""
        named = df.withColumns({f"_c{i}": c for i, c in enumerate(self.cells(cols))}) if cols else df
        deep = named.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(self.levels))))
        return deep.withColumns({f"_c{i}": F.expr(f"shiftright(_c{i}, {self.levels} - _level)") for i in range(len(self.start))})


def _first_look(q: DataFrame, d: DataFrame, pyramid: _Pyramid, need: int, max_dist: float | None) -> DataFrame:
    """Queries with a radius ``_r`` within which their k-th neighbour is."""
    dim = len(pyramid.start)
    keys = [f"_c{i}" for i in range(dim)]
    qaxis, daxis = [f"_q{i}" for i in range(dim)], [f"_d{i}" for i in range(dim)]
    fine = d.groupBy(*[c.alias(k) for k, c in zip(keys, pyramid.cells(daxis))]).agg(F.count("*").alias("_n"))
    counts = checkpoint(pyramid.at_levels(fine, []).groupBy("_level", *keys).agg(F.sum("_n").alias("_n")))
    enough = counts.where(F.col("_n") >= need)
    own = pyramid.at_levels(q.select("_qid", *qaxis), qaxis).join(enough, ["_level", *keys])
    known = own.groupBy("_qid").agg(F.max("_level").alias("_at"), F.map_from_entries(F.collect_list(F.struct("_level", "_n"))).alias("_held"))
    crowd = F.coalesce(F.element_at("_held", F.greatest(F.col("_at") - 1, F.lit(0))), F.lit(0))
    radius = F.lit(pyramid.size(0) * dim**0.5) / F.pow(F.lit(2.0), F.coalesce("_at", F.lit(0)))
    if max_dist is not None:
        radius = F.least(radius, F.lit(float(max_dist)))
    look = checkpoint(q.join(known, "_qid", "left").select(*q.columns, radius.alias("_r"), F.coalesce(crowd, F.lit(0)).alias("_crowd")))
    crowded = look.where(F.col("_crowd") > CROWD).drop("_crowd")
    if crowded.isEmpty():
        return look.drop("_crowd")
    smaller = _descend(crowded.select("_qid", *qaxis, "_r"), counts, pyramid, need)
    found = crowded.join(smaller, "_qid", "left").withColumn("_r", F.coalesce("_new", "_r")).drop("_new")
    return look.where(F.col("_crowd") <= CROWD).drop("_crowd").unionByName(found)


def _descend(rest: DataFrame, counts: DataFrame, pyramid: _Pyramid, need: int) -> DataFrame:
    """(_qid, _new): smaller radii, from cells that are cut and dropped level by level.

    All points of a cell are at least as near as its far corner: in the order of far corners, the cell
    that completes the needed number bounds the k-th distance.  Cells whose near corner is further go.
    A query is done when the cells it keeps hold few points.
    """
    dim = len(pyramid.start)
    keys = [f"_c{i}" for i in range(dim)]
    step = max(1, int(math.log2(CHILDREN)) // dim)
    state, level, done = rest.withColumns({c: F.lit(0).cast("bigint") for c in keys}), 0, None
    while level < pyramid.levels:
        deeper = min(level + step, pyramid.levels)
        kids = counts.where(F.col("_level") == deeper).select(
            *[F.expr(f"shiftright({c}, {deeper - level})").alias(c) for c in keys], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_n"
        )
        near, far, size = [], [], F.lit(pyramid.size(deeper))
        for i, start in enumerate(pyramid.start):
            low = F.lit(start) + F.col(f"_k{i}") * size - F.col(f"_q{i}")
            high = low + size
            near.append(F.pow(F.greatest(low, -high, F.lit(0.0)), 2))
            far.append(F.pow(F.greatest(F.abs(low), F.abs(high)), 2))
        # a little to either side, as cell borders are rounded
        corner = lambda terms, by: F.sqrt(sum(terms, start=F.lit(0.0))) * by
        met = state.join(kids, keys).withColumns({"_near": corner(near, 1 - 1e-9), "_far": corner(far, 1 + 1e-9)}).where(F.col("_near") <= F.col("_r"))
        mine = Window.partitionBy("_qid")
        upto = F.sum("_n").over(mine.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_upto", upto).withColumn("_new", F.min(F.when(F.col("_upto") >= need, F.col("_far"))).over(mine))
        met = met.withColumn("_r", F.least("_r", "_new")).where(F.col("_near") <= F.col("_r"))
        met = checkpoint(met.withColumn("_left", F.sum("_n").over(mine)).drop(*keys, "_near", "_far", "_upto", "_new"))
        level = deeper
        few = (F.col("_left") <= CROWD) | F.lit(level == pyramid.levels)
        settled = met.where(few).groupBy("_qid").agg(F.min("_r").alias("_new"))
        done = settled if done is None else done.unionByName(settled)
        state = met.where(~few).withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keys)}).drop("_n", "_left")
        if state.isEmpty():
            break
    return done


def _in_ball(look: DataFrame, d: DataFrame, qaxis: Sequence[str], daxis: Sequence[str]) -> DataFrame:
    """Pairs of queries and points within the radius, a hair more for rounding."""
    reach = F.col("_r") * (1 + 1e-9) + 1e-12
    axes, gaps = [], []
    probe = look
    for i, (a, c) in enumerate(zip(qaxis, daxis)):
        slack = F.abs(F.col(a)) * 1e-15
        probe = probe.withColumn(f"_ql{i}", F.col(a) - reach - slack).withColumn(f"_qh{i}", F.col(a) + reach + slack)
        gaps.append((F.col(a) - F.col(c)) * (F.col(a) - F.col(c)))
    cells = typical_extents(probe, *[(f"_ql{i}", f"_qh{i}") for i in range(len(qaxis))])
    axes = [Axis(f"_ql{i}", f"_qh{i}", c, c, cell) for i, (c, cell) in enumerate(zip(daxis, cells))]
    return box_join(probe, d, axes, sum(gaps, start=F.lit(0.0)) <= reach * reach * (1 + 1e-9))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 1))


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared distance ("l2") or negative dot product ("dot"), all rows of a by b."""
    if metric == "dot":
        return -(a @ b.T)
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for lo in range(0, len(a), step):
        diff = a[lo : lo + step, None, :] - b[None, :, :]
        out[lo : lo + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def _quick(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The same by a matrix product, and how far each row of it may be off."""
    if metric == "dot":
        return -(a @ b.T), np.zeros((len(a), 1))
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)
    return aa + bb - 2.0 * (a @ b.T), 1e-12 * (aa + bb.max(initial=0.0)) * a.shape[1]


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    out = np.empty(len(row))
    step = max(1, (1 << 20) // max(1, a.shape[1]))
    for lo in range(0, len(row), step):
        diff = a[row[lo : lo + step]] - b[col[lo : lo + step]]
        out[lo : lo + step] = np.einsum("ij,ij->i", diff, diff)
    return out


def _best(a: np.ndarray, b: np.ndarray, ids: tuple[np.ndarray, np.ndarray] | None, k: int, metric: str, limit: np.ndarray | None, count: float | None = None):
    """(row, column, value) of the k best columns of each row, ties by column, sorted by row and value; and,
    with ``count``, how many columns of each row have a value up to it.

    Pairs of equal ``ids`` do not take part; ``limit`` is the largest value of interest for each row.
    """
    quick, off = _quick(a, b, metric)
    if ids is not None:
        mine, theirs = ids
        hit = np.flatnonzero(np.isin(mine, theirs))
        if len(hit):
            row, col = np.nonzero(mine[hit, None] == theirs[None, :])
            quick[hit[row], col] = np.inf
    total = None
    if count is not None:
        sure = quick <= count - off
        total = sure.sum(1)
        row, col = np.nonzero(~sure & (quick <= count + off))  # too close to tell by the product
        if len(row):
            total += np.bincount(row[_exact(a, b, row, col) <= count], minlength=len(a))
    # what takes no part is infinite, and so may a limit be
    open_ = np.isfinite(quick) if limit is None else quick <= np.minimum(limit[:, None] + off, np.finfo(float).max)
    row, col = np.nonzero(open_)
    if quick.shape[1] > k and len(row) > 4 * k * len(a):
        quick[~open_] = np.inf
        cut = np.partition(quick, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero((quick <= cut + 2 * off) & open_)
    value = quick[row, col] if metric == "dot" else _exact(a, b, row, col)  # few are left, and they get their exact value
    if limit is not None:
        inside = value <= limit[row]
        row, col, value = row[inside], col[inside], value[inside]
    return (*_first(row, col, value, k), total)


def _first(row: np.ndarray, col: np.ndarray, value: np.ndarray, k: int):
    """The k lowest values of each row, ties by column, sorted by row and value."""
    order = np.lexsort((col, value, row))
    row, col, value = row[order], col[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[keep], col[keep], value[keep]


def _bounds(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray, metric: str):
    """Lowest and highest possible value from each query to the rows of each cell."""
    if metric == "dot":
        mid = -(q @ pivots.T)
        slack = np.linalg.norm(q, axis=1)[:, None] * radius[None, :]
        return mid - slack, mid + slack
    dist = np.sqrt(_distance(q, pivots, "l2"))
    return np.maximum(dist - radius, 0.0) ** 2, (dist + radius) ** 2


def _nearest(vec: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row, the first of equal ones, and its distance."""
    d2 = _distance(vec, pivots, "l2")
    at = d2.argmin(axis=1)
    return at, np.sqrt(d2[np.arange(len(vec)), at])


#: Rows of a leaf, about; and leaves up to which one level of pivots is enough.
LEAF_ROWS = 2048
ONE_LEVEL = 256
#: Rows that are placed or routed together.
CHUNK = 8192
#: Queries, and data rows, that one task of a sweep compares, about; and entries of a matrix it works on at once.
BLOCK = 32768
ENTRIES = 1 << 20


class _Tree:
    """Data vectors in leaves around pivots; the number of leaves grows with the data.

    One level of pivots is known to every task while there are few leaves.  Beyond, the top pivots grow
    with the square root of the leaves, and each top cell has pivots of its own, which are a table and
    meet rows and queries by joins.  A leaf's rows lie within ``radius`` of its pivot.
    """

    def __init__(self, data: DataFrame, n: int, leaf_rows: int):
        self.leaves_n = max(1, -(-n // leaf_rows))
        self.leaf_rows = leaf_rows
        self.deep = self.leaves_n > ONE_LEVEL
        self.leaves: DataFrame | None = None
        if self.leaves_n == 1:
            self.rows = checkpoint(spread(data)).withColumns({"_leaf": F.lit(0).cast("bigint"), "_far": F.lit(0.0)})
            return
        tops = math.isqrt(self.leaves_n - 1) + 1 if self.deep else self.leaves_n
        picked = data.select("_nid", "_v").orderBy(F.xxhash64("_nid"), "_nid").limit(tops).collect()  # as many as there are tops
        self.tops = np.array([r["_v"] for r in picked], dtype=np.float64)
        kind = data.schema["_nid"].dataType.simpleString()
        tops_ = self.tops

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    at, far = _nearest(_matrix(pdf["_v"]), tops_)
                    yield pdf.assign(_top=at.astype("int64"), _far=far)

        schema = f"_nid {kind}, _v array<double>, _top bigint, _far double"
        self.rows = checkpoint(spread(data).mapInPandas(place, schema)).withColumnRenamed("_top", "_leaf")
        stats = self.rows.groupBy("_leaf").agg(F.count("*").alias("n"), F.max("_far").alias("far")).collect()  # one per top
        self.size, self.radius = np.zeros(len(self.tops), np.int64), np.zeros(len(self.tops))
        for r in stats:
            self.size[r["_leaf"]], self.radius[r["_leaf"]] = r["n"], r["far"] * (1 + 1e-9)
        if self.deep:
            self._split(kind)

    def _blocks(self) -> Column:
        """Blocks that the rows of a top cell are dealt to."""
        return F.get(F.array(*[F.lit(int(max(1, -(-c // CHUNK)))) for c in self.size]), F.col("_top").cast("int"))

    def _split(self, kind: str) -> None:
        """Cut the top cells into leaves around sampled rows."""
        rows = self.rows.withColumnRenamed("_leaf", "_top").drop("_far")
        share = int(2**31 / self.leaf_rows)
        picked = rows.where(F.pmod(F.xxhash64("_nid", F.lit("sub")), F.lit(2**31)) < share).select("_top", "_v")
        own = rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(self.tops)], "_top long, _v array<double>")
        subs = own.unionByName(picked).withColumn("_sub", F.row_number().over(Window.partitionBy("_top").orderBy(F.xxhash64("_v"))) - 1)
        subs = checkpoint(subs.select("_top", F.col("_top") * (1 << 20) + F.col("_sub"), F.col("_v").alias("_pv")).toDF("_top", "_leaf", "_pv"))

        def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"_nid": [], "_v": [], "_leaf": [], "_far": []})
            at, far = _nearest(_matrix(left["_v"]), _matrix(right["_pv"]))
            return pd.DataFrame({"_nid": left["_nid"], "_v": left["_v"], "_leaf": right["_leaf"].to_numpy()[at], "_far": far})

        dealt = rows.withColumn("_b", F.pmod(F.xxhash64("_nid"), self._blocks()))
        every = subs.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), self._blocks().cast("bigint") - 1)))
        placed = dealt.groupBy("_top", "_b").cogroup(every.groupBy("_top", "_b")).applyInPandas(place, f"_nid {kind}, _v array<double>, _leaf bigint, _far double")
        self.rows = checkpoint(placed)
        own_size = self.rows.groupBy("_leaf").agg(F.count("*").alias("_n"), (F.max("_far") * (1 + 1e-9)).alias("_radius"), F.min("_nid").alias("_any"))
        self.leaves = checkpoint(subs.join(own_size, "_leaf"))

    def sizes(self) -> DataFrame:
        return self.rows.groupBy("_leaf").agg(F.count("*").alias("_n"))

    def home(self, queries: DataFrame, kind: str) -> DataFrame:
        """Queries with the leaf whose pivot is near."""
        tops, some = self.tops, np.flatnonzero(self.size)

        def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(_leaf=some[_nearest(_matrix(pdf["_v"]), tops[some])[0]].astype("int64"))

        schema = f"_qid {kind}, _v array<double>, _leaf bigint"
        near = queries.mapInPandas(top, schema)
        if not self.deep:
            return near

        def sub(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"_qid": [], "_v": [], "_leaf": []})
            at, _ = _nearest(_matrix(left["_v"]), _matrix(right["_pv"]))
            return pd.DataFrame({"_qid": left["_qid"], "_v": left["_v"], "_leaf": right["_leaf"].to_numpy()[at]})

        return self._with_leaves(near.withColumnRenamed("_leaf", "_top"), sub, schema)

    def _with_leaves(self, queries: DataFrame, run, schema: str) -> DataFrame:
        """Cogroup queries, dealt to blocks, with the leaves of their top cell."""
        load = checkpoint(queries)
        counts = load.groupBy("_top").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("bigint").alias("_nb"))
        dealt = load.join(counts, "_top").withColumn("_b", F.pmod(F.xxhash64("_qid"), F.col("_nb"))).drop("_nb")
        every = self.leaves.join(counts, "_top").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1))).drop("_nb")
        return dealt.groupBy("_top", "_b").cogroup(every.groupBy("_top", "_b")).applyInPandas(run, schema)

    def bounded(self, queries: DataFrame, kind: str, metric: str, need: int) -> DataFrame:
        """(_qid, _v, _home, _cap, _theta, _sure): queries with a value that bounds their ``need``-th.

        A query whose home leaf was too small has no value yet; the counts and bounds of the top cells give
        it one, which is not ``_sure`` to be that of a row.
        """
        tops, radius, size = self.tops, self.radius, self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                theta = pdf["_theta"].to_numpy(dtype=float)
                sure, bound = np.isfinite(theta), np.empty(len(pdf))
                vec = _matrix(pdf["_v"])
                for lo in range(0, len(pdf), max(1, ENTRIES // len(tops))):
                    some = slice(lo, lo + max(1, ENTRIES // len(tops)))
                    low, high = _bounds(vec[some], tops, radius, metric)
                    order = np.argsort(high, axis=1, kind="stable")
                    upto = (np.cumsum(size[order], axis=1) < need).sum(axis=1)  # the cell that completes the needed rows
                    bound[some] = np.take_along_axis(high, order, 1)[np.arange(len(low)), upto]
                yield pdf[["_qid", "_v", "_home", "_cap"]].assign(_theta=np.minimum(np.where(sure, theta, np.inf), bound), _sure=sure)

        return queries.mapInPandas(run, f"_qid {kind}, _v array<double>, _home bigint, _cap double, _theta double, _sure boolean")

    def reach(self, metric: str, eps: float, ceiling: float | None):
        """Test of queries (vectors, theta, sure, home) against leaves (numbers, pivots, radii): (seen, lowest value).

        The leaf whose number is ``home`` is always seen.  Without a second level the tops are the leaves.
        """
        tops, radius, size, deep = self.tops, self.radius, self.size, self.deep

        def keep_low(low: np.ndarray, theta: np.ndarray, sure: np.ndarray) -> np.ndarray:
            slack = np.where(sure, (1.0 + eps) ** 2 if metric == "l2" else 1.0, 1.0)
            keep = low * slack[:, None] <= theta[:, None]
            return keep if ceiling is None else keep & (low <= ceiling)

        def run(vec, theta, sure, home, leaf, pivots, radii) -> tuple[np.ndarray, np.ndarray]:
            top = np.unique(leaf >> 20) if deep else leaf
            low, _ = _bounds(vec, tops[top], radius[top], metric)
            low[:, size[top] == 0] = np.inf
            keep = keep_low(low, theta, sure) | ((home >> 20 if deep else home)[:, None] == top)
            if not deep:
                return keep, low
            low, _ = _bounds(vec, pivots, radii, metric)
            return keep[:, np.searchsorted(top, leaf >> 20)] & (keep_low(low, theta, sure) | (home[:, None] == leaf)), low

        return run

    def nearest_leaves(self, queries: DataFrame, kind: str, metric: str, eps: float, ceiling: float | None, rows: int) -> DataFrame:
        """(_qid, _v, _leaf, _low, _n): of the leaves that a query must see, the nearest ones that hold ``rows`` together."""
        reach = self.reach(metric, eps, ceiling)
        schema = f"_qid {kind}, _v array<double>, _leaf bigint, _low double, _n bigint"

        def nearest(pdf: pd.DataFrame, leaf: np.ndarray, pivots, radii, size: np.ndarray) -> Iterator[pd.DataFrame]:
            vec, step = _matrix(pdf["_v"]), max(1, ENTRIES // max(1, len(leaf)))
            theta, sure, home = (pdf[c].to_numpy() for c in ("_theta", "_sure", "_home"))
            for lo in range(0, len(pdf) if len(leaf) else 0, step):
                some = slice(lo, lo + step)
                seen, low = reach(vec[some], theta[some], sure[some], home[some], leaf, pivots, radii)
                order = np.argsort(np.where(seen, low, np.inf), axis=1, kind="stable")
                held = np.where(np.take_along_axis(seen, order, 1), size[order], 0)
                row, at = np.nonzero((np.cumsum(held, axis=1) - held < rows) & (held > 0))
                one, cell = pdf.iloc[lo + row], order[row, at]
                yield pd.DataFrame({"_qid": one["_qid"].to_numpy(), "_v": one["_v"].to_numpy(), "_leaf": leaf[cell], "_low": low[row, cell], "_n": size[cell]})

        if self.deep:

            def sub(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                right = right.sort_values("_leaf", kind="stable")
                parts = [*nearest(left, right["_leaf"].to_numpy(), _matrix(right["_pv"]), right["_radius"].to_numpy(), right["_n"].to_numpy())] if len(right) else []
                return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("_qid", "_v", "_leaf", "_low", "_n")})

            blocks, load = max(1, self.leaves_n // BLOCK), checkpoint(queries)
            dealt = max(load.sparkSession.sparkContext.defaultParallelism, -(-load.count() // CHUNK))
            ask = load.withColumn("_b", F.pmod(F.xxhash64("_qid", "_v"), F.lit(dealt))).withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            own = self.leaves.withColumn("_c", F.pmod(F.xxhash64("_leaf"), F.lit(blocks)).cast("int"))
            own = own.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(dealt - 1).cast("bigint"))))
            seen = ask.groupBy("_b", "_c").cogroup(own.groupBy("_b", "_c")).applyInPandas(sub, schema)
        else:
            leaf = np.flatnonzero(self.size)
            size = self.size

            def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    yield from nearest(pdf, leaf, None, None, size[leaf])

            seen = queries.mapInPandas(top, schema)
        before = F.sum("_n").over(Window.partitionBy("_qid").orderBy("_low", "_leaf").rowsBetween(Window.unboundedPreceding, -1))
        return seen.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < rows).drop("_before")


def _at_heads(row: np.ndarray, total: np.ndarray | None) -> np.ndarray:
    """The total of each row at its first place, else zero."""
    out = np.zeros(len(row), np.int64)
    if total is not None and len(row):
        head = np.concatenate(([True], row[1:] != row[:-1]))
        out[head] = total[row[head]]
    return out


def _slack(theta: np.ndarray) -> np.ndarray:
    """A bound on the k-th value, a hair more for rounding."""
    return theta + np.abs(theta) * 1e-9 + 1e-9


def _sweep(queries: DataFrame, tree: _Tree, rows: int, types: tuple[str, str], k: int, metric: str, eps: float, max_value: float | None, exclude_same_id: bool, count_all: bool) -> DataFrame:
    """(_qid, _nid, _val, _in): the k best rows of each block of data for each query (_qid, _v, _home, _cap, _theta, _sure).

    Queries and data are dealt to blocks, leaves as a whole where they are not large, and every block of one meets
    every block of the other.  Which leaves of its block a query must see is found in the task, so no list of
    queries and leaves is written, and a vector travels once for each block of the other side.  ``_cap`` is a value that k rows are known to keep within.
    """
    q_type, d_type = types
    spark, asked = queries.sparkSession, queries.count()
    side = math.isqrt(4 * spark.sparkContext.defaultParallelism - 1) + 1
    nd, nq = (max(-(-n // BLOCK), min(side, -(-n // 256)), 1) for n in (rows, asked))
    piece = max(64, min(CHUNK, rows // (2 * nd)))
    sizes = stored(tree.sizes().select("_leaf", F.ceil(F.col("_n") / F.lit(piece)).cast("bigint").alias("_np")), "leaves")
    block = F.pmod(F.xxhash64("_leaf", "_p"), F.lit(nd)).cast("int").alias("_db")
    ds = tree.rows.join(sizes, "_leaf").withColumn("_p", F.pmod(F.xxhash64("_nid"), F.col("_np"))).select("_nid", "_v", "_leaf", F.lit(-1.0).alias("_r"), block)
    if tree.deep:  # a pivot goes with the rows of its leaf, told by its radius
        own = tree.leaves.join(sizes, "_leaf").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_np") - 1)))
        ds = ds.unionByName(own.select(F.col("_any").alias("_nid"), F.col("_pv").alias("_v"), "_leaf", F.col("_radius").alias("_r"), block))
    ds = ds.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    qs = queries.withColumn("_qb", F.pmod(F.xxhash64("_qid", "_v"), F.lit(nq)).cast("int")).withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(nd - 1))))
    q_dtype, d_dtype = ("object" if t == "string" else "int64" for t in (q_type, d_type))
    reach, deep = tree.reach(metric, eps, max_value) if tree.leaves_n > 1 else None, tree.deep
    tops, radius = (tree.tops, tree.radius) if reach else (None, None)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, totals = [], np.zeros(len(left), np.int64)
        pivots = right[right["_r"] >= 0].drop_duplicates("_leaf").sort_values("_leaf") if deep else None
        right = right[right["_r"] < 0].sort_values("_nid", kind="stable")  # columns ascend by id: ties by id
        qids, nids = left["_qid"].to_numpy(), right["_nid"].to_numpy()
        if len(left) and len(right):
            theirs, mine = _matrix(right["_v"]), _matrix(left["_v"])
            by_leaf = np.argsort(right["_leaf"].to_numpy(), kind="stable")
            leaf, first = np.unique(right["_leaf"].to_numpy()[by_leaf], return_index=True)
            member = np.split(by_leaf, first[1:])
            if deep:
                own = (_matrix(pivots["_v"]), pivots["_r"].to_numpy())
                leaf_at = np.searchsorted(pivots["_leaf"].to_numpy(), leaf)
                own = tuple(v[leaf_at] for v in own)
            else:
                own = (tops, radius)
            theta, sure, home = (left[c].to_numpy() for c in ("_theta", "_sure", "_home"))
            limit = _slack(left["_cap"].to_numpy())
            if max_value is not None:
                limit = np.minimum(limit, max_value)
            step = max(1, min(2048, ENTRIES // len(leaf)))
            for lo in range(0, len(left), step):
                some = slice(lo, lo + step)
                seen = reach(mine[some], theta[some], sure[some], home[some], leaf, *own)[0] if reach else np.ones((len(mine[some]), 1), bool)
                step_found = []
                for j, cols in enumerate(member):
                    at = lo + np.flatnonzero(seen[:, j])
                    wide = max(1, ENTRIES // len(cols))
                    for start in range(0, len(at), wide):
                        part = at[start : start + wide]
                        ids = (qids[part], nids[cols]) if exclude_same_id else None
                        row, col, value, total = _best(mine[part], theirs[cols], ids, k, metric, limit[part], max_value if count_all else None)
                        step_found.append((part[row], cols[col], value))
                        if count_all:
                            totals[part] += total
                if step_found:
                    found.append(_first(*(np.concatenate(c) for c in zip(*step_found)), k))
        row, col, value = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        columns = (qids[row], nids[col], value, _at_heads(row, totals))
        return pd.DataFrame({n: pd.Series(c, dtype=t) for n, c, t in zip(("_qid", "_nid", "_val", "_in"), columns, (q_dtype, d_dtype, "float64", "int64"))})

    keys, tasks = ["_qb", "_db"], 2 * nq * nd
    return qs.repartition(tasks, *keys).groupBy(*keys).cogroup(ds.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(run, f"_qid {q_type}, _nid {d_type}, _val double, _in bigint")


def _compare(seen: DataFrame, tree: _Tree, types: tuple[str, str], k: int, metric: str, max_value: float | None, exclude_same_id: bool, count_all: bool) -> DataFrame:
    """(_qid, _nid, _val, _in): the k best rows of each leaf for each query that sees it, block by block.

    For lists of a few leaves per query, each of which brings the query's vector.
    """
    q_type, d_type = types
    sizes = tree.sizes().join(seen.groupBy("_leaf").agg(F.count("*").alias("_m")), "_leaf")
    sizes = checkpoint(sizes.select("_leaf", *[F.ceil(F.col(c) / F.lit(CHUNK)).cast("bigint").alias(n) for c, n in (("_n", "_nd"), ("_m", "_nq"))]))
    zero = F.lit(0).cast("bigint")
    ds = tree.rows.drop("_far").join(sizes, "_leaf").withColumn("_db", F.pmod(F.xxhash64("_nid"), F.col("_nd")))
    ds = ds.withColumn("_qb", F.explode(F.sequence(zero, F.col("_nq") - 1))).drop("_nd", "_nq")
    qs = seen.select("_qid", "_v", "_leaf").join(sizes, "_leaf").withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_nq")))
    qs = qs.withColumn("_db", F.explode(F.sequence(zero, F.col("_nd") - 1))).drop("_nd", "_nq")
    q_dtype, d_dtype = ("object" if t == "string" else "int64" for t in (q_type, d_type))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("_nid", kind="stable")  # columns ascend by id: ties by id
            nids, qids = right["_nid"].to_numpy(), left["_qid"].to_numpy()
            mine, theirs = _matrix(left["_v"]), _matrix(right["_v"])
            step = max(1, ENTRIES // len(theirs))
            for lo in range(0, len(mine), step):
                part, ids = mine[lo : lo + step], qids[lo : lo + step]
                limit = None if max_value is None else np.full(len(part), max_value)
                row, col, value, total = _best(part, theirs, (ids, nids) if exclude_same_id else None, k, metric, limit, max_value if count_all else None)
                out.append((ids[row], nids[col], value, _at_heads(row, total)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], [], []]
        return pd.DataFrame({n: pd.Series(c, dtype=t) for n, c, t in zip(("_qid", "_nid", "_val", "_in"), columns, (q_dtype, d_dtype, "float64", "int64"))})

    keys = ["_leaf", "_db", "_qb"]
    return qs.groupBy(*keys).cogroup(ds.groupBy(*keys)).applyInPandas(compare, f"_qid {q_type}, _nid {d_type}, _val double, _in bigint")


def knn_vectors(
    queries: DataFrame,
    data: DataFrame,
    k: int,
    qid: str = "qid",
    qvec: str = "qvec",
    did: str = "did",
    dvec: str = "dvec",
    metric: str = "l2",
    max_value: float | None = None,
    exclude_same_id: bool = False,
    eps: float = 0.0,
    max_visited: int | None = None,
    block_rows: int | None = None,
    count_in_range: bool = False,
) -> DataFrame:
    """k best data vectors per query: (qid, nid, value, rank), ties by id.

    ``value`` is the squared distance or, for "dot", the negative dot product.
    ``max_value`` keeps values at most that large and, with ``count_in_range``, adds
    ``n_in_range`` over all matches, not only the k returned.  ``eps`` (distances only) allows results
    (1 + eps) times farther than the exact ones; ``max_visited`` stops a query after
    so many compared rows, nearest leaves first, as the approximate search it models does.

    A query is compared with the leaf it falls into, which bounds its k-th value, and then only with
    the leaves that can hold something better.
    """
    if eps and metric != "l2":
        raise ValueError("eps is a factor on distances; it has no meaning for dot products")
    n = data.count()
    need = k + int(exclude_same_id)
    if n < need:
        raise ValueError(f"k={k} needs more rows than the {n} available")
    types = tuple(df.schema[c].dataType.simpleString() for df, c in ((queries, qid), (data, did)))
    q = checkpoint(spread(queries.select(F.col(qid).alias("_qid"), F.col(qvec).cast("array<double>").alias("_v"))))
    tree = _Tree(data.select(F.col(did).alias("_nid"), F.col(dvec).cast("array<double>").alias("_v")), n, block_rows or LEAF_ROWS)
    everything = q.withColumns({"_cap": F.lit(math.inf), "_home": F.lit(0).cast("bigint"), "_theta": F.lit(math.inf), "_sure": F.lit(False)})
    if tree.leaves_n == 1 or count_in_range and max_visited is None:  # all that is in range counts, so only the range bounds
        known = everything
    elif count_in_range:
        known = tree.bounded(everything, types[0], metric, n)
    else:
        home = checkpoint(tree.home(q, types[0]))
        near = _compare(home, tree, types, need, metric, None, False, False)
        other = F.when(F.col("_qid") != F.col("_nid"), F.col("_val")) if exclude_same_id else F.col("_val")
        kth = {"_theta": (F.col("_val"), need), "_cap": (other, k)}
        near = near.groupBy("_qid").agg(*[F.get(F.array_sort(F.collect_list(v)), F.lit(i - 1)).alias(c) for c, (v, i) in kth.items()])
        known = home.join(near, "_qid", "left").select("_qid", "_v", F.col("_leaf").alias("_home"), *[F.coalesce(c, F.lit(math.inf)).alias(c) for c in kth])
        known = checkpoint(tree.bounded(known, types[0], metric, need))
    if max_visited is None or tree.leaves_n == 1:
        part = _sweep(known, tree, n, types, k, metric, eps, max_value, exclude_same_id, count_in_range)
    else:
        seen = checkpoint(tree.nearest_leaves(known, types[0], metric, eps, max_value, max_visited))
        part = _compare(seen, tree, types, k, metric, max_value, exclude_same_id, count_in_range)
    extra = []
    if count_in_range:
        part = checkpoint(part)
        totals = part.groupBy("_qid").agg(F.sum("_in").alias("n_in_range"))
        extra = ["n_in_range"]
    top = part.withColumn("rank", F.row_number().over(Window.partitionBy("_qid").orderBy("_val", "_nid"))).where(F.col("rank") <= k)
    if count_in_range:
        top = top.join(totals, "_qid")
    return top.select(F.col("_qid").alias(qid), F.col("_nid").alias("nid"), F.col("_val").alias("value"), "rank", *extra)


def nearest_boxes(
    boxes: DataFrame,
    lows: Sequence[str],
    highs: Sequence[str],
    point: Sequence[float],
    k: int,
    distance: Column | None = None,
) -> DataFrame:
    """k nearest boxes to one point with every tie at the k-th distance (column d2).

    ``distance`` replaces the squared distance to the box by any other expression.

    The k-th distance comes from a bounded top-k; the second pass is a filter, so no
    global window is needed.
    """
    gap = [F.greatest(F.col(lo) - F.lit(p), F.lit(p) - F.col(hi), F.lit(0.0)) for lo, hi, p in zip(lows, highs, point)]
    d2 = sum((g * g for g in gap), start=F.lit(0.0))
    with_d = boxes.withColumn("d2", d2 if distance is None else distance)
    kth = [r[0] for r in with_d.select("d2").orderBy("d2").limit(k).collect()]  # k numbers
    if not kth:
        return with_d.limit(0)
    return with_d.where(F.col("d2") <= F.lit(kth[-1]))


def nearest_boxes_join(
    queries: DataFrame, boxes: DataFrame, qid: str, qaxes: Sequence[str], bid: str, lows: Sequence[str], highs: Sequence[str], k: int
) -> DataFrame:
    """k nearest boxes of every query point with every tie at the k-th distance: (qid, bid, d2, rank).

    A box is a point of twice the axes, its lows and its highs, and a pyramid of cells over these knows the bounds and
    the number of its boxes.  Every query goes down the pyramid from cell to smaller cells: what all boxes of a
    cell are at most away bounds the k-th distance, and cells that are further go.  Equal boxes take part once.
    """
    ends, qaxis = [f"_b{i}" for i in range(2 * len(lows))], [f"_q{i}" for i in range(len(qaxes))]
    side = boxes.select(F.col(bid).alias("_bid"), *[F.col(c).cast("double").alias(e) for c, e in zip([*lows, *highs], ends)]).dropna(subset=ends)
    q = queries.select(F.col(qid).alias("_id"), *[F.col(c).alias(a) for c, a in zip(qaxes, qaxis)]).dropna()
    q = checkpoint(q.withColumn("_qid", F.monotonically_increasing_id()))  # rows with the same id each have their own way down
    shapes = stored(side.groupBy(*ends).agg(F.count("*").alias("_n")), "boxes")
    facts = shapes.agg(F.count("*").alias("n"), *[f(c) for c in ends for f in (F.min, F.max)]).first()
    if not facts["n"]:
        return queries.join(boxes, F.lit(False)).select(qid, bid, F.lit(0.0).alias("d2"), F.lit(0).alias("rank"))
    start = [facts[1 + 2 * i] for i in range(len(ends))]
    span = max(facts[2 + 2 * i] - low for i, low in enumerate(start))
    pyramid = _Pyramid.over(shapes, ends, start, span if span > 0 else 1.0, facts["n"], k, SHAPES, 2)
    found = _near_shapes(q, shapes, ends, pyramid, k)
    near = side.join(found, ends).select(F.col("_qid"), F.col("_id").alias(qid), F.col("_bid").alias(bid), "d2")
    ranked = near.withColumn("rank", F.rank().over(Window.partitionBy(qid).orderBy("d2")))
    return ranked.where(F.col("rank") <= k).select(qid, bid, "d2", "rank")


def _gaps(axes: Sequence[str], lows: Sequence[Column], highs: Sequence[Column]) -> Column:
    """Squared distance to a box; rounding keeps the order of its terms, so bounds hold to the last bit."""
    gap = [F.greatest(lo - F.col(c), F.col(c) - hi, F.lit(0.0)) for c, lo, hi in zip(axes, lows, highs)]
    return sum((g * g for g in gap), start=F.lit(0.0))


def _near_shapes(q: DataFrame, shapes: DataFrame, ends: list[str], pyramid: _Pyramid, k: int) -> DataFrame:
    """(_qid, _id, ends, d2): the distinct boxes up to the k-th distance of each query, by the cells that can hold them."""
    dim = len(ends) // 2
    keys, qaxis = [f"_c{i}" for i in range(len(ends))], [f"_q{i}" for i in range(dim)]
    placed = stored(shapes.withColumns(dict(zip(keys, pyramid.cells(ends)))), "placed")
    bounds = lambda lo, hi: [f(c).alias(f"{t}{i}") for i, pair in enumerate(zip(lo, hi)) for t, f, c in (("_lo", F.min, pair[0]), ("_hi", F.max, pair[1]))]
    fine = placed.groupBy(*keys).agg(F.sum("_n").alias("_n"), *bounds(ends, ends))
    lo, hi = [f"_lo{i}" for i in range(len(ends))], [f"_hi{i}" for i in range(len(ends))]
    counts = stored(pyramid.at_levels(fine, []).groupBy("_level", *keys).agg(F.sum("_n").alias("_n"), *bounds(lo, hi)), "cells")
    cols = lambda names: [F.col(n) for n in names]
    near, far = _gaps(qaxis, cols(lo[:dim]), cols(hi[dim:])), _gaps(qaxis, cols(hi[:dim]), cols(lo[dim:]))
    mine = Window.partitionBy("_qid")
    upto = F.sum("_n").over(mine.orderBy("_far").rangeBetween(Window.unboundedPreceding, 0))
    least = F.least("_r", F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(mine))
    state = q.withColumns({"_r": F.lit(float("inf")), **{c: F.lit(0).cast("bigint") for c in keys}})
    for level in range(1, pyramid.levels + 1):
        kids = counts.where(F.col("_level") == level).drop("_level")
        kids = kids.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(keys)}).withColumns({c: F.expr(f"shiftright(_k{i}, 1)") for i, c in enumerate(keys)})
        met = state.join(kids, keys).withColumns({"_near": near, "_far": far}).where(F.col("_near") <= F.col("_r"))
        met = met.withColumn("_upto", upto).withColumn("_r", least).where(F.col("_near") <= F.col("_r"))
        state = stored(met.select("_qid", "_id", *qaxis, "_r", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)]), "near")
    at = _gaps(qaxis, cols(ends[:dim]), cols(ends[dim:]))
    met = state.join(placed, keys).withColumn("_far", at).where(F.col("_far") <= F.col("_r"))
    met = met.withColumn("_upto", upto).withColumn("_r", least).where(F.col("_far") <= F.col("_r"))
    return stored(met.select("_qid", "_id", *ends, F.col("_far").alias("d2")), "near")
