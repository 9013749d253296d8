"""Box join on a grid with levels.

Each box has a level on every axis: the grid whose cell is just larger than the box there.  So it
covers at most two cells per axis, whatever its size, and a box that is long on one axis only is
listed in small cells on the others.  A pair meets, on each axis, on the coarser of its two levels,
in the one cell that holds the low corner of the intersection, so no distinct is needed.  If one side
has many more rows, each of them is listed by its low corner only, and the other side reaches for it.

Work is measured in pairs: the number of tasks comes from the candidate pairs of all cells, and a
cell with more pairs than one task should see is cut into pieces on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.session import spread, stored

#: Level of boxes without extent; smaller boxes are listed there as well.
MIN_LEVEL = -12
#: From this level on one cell holds everything, infinite boxes too.
TOP_LEVEL = 1000
#: Different level vectors of a side, at most, and listings that a row needs on average for those of the
#: other side; beyond it levels are merged, which widens cells.
LEVEL_VECTORS = 48
LISTINGS = 4
#: From this ratio of rows on, the longer side is listed by its low corners alone.
UNEVEN = 4
#: Candidate pairs, and rows, that one task is meant to see.
TASK_PAIRS = 4_000_000
TASK_ROWS = 1_000_000
#: Tasks per core, and pairs of a task, at most, of a join whose pairs only stream through; see ``pieces``.
STREAM_TASKS = 32
STREAM_PAIRS = 100_000_000_000


@dataclass(frozen=True)
class Axis:
    """Bounds of both sides on one axis; a point has equal low and high."""

    llo: str
    lhi: str
    rlo: str
    rhi: str
    cell: float  # cell width at level 0, about the typical extent


def _level(lo: str, hi: str, cell: float, floor: int = MIN_LEVEL) -> Column:
    # a hair more, so that no box is wider than its cell by rounding
    ratio = (F.col(hi) - F.col(lo)) / F.lit(cell) * F.lit(1 + 1e-12)
    raw = F.when(ratio > 0, F.ceil(F.least(F.log2(ratio), F.lit(float(TOP_LEVEL))))).otherwise(floor)
    return F.greatest(raw.cast("int"), F.lit(floor))


def _cell_of(v: Column, cell: float, level: Column) -> Column:
    return F.when(level >= TOP_LEVEL, F.lit(0).cast("bigint")).otherwise(F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), level))).cast("bigint"))


def _merged(level: int, step: int) -> int:
    return -(-level // step) * step


def _step(levels: list[tuple[int, ...]], limit: float) -> int:
    """Smallest step of levels that leaves at most ``limit`` level vectors."""
    step = 1
    while len({tuple(_merged(v, step) for v in vector) for vector in levels}) > max(1, limit):
        step += 1
        if step > 2 * TOP_LEVEL:
            break
    return step


def _spread(df: DataFrame, bounds, tag: str, step: int, other: list[tuple[int, ...]], places: Sequence[str], floor: int = MIN_LEVEL) -> DataFrame:
    """One row per (levels, cells) where this row can meet a partner.

    ``places`` tell the cells of an axis: all that the box touches, only that of its low corner, or all where the
    low corner of a partner can lie, which is a cell more on the low side, as no partner is wider.
    """
    names = [f"_v{tag}{i}" for i in range(len(bounds))]
    for name, (lo, hi, cell) in zip(names, bounds):
        level = _level(lo, hi, cell, floor)
        df = df.withColumn(name, level if step == 1 else (F.ceil(level / F.lit(step)) * step).cast("int"))
    meet = [F.struct(*[F.greatest(F.col(n), F.lit(v)).alias(f"_m{i}") for i, (n, v) in enumerate(zip(names, vector))]) for vector in other]
    out = df.withColumn("_meet", F.explode(F.array_distinct(F.array(*meet))))
    out = out.withColumns({f"_m{i}": F.col(f"_meet._m{i}") for i in range(len(bounds))}).drop("_meet")
    for i, ((lo, hi, cell), place) in enumerate(zip(bounds, places)):
        first = _cell_of(F.col(lo), cell, F.col(f"_m{i}"))
        last = _cell_of(F.col(hi), cell, F.col(f"_m{i}"))
        out = out.withColumn(f"_f{tag}{i}", first)
        own = F.col(f"_f{tag}{i}")
        if place == "corner":
            out = out.withColumn(f"_c{i}", own)
        else:
            out = out.withColumn(f"_c{i}", F.explode(F.sequence(own - 1 if place == "reach" else own, last)))
    return out


def pieces(ls: DataFrame, rs: DataFrame, keys: list[str], task_pairs: int | None = TASK_PAIRS, together: Sequence[str] = ()):
    """(left, right, keys, tasks) with keys that have about ``task_pairs`` candidate pairs at most.

    A piece of a crowded key has the square root of ``task_pairs`` rows a side, so what is dealt out follows the
    pairs divided by that root: at a fixed size it grows with the pairs.  With None the size is that of 32 tasks per core,
    4 million pairs at least, and what is dealt out grows with the rows.  That is for pairs that stream
    through a task; where a task sorts or gathers them, keep the fixed size.

    Both sides are counted per key first; tasks is 0 if no key is on both sides.  A key with more pairs is cut into pieces: rows of each side
    are dealt by hash, and every piece of one side meets every piece of the other.  Which piece a row
    is in follows from its values, so a task that is run again does the same.  Right rows that agree in ``together`` stay in one piece.
    """
    counts = ls.groupBy(*keys).agg(F.count("*").alias("_nl")).join(rs.groupBy(*keys).agg(F.count("*").alias("_nr")), keys)
    pairs = F.col("_nl").cast("double") * F.col("_nr")
    work = counts.agg(F.sum(pairs), F.sum(F.col("_nl") + F.col("_nr")), F.max(pairs)).first()
    if work[0] is None:
        return ls, rs, keys, 0
    cores = ls.sparkSession.sparkContext.defaultParallelism
    if task_pairs is None:
        task_pairs = min(max(TASK_PAIRS, int(work[0] // (STREAM_TASKS * cores))), STREAM_PAIRS)
    on = list(keys)
    if work[2] > task_pairs:
        side = math.isqrt(task_pairs)
        cut = counts.where(pairs > task_pairs).select(
            *keys, F.ceil(F.col("_nl") / side).cast("int").alias("_pl"), F.ceil(F.col("_nr") / side).cast("int").alias("_pr")
        )
        cut = stored(cut, "cells")  # of known size when the joins are planned
        number = {"l": F.coalesce("_pl", F.lit(1)), "r": F.coalesce("_pr", F.lit(1))}
        sides = {"l": ls, "r": rs}
        for tag, other in (("l", "r"), ("r", "l")):
            df = sides[tag]
            own = F.pmod(F.xxhash64(*(together if together and tag == "r" else df.columns)), number[tag]).cast("int")
            df = df.join(cut, keys, "left").withColumn(f"_s{tag}", own)
            sides[tag] = df.withColumn(f"_s{other}", F.explode(F.sequence(F.lit(0), number[other] - 1))).drop("_pl", "_pr")
        ls, rs = sides["l"], sides["r"]
        on += ["_sl", "_sr"]
    return ls, rs, on, int(max(2 * cores, work[0] // task_pairs + 1, work[1] // TASK_ROWS + 1))


def paired_join(ls: DataFrame, rs: DataFrame, keys: list[str], task_pairs: int | None = TASK_PAIRS) -> DataFrame:
    """Equi-join on ``keys`` in tasks of about ``task_pairs`` candidate pairs; see ``pieces``."""
    ls, rs, on, tasks = pieces(ls, rs, keys, task_pairs)
    if not tasks:
        return ls.join(rs, on).where(F.lit(False))
    # dealt by pairs, as few bytes can be much work; no key is left that needs to be split
    return ls.repartition(tasks, *on).join(rs.repartition(tasks, *on), on)


def by_cell(batches: Iterator[pa.RecordBatch], on: list[str], prepare: Callable[[pa.Table], Any]) -> Iterator[tuple[Any, pa.Table]]:
    """(what ``prepare`` makes of a cell's held rows, some of its other rows) of a partition sorted by ``on``, then ``_of``: 0 for rows to hold."""
    cell, held, ready = None, [], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keys = np.stack([rows[c].to_numpy() for c in on])
        first = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), rows.num_rows]
        for lo, hi in zip(first[:-1], first[1:]):
            if hi == lo:
                continue
            if tuple(keys[:, lo]) != cell:
                cell, held, ready = tuple(keys[:, lo]), [], None
            part = rows.slice(lo, hi - lo)
            n = int((part["_of"].to_numpy() == 0).sum())
            if n:
                held.append(part.slice(0, n))
            if n < part.num_rows and held:
                ready = ready or prepare(pa.concat_tables(held).combine_chunks())
                yield ready, part.slice(n).combine_chunks()


def number(rows: pa.Table, c: str) -> np.ndarray:
    """A column as doubles, null as not a number."""
    return rows[c].cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def _side(df: DataFrame, bounds, floor: int = MIN_LEVEL):
    """Rows with all bounds, their count, level vectors in use and overall bounds, in one pass."""
    df = df.dropna(subset=sorted({c for lo, hi, _ in bounds for c in (lo, hi)}))
    ends = [f for lo, hi, _ in bounds for f in (F.min(lo), F.max(hi))]
    got = df.agg(F.count("*"), F.collect_set(F.struct(*[_level(*b, floor).alias(f"v{i}") for i, b in enumerate(bounds)])), *ends).first()
    return df, got[0], [tuple(v) for v in got[1]], got[2:]


def _within(df: DataFrame, bounds, ends) -> DataFrame:
    """Only rows that reach into the overall bounds of the other side."""
    for i, (lo, hi, _) in enumerate(bounds):
        df = df.where((F.col(hi) >= F.lit(ends[2 * i])) & (F.col(lo) <= F.lit(ends[2 * i + 1])))
    return df


def listed(left: DataFrame, right: DataFrame, axes: Sequence[Axis], equal: Sequence[tuple[str, str]] = (), floor: int = MIN_LEVEL, dealt: bool = False, whole: bool = False):
    """(left, right, keys, rows): both sides listed in the cells where they can meet; None if a side is empty.

    ``rows`` are the numbers of rows before they are listed; boxes below level ``floor`` are listed there.  ``dealt``
    says that the left side has been dealt out to all cores; ``whole`` lists both sides in all cells that they touch.
    """
    # cells a little wider than asked for, so that boxes of just that width stay on level 0
    lb = [(a.llo, a.lhi, a.cell * (1 + 1e-6)) for a in axes]
    rb = [(a.rlo, a.rhi, a.cell * (1 + 1e-6)) for a in axes]
    right, rn, rlevels, rends = _side(right, rb, floor)
    if rn:
        left = _within(left, lb, rends)
    left, ln, llevels, lends = _side(left, lb, floor)
    if not ln or not rn:
        return None
    right = _within(right, rb, lends)
    # a row is listed once for each vector of the other side, so the longer side wants few of them there
    steps = [_step(levels, min(LEVEL_VECTORS, LISTINGS * (ln + rn) / other)) for levels, other in ((llevels, rn), (rlevels, ln))]
    merged = [sorted({tuple(_merged(v, step) for v in vector) for vector in levels}) for levels, step in zip((llevels, rlevels), steps)]
    lplace, rplace = ("corner", "reach") if ln >= UNEVEN * rn else ("reach", "corner") if rn >= UNEVEN * ln else ("all", "all")
    if whole:
        lplace, rplace = "all", "all"
    # a partner that is a point there lies in a cell that the box touches
    near = lambda place, lo, hi: "all" if place == "reach" and lo == hi else place
    ls = _spread(left if dealt else spread(left), lb, "l", steps[0], merged[1], [near(lplace, a.rlo, a.rhi) for a in axes], floor)
    rs = _spread(spread(right), rb, "r", steps[1], merged[0], [near(rplace, a.llo, a.lhi) for a in axes], floor)
    for i, (lc, rc) in enumerate(equal):
        ls, rs = ls.withColumn(f"_e{i}", F.col(lc)), rs.withColumn(f"_e{i}", F.col(rc))
    every = range(len(axes))
    keys = [*[f"_m{i}" for i in every], *[f"_c{i}" for i in every], *[f"_e{i}" for i in range(len(equal))]]
    return ls, rs, keys, (ln, rn)


def _small(df: DataFrame, rows: int) -> bool:
    """Whether so many rows stay below the session's broadcast threshold, by a generous width."""
    width = 16 + sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else 64 for f in df.schema)
    return rows * width <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _join_listed(ls: DataFrame, rs: DataFrame, keys: list[str], rows: tuple[int, int], task_pairs: int | None) -> DataFrame:
    """Join both sides; a side whose listed rows are counted and few goes to every task."""
    for side, other, n in sorted(((ls, rs, rows[0]), (rs, ls, rows[1])), key=lambda v: v[2])[:1]:
        if _small(side, n) and _small(side, side.count()):
            small = F.broadcast(side)
            return small.join(other, keys) if side is ls else other.join(small, keys)
    return paired_join(ls, rs, keys, task_pairs)


def box_join(
    left: DataFrame,
    right: DataFrame,
    axes: Sequence[Axis],
    predicate: Column | None = None,
    equal: Sequence[tuple[str, str]] = (),
    task_pairs: int | None = TASK_PAIRS,
) -> DataFrame:
    """Inner join of all pairs whose closed boxes meet and that pass ``predicate``.

    ``equal`` names (left, right) columns that must agree; they join the cell as keys.
    Column names of both sides must differ.  Rows with a null bound never match.  ``task_pairs`` as in ``pieces``:
    None where the pairs are the result.
    """
    lcols, rcols = left.columns, right.columns
    both = listed(left, right, axes, equal)
    if both is None:
        return left.join(right, F.lit(False))
    pairs = _join_listed(*both, task_pairs)
    every = range(len(axes))
    keep = [F.col(f"_m{i}") == F.greatest(f"_vl{i}", f"_vr{i}") for i in every]
    if max(both[3]) < UNEVEN * min(both[3]):
        # the cell of the low corner of the intersection is the larger of the two first cells
        keep += [F.greatest(f"_fl{i}", f"_fr{i}") == F.col(f"_c{i}") for i in every]
    keep += [(F.col(a.llo) <= F.col(a.rhi)) & (F.col(a.rlo) <= F.col(a.lhi)) for a in axes]
    if predicate is not None:
        keep.append(predicate)
    return pairs.where(reduce(Column.__and__, keep)).select(*lcols, *rcols)


def typical_extents(df: DataFrame, *bounds: tuple[str, str]) -> list[float]:
    """Median box extent per axis, as cell width for :class:`Axis` (one pass)."""
    got = df.agg(*[F.percentile_approx((F.col(hi) - F.col(lo)).cast("double"), 0.5, 1000) for lo, hi in bounds]).first()
    return [float(e) if e and e > 0 else 1.0 for e in got]


def typical_extent(df: DataFrame, lo: str, hi: str) -> float:
    return typical_extents(df, (lo, hi))[0]
