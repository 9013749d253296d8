"""Distributed total order: row numbers, keyed neighbours and running sums.

A window over one key sorts that key in a single task, which fails when one key
holds a third of the table.  These helpers range-partition by (key, order, tie)
so that hot keys spread over many partitions, write the ordered rows to the
checkpoint folder once (partition ids must not change on a retry), and then
stitch the partitions with tables that have at most a few rows per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import checkpoint, range_partitions

_LOW33 = (1 << 33) - 1
_BEFORE = (Window.unboundedPreceding, -1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_order(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Add ``_part`` (range partition) and ``_idx`` (0-based place in it)."""
    cols = [_col(c) for c in order]
    placed = (
        df.repartitionByRange(range_partitions(df), *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return checkpoint(
        placed.withColumn("_part", F.shiftright("_mid", 33).cast("int"))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
        .drop("_mid")
    )


def _offsets(ordered: DataFrame) -> DataFrame:
    w = Window.orderBy("_part")
    return ordered.groupBy("_part").agg(F.count("*").alias("_cnt")).select(
        "_part",
        "_cnt",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"),
        F.lead("_part").over(w).alias("_next"),
        F.lag("_part").over(w).alias("_prev"),
    )


def row_numbers(df: DataFrame, order: Sequence[str | Column], name: str = "row_num") -> DataFrame:
    """Global 1-based row number by ``order`` without a single-task window."""
    ordered = with_order(df, order)
    offs = F.broadcast(_offsets(ordered).select("_part", "_off"))  # one row per partition
    return (
        ordered.join(offs, "_part")
        .withColumn(name, F.col("_off") + F.col("_idx") + 1)
        .drop("_part", "_idx", "_off")
    )


def neighbour_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, str],
    step: int = 1,
) -> DataFrame:
    """``lead`` (step=1) or ``lag`` (step=-1) within ``keys`` for hot keys.

    ``values`` maps a new column name to the source column.
    """
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    ordered = with_order(df, [*keys, *order])
    offs = _offsets(ordered)
    edge_idx = F.lit(0) if step == 1 else F.col("_cnt") - 1
    # the row of the neighbouring partition that touches this one: one row per partition
    edge = (
        ordered.join(F.broadcast(offs.select("_part", "_cnt")), "_part")
        .where(F.col("_idx") == edge_idx)
        .select(
            F.col("_part").alias("_npart"),
            *[F.col(k).alias(f"_ek_{i}") for i, k in enumerate(keys)],
            *[F.col(src).alias(f"_ev_{dst}") for dst, src in values.items()],
        )
    )
    link = offs.select("_part", F.col("_next" if step == 1 else "_prev").alias("_npart"))
    edge = F.broadcast(link.join(edge, "_npart").drop("_npart"))
    w = Window.partitionBy("_part").orderBy("_idx")
    move = F.lead if step == 1 else F.lag
    out = ordered.withColumn("_has", move(F.lit(1)).over(w))
    for i, k in enumerate(keys):
        out = out.withColumn(f"_nk_{i}", move(k).over(w))
    for dst, src in values.items():
        out = out.withColumn(f"_nv_{dst}", move(src).over(w))
    out = out.join(edge, "_part", "left")
    inside = F.col("_has").isNotNull()
    same_in, same_out = F.lit(True), F.lit(True)
    for i, k in enumerate(keys):
        same_in = same_in & F.col(k).eqNullSafe(F.col(f"_nk_{i}"))
        same_out = same_out & F.col(k).eqNullSafe(F.col(f"_ek_{i}"))
    return out.select(
        *df.columns,
        *[
            F.when(inside & same_in, F.col(f"_nv_{d}"))
            .when(~inside & same_out, F.col(f"_ev_{d}"))
            .alias(d)
            for d in values
        ],
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: dict[str, str | Column],
) -> DataFrame:
    """Exclusive running sums per key (sum of all earlier rows), hot keys included."""
    src = df
    for name, c in sums.items():
        src = src.withColumn(f"_s_{name}", _col(c))
    ordered = with_order(src, [*keys, *order])
    per = ordered.groupBy("_part", *keys).agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums]
    )
    # only keys that continue into another partition need a carry; each partition
    # holds at most one continued key, so this table is bounded by the partition count
    spans = (
        per.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
        if keys
        else None
    )
    carried = per.join(spans, list(keys), "left_semi") if keys else per
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("_part").rowsBetween(*_BEFORE)
    carry = carried.select(
        "_part", *keys, *[F.sum(f"_t_{n}").over(w).alias(f"_c_{n}") for n in sums]
    )
    local = Window.partitionBy("_part", *keys).orderBy("_idx").rowsBetween(*_BEFORE)
    out = ordered
    for n in sums:
        out = out.withColumn(f"_l_{n}", F.sum(f"_s_{n}").over(local))
    out = out.join(F.broadcast(carry), ["_part", *keys], "left")
    zero = F.lit(0)
    return out.select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n)
            for n in sums
        ],
    )


def keyed_row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "row_num"
) -> DataFrame:
    """Row number within ``keys``; a hot key is spread over many tasks."""
    out = running_sums(df, keys, order, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) + 1)


def str_tiles(df: DataFrame, x: str, y: str, tie: Sequence[str], page_rows: int) -> DataFrame:
    """Sort-Tile-Recursive packing: slice by x, then pages by y inside a slice.

    With n rows and S = ceil(sqrt(ceil(n / page_rows))), a slice has S * page_rows rows.
    """
    n = df.count()
    pages = -(-n // page_rows)
    slices = max(1, int(-(-(pages**0.5) // 1)))
    numbered = row_numbers(df, [x, *tie], "_rx")
    sliced = numbered.withColumn(
        "slice", F.floor((F.col("_rx") - 1) / F.lit(slices * page_rows)).cast("bigint")
    ).drop("_rx")
    paged = keyed_row_numbers(sliced, ["slice"], [y, *tie], "_ry")
    return paged.withColumn(
        "page", F.floor((F.col("_ry") - 1) / F.lit(page_rows)).cast("bigint")
    ).drop("_ry")


def spread_bits(c: Column) -> Column:
    """Spread the low 16 bits of ``c`` to the even bit places."""
    # fixed values: the usual shift and mask steps for 16-bit Morton codes
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return c


def zorder_key(x: Column, y: Column) -> Column:
    """Morton code of two non-negative 16-bit cell numbers."""
    xb, yb = spread_bits(x.cast("bigint")), spread_bits(y.cast("bigint"))
    return xb.bitwiseOR(F.shiftleft(yb, 1))
