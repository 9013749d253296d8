"""Ranking, renumbering and offsets without single-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.angles import pose_difference
from geoloom.operators.ordering import neighbour_rows, row_numbers, running_sums, zorder_key
from geoloom.session import range_partitions


def renumber(df: DataFrame, key: str, keep: Column, name: str = "new_id") -> DataFrame:
    """Dense 0-based new ids in key order for the kept rows, -1 for the others."""
    out = running_sums(df.withColumn("_keep", keep), [], [key], {name: F.col("_keep").cast("bigint")})
    return out.withColumn(name, F.when(F.col("_keep"), F.col(name)).otherwise(F.lit(-1).cast("bigint"))).drop("_keep")


def chunk_ranges(df: DataFrame, key: str, size: int) -> DataFrame:
    """Consecutive ranges of ``size`` rows in key order; the last may be short."""
    numbered = row_numbers(df.select(key), [key], "_n")
    chunk = F.floor((F.col("_n") - 1) / F.lit(size)).cast("bigint")
    return numbered.groupBy(chunk.alias("chunk")).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")
    )


def cumulative_offset(df: DataFrame, key: str, name: str = "first_id") -> DataFrame:
    """Rows per key and the number of rows of all lower keys."""
    return running_sums(df.groupBy(key).agg(F.count("*").alias("n")), [], [key], {name: "n"})


def pose_deltas(df: DataFrame, key: str, order: Sequence[str], pose: Sequence[str]) -> DataFrame:
    """Odometry between consecutive poses of a key; the first pose has none."""
    prev = neighbour_rows(df, [key], order, {f"_p{i}": c for i, c in enumerate(pose)}, step=-1)
    delta = pose_difference([F.col(c) for c in pose], [F.col(f"_p{i}") for i in range(3)])
    named = [d.alias(n) for d, n in zip(delta, ("dx", "dy", "dt"))]
    return prev.where(F.col("_p0").isNotNull()).select("*", *named)


def zorder_layout(df: DataFrame, key: str, cells: tuple[Column, Column]) -> DataFrame:
    """Physical layout along the Z curve: range partitions, sorted inside."""
    out = df.withColumn(key, zorder_key(*cells))
    return out.repartitionByRange(range_partitions(out), key).sortWithinPartitions(key)
