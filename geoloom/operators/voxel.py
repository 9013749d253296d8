"""Voxel tables: accumulation, confidence-weighted fusion, coarsening, sub-volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def voxel_of(axes: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(a) / F.lit(float(size))).cast("bigint").alias(f"i{n}") for a, n in zip(axes, "xyz")]


def accumulate(points: DataFrame, axes: Sequence[str], size: float, values: Sequence[str], min_count: int) -> DataFrame:
    """Mean of each value per voxel; voxels with fewer rows than ``min_count`` are dropped."""
    return (
        points.groupBy(*voxel_of(axes, size))
        .agg(F.count("*").alias("cnt"), *[F.avg(v).alias(v) for v in values])
        .where(F.col("cnt") >= min_count)
    )


def fuse(voxels: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """Confidence-weighted mean per voxel; the weight becomes the sum of weights."""
    w = F.col(weight)
    return voxels.groupBy(*keys).agg(*[(F.sum(F.col(v) * w) / F.sum(w)).alias(v) for v in values], F.sum(w).alias(weight))


def downsample(voxels: DataFrame, values: Sequence[str], weight: str) -> DataFrame:
    """Half resolution: weighted mean of each 2 x 2 x 2 block."""
    keys = [F.floor(F.col(k) / 2).cast("bigint").alias(k) for k in ("ix", "iy", "iz")]
    return fuse(voxels.select(*keys, *values, weight), ["ix", "iy", "iz"], values, weight)


def subvolume_size(voxel: float, max_voxels: int, border_voxels: int = 10) -> tuple[float, float]:
    """(size, border) of the largest cubes that hold at most ``max_voxels`` voxels, border included."""
    edge = round(max_voxels ** (1 / 3))
    edge -= edge**3 > max_voxels
    inner = edge - 2 * border_voxels
    if inner < 1:
        raise ValueError(f"{max_voxels} voxels leave no room inside a border of {border_voxels}")
    return inner * voxel, border_voxels * voxel


def assign_subvolumes(
    boxes: DataFrame, lows: Sequence[str], highs: Sequence[str], size: float, border: float
) -> DataFrame:
    """Cut the global box, grown by the border, into cubes; list the boxes meeting each cube.

    A cube meets a box within ``border`` around the cube.  The cubes of one box are a
    plain index range, so no join is needed.
    """
    b = boxes.agg(*[F.min(c) for c in lows], *[F.max(c) for c in highs]).first()
    out = boxes
    for n, (name, lo, hi) in enumerate(zip("ijk", lows, highs)):
        if b[n] is None:
            return boxes.select(*[F.lit(0).cast("bigint").alias(x) for x in "ijk"], *boxes.columns).limit(0)
        start = b[n] - border
        count = max(1, -int(-(b[len(lows) + n] + border - start) // size))
        # cube i spans start + size * [i, i + 1], grown by border on both sides
        first = F.greatest(F.ceil((F.col(lo) - border - start) / size).cast("bigint") - 1, F.lit(0))
        last = F.least(F.floor((F.col(hi) + border - start) / size).cast("bigint"), F.lit(count - 1))
        out = out.withColumn(name, F.explode(F.sequence(first, last)))
    return out
