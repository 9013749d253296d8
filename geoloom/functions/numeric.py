"""Interpolation, texture scores, polygon measures and small number helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lerp(f: Sequence[Column], x: Column) -> Column:
    return f[0] + (f[1] - f[0]) * x


def bilinear(f: Sequence[Column], x: Column, y: Column) -> Column:
    """f is lower left, lower right, upper left, upper right."""
    return lerp([lerp(f[:2], x), lerp(f[2:], x)], y)


def _spline(t: Column) -> Column:
    """Cubic B-spline weight at distance t."""
    a = F.abs(t)
    near = 2.0 / 3.0 - a * a + a * a * a / 2.0
    far = (2.0 - a) * (2.0 - a) * (2.0 - a) / 6.0
    return F.when(a < 1, near).when(a < 2, far).otherwise(0.0)


def bicubic(f: Sequence[Sequence[Column]], x: Column, y: Column) -> Column:
    """B-spline value at (x, y) in [0, 1] of a 4 x 4 patch whose second sample is the origin."""
    total = F.lit(0.0)
    for m, row in enumerate(f):
        for n, v in enumerate(row):
            total = total + v * _spline(y - (m - 1)) * _spline(x - (n - 1))
    return total


# fixed values: weights of the four samples per power of x, highest power first
CUBIC = ((-1.0, 3.0, -3.0, 1.0), (3.0, -6.0, 3.0, 0.0), (-2.0, -3.0, 6.0, -1.0), (0.0, 1.0, 0.0, 0.0))


def cubic(f: Sequence[Column], x: Column) -> Column:
    """Cubic in x from four samples with the table above (not divided by six)."""
    out = F.lit(0.0)
    for row in CUBIC:
        out = out * x + sum((v * w for v, w in zip(f, row)), start=F.lit(0.0))
    return out


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.least(F.greatest(x, low), high)


def floor_log2(n: str) -> Column:
    """Floor of log2 for positive integers, 0 for 0."""
    return F.when(F.col(n) <= 1, 0).otherwise(F.length(F.bin(n)) - 1)


def is_power_of_two(n: Column) -> Column:
    return n.bitwiseAND(n - 1) == 0


def next_power_of_two(n: str) -> Column:
    """Smallest power of two not below n; n itself when it is one."""
    up = F.expr(f"shiftleft(1L, length(bin({n})))")
    return F.when(F.col(n) < 0, 1).when(is_power_of_two(F.col(n)), F.col(n)).otherwise(up)


def round_away(x: Column) -> Column:
    return (x + F.when(x < 0, -0.5).otherwise(0.5)).cast("bigint")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def texture_stats(t: Column) -> Column:
    """Struct of mean and root mean square about it; a flat texture has rms 1."""

    def finish(acc: Column) -> Column:
        mean = acc["s"] / acc["n"]
        rms = F.sqrt(F.greatest(acc["q"] / acc["n"] - mean * mean, F.lit(0.0)))
        return F.struct(mean.alias("mean"), F.when(rms == 0, 1.0).otherwise(rms).alias("rms"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("n"))
    step = lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["q"] + v * v).alias("q"), (acc["n"] + 1.0).alias("n"))
    return F.aggregate(t, zero, step, finish)


def _scaled(texture: str, mean: Column, rms: Column) -> Column:
    return F.transform(texture, lambda v: (v - mean) / rms)


def normalise_textures(df: DataFrame, named: dict[str, str]) -> DataFrame:
    """Add textures with mean 0 and rms 1: ``named`` maps the new column to its source.

    The statistics are their own columns, so they are not computed again per sample.
    """
    for new, src in named.items():
        df = df.withColumn(f"_st_{new}", texture_stats(F.col(src)))
    for new, src in named.items():
        df = df.withColumn(new, _scaled(src, F.col(f"_st_{new}.mean"), F.col(f"_st_{new}.rms")))
    return df.drop(*[f"_st_{new}" for new in named])


def ssd(a: Column, b: Column, channels: int = 3) -> Column:
    """Sum of squared differences per sample, scaled by the widest possible colour distance."""
    return _total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))) / (F.size(a) / channels * 255.0 * 255.0 * 3.0)


def one_minus_dot(a: Column, b: Column) -> Column:
    """1 - mean product; for normalised textures 1 - correlation."""
    return 1.0 - _total(F.zip_with(a, b, lambda p, q: p * q)) / F.size(a)


def patch_score(ncc: Column, threshold: float, images: Column) -> Column:
    return F.greatest(F.lit(0.0), ncc - threshold) * F.size(images)


# polygons: array<struct<x, y>>, closed implicitly


def _edges(poly: Column) -> Column:
    turned = F.concat(F.slice(poly, 2, F.size(poly) - 1), F.slice(poly, 1, 1))
    return F.zip_with(poly, turned, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def signed_area(poly: Column) -> Column:
    terms = F.transform(_edges(poly), lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"])
    return _total(terms) / 2.0


def in_kernel(poly: Column, x: Column, y: Column) -> Column:
    """Point on the inner side of every edge of a counter-clockwise polygon."""
    return F.forall(_edges(poly), lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"]) >= 0)


def is_convex(poly: Column) -> Column:
    """All turns go the same way."""
    e = _edges(poly)
    after = F.concat(F.slice(e, 2, F.size(e) - 1), F.slice(e, 1, 1))
    turns = F.zip_with(
        e, after, lambda p, q: (p["bx"] - p["ax"]) * (q["by"] - q["ay"]) - (p["by"] - p["ay"]) * (q["bx"] - q["ax"])
    )
    return F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)


def clip_half_plane(poly: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Part of the polygon on the left of the line a -> b."""
    (ax, ay), (bx, by) = a, b
    left = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)

    def cut(e: Column) -> Column:
        s, t = left(e["ax"], e["ay"]), left(e["bx"], e["by"])
        k = s / (s - t)
        mid = F.struct((e["ax"] + (e["bx"] - e["ax"]) * k).alias("x"), (e["ay"] + (e["by"] - e["ay"]) * k).alias("y"))
        start = F.struct(e["ax"].alias("x"), e["ay"].alias("y"))
        return F.array_compact(F.array(F.when(s >= 0, start), F.when(((s > 0) & (t < 0)) | ((s < 0) & (t > 0)), mid)))

    return F.flatten(F.transform(_edges(poly), cut))


def elapsed(s: Column) -> Column:
    """``xd hh:mm:ss``, ``hh:mm:ss``, ``mm:ss`` or seconds with microseconds."""
    whole = F.floor(s).cast("bigint")
    d, h, m, sec = F.floor(whole / 86400), F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60
    clock = F.format_string("%02d:%02d:%02d", h, m, sec)
    return (
        F.when(whole >= 86400, F.format_string("%dd %s", d, clock))
        .when(whole >= 3600, clock)
        .when(whole >= 60, F.format_string("%02d:%02d", m, sec))
        .otherwise(F.format_string("%.6f", s))
    )


def radial_project(p: Sequence[Column], f: Column, k1: float, k2: float) -> list[Column]:
    """Pinhole projection with two radial distortion terms (camera looks along +z)."""
    x, y = p[0] / p[2], p[1] / p[2]
    r2 = x * x + y * y
    d = f * (1.0 + k1 * r2 + k2 * r2 * r2)
    return [d * x, d * y]


def radial_undistort(u: Column, v: Column, f: Column, k1: float, k2: float, steps: int = 8) -> list[Column]:
    """Undistorted image place, by Newton steps on the radius."""
    rd = F.sqrt(u * u + v * v) / f

    def newton(r: Column, _: Column) -> Column:
        q = r * r
        return r - (r * (1.0 + k1 * q + k2 * q * q) - rd) / (1.0 + 3.0 * k1 * q + 5.0 * k2 * q * q)

    # an array fold keeps the expression small however many steps are taken
    r = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), rd, newton)
    s = F.when(rd > 0, r / rd).otherwise(1.0)
    return [u * s, v * s]


def camera_centre(rot: Sequence[Sequence[Column]], move: Sequence[Column]) -> list[Column]:
    """Centre -R^T t of a camera given by rotation rows and translation."""
    return [-(rot[0][i] * move[0] + rot[1][i] * move[1] + rot[2][i] * move[2]) for i in range(3)]
