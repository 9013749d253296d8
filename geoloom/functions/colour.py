"""Colour ramps, conversions and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoloom.functions.numeric import clamp

Rgb = list[Column]


def jet(v: Column) -> Rgb:
    v = clamp(v, 0.0, 1.0)
    tent = lambda centre: clamp(1.5 - F.abs(4.0 * v - centre), 0.0, 1.0)
    return [tent(3.0), tent(2.0), tent(1.0)]


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Rgb:
    """Hue in turns."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6.0, F.lit(6.0))
        return v - v * s * clamp(F.least(k, 4.0 - k), 0.0, 1.0)

    return [channel(5), channel(3), channel(1)]


def rainbow(v: Column) -> Rgb:
    return hsv_to_rgb(v, F.lit(1.0), F.lit(1.0))


def cold(v: Column) -> Rgb:
    """Black to blue to cyan to white."""
    return [clamp(3.0 * v - 2.0, 0.0, 1.0), clamp(3.0 * v - 1.0, 0.0, 1.0), clamp(3.0 * v, 0.0, 1.0)]


def hot(v: Column) -> Rgb:
    """Black to red to yellow to white."""
    return cold(v)[::-1]


# fixed values: the stops of the bone ramp
BONE = [(0.0, 0.0, 0.0), (0.3194, 0.3194, 0.4444), (0.6528, 0.7778, 0.7778), (1.0, 1.0, 1.0)]


def bone(v: Column) -> Rgb:
    """Each third rises from black to its upper stop; the very top is red."""
    x = clamp(v, 0.0, 1.0) * 3.0
    part = F.floor(x)
    out = []
    for c, top in zip(range(3), (1.0, 0.0, 0.0)):
        stop = F.when(part == 0, BONE[1][c]).when(part == 1, BONE[2][c]).otherwise(BONE[3][c])
        out.append(F.when(part >= 3, top).otherwise(stop * (x - part)))
    return out


def luma(c: Rgb) -> Column:
    return 0.30 * c[0] + 0.59 * c[1] + 0.11 * c[2]


def distance2(a: Rgb, b: Rgb, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    d = [(y - x) * (y - x) * w for x, y, w in zip(a, b, weights)]
    return d[0] + d[1] + d[2]


LUMA_WEIGHTS = (0.30, 0.59, 0.11)

# fixed values: RGB to XYZ matrices and white points of the two conversions
LUV_XYZ = ((0.4125, 0.3576, 0.1804), (0.2125, 0.7154, 0.0721), (0.0193, 0.1192, 0.9502))
LUV_WHITE = (0.19784977571475, 0.46834507665248)
LAB_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
LAB_WHITE = (0.9505, 1.0, 1.089)
DARK = 0.008856


def _matrix(m, c: Rgb) -> Rgb:
    return [c[0] * r[0] + c[1] * r[1] + c[2] * r[2] for r in m]


def rgb_to_luv(c: Rgb) -> Rgb:
    """Channels 0..255 with the sRGB curve."""
    lin = []
    for v in c:
        u = v / 255.0
        lin.append(F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4))))
    x, y, z = _matrix(LUV_XYZ, lin)
    light = F.when(y > DARK, 116.0 * F.pow(y, F.lit(1.0 / 3.0)) - 16.0).otherwise(903.3 * y)
    total = x + 15.0 * y + 3.0 * z
    u1 = F.when(total != 0, 4.0 * x / total).otherwise(4.0)
    v1 = F.when(total != 0, 9.0 * y / total).otherwise(0.6)
    return [light, 13.0 * light * (u1 - LUV_WHITE[0]), 13.0 * light * (v1 - LUV_WHITE[1])]


def rgb_to_hsv(c: Rgb) -> Rgb:
    """Channels 0..1; hue in turns, grey has hue 0."""
    r, g, b = c
    top, low = F.greatest(*c), F.least(*c)
    span = F.when(top != low, top - low)
    hue = F.when(r == top, F.when(g >= b, 0.0).otherwise(1.0) + (g - b) / span / 6.0)
    hue = hue.when(g == top, 1.0 / 3.0 + (b - r) / span / 6.0).otherwise(2.0 / 3.0 + (r - g) / span / 6.0)
    return [F.coalesce(hue, F.lit(0.0)), F.when(top == 0, 0.0).otherwise(1.0 - low / F.when(top != 0, top)), top]


def rgb_to_lab(c: Rgb) -> Rgb:
    """Channels 0..1 without gamma; result scaled to about 0..1."""
    f = []
    for v, w in zip(_matrix(LAB_XYZ, c), LAB_WHITE):
        t = v / w
        f.append(F.when(t > DARK, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0))
    light, a, b = 116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2])
    return [light / 100.0, 0.5 + a / 254.0, 0.5 + b / 254.0]


def plane_novelty(p: list[Column], plane: list[Column], seen: Column, weights: tuple[float, float, float] = (1.1, 0.66, 0.26)):
    """(score, novel, changed): plane distance capped at 1, mixed with the seen novelty.

    Default weights are fixed values; an all-zero plane counts as distance 0.
    """
    none = (plane[0] == 0) & (plane[1] == 0) & (plane[2] == 0) & (plane[3] == 0)
    off = F.abs(plane[0] * p[0] + plane[1] * p[1] + plane[2] * p[2] + plane[3]) * weights[0]
    dist = F.when(none, 0.0).otherwise(F.least(off, F.lit(1.0)))
    score = dist + (seen - dist) * weights[1]
    return score, seen > weights[2], score > weights[2]
