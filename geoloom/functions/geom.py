"""Box, segment, triangle and vector expressions on plain columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def add(a: Vec, b: Vec) -> list[Column]:
    return [x + y for x, y in zip(a, b)]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def scale(a: Vec, s) -> list[Column]:
    return [x * s for x in a]


def flip(a: Vec) -> list[Column]:
    return [-x for x in a]


def dot(a: Vec, b: Vec) -> Column:
    return reduce(Column.__add__, [x * y for x, y in zip(a, b)])


def magnitude(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vec) -> list[Column]:
    """Unit vector; the zero vector stays zero."""
    m = magnitude(a)
    return [F.when(m > 0, x / m).otherwise(F.lit(0.0)) for x in a]


def cross(a: Vec, b: Vec) -> list[Column]:
    (ax, ay, az), (bx, by, bz) = a, b
    return [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(Column.__and__, tests)


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests)


# boxes: closed, low and high corner per axis


def intersects(alo: Vec, ahi: Vec, blo: Vec, bhi: Vec) -> Column:
    return all_of([(l1 <= h2) & (l2 <= h1) for l1, h1, l2, h2 in zip(alo, ahi, blo, bhi)])


def contained(ilo: Vec, ihi: Vec, olo: Vec, ohi: Vec) -> Column:
    """Inner box completely inside outer box."""
    return all_of([(o1 <= i1) & (i2 <= o2) for i1, i2, o1, o2 in zip(ilo, ihi, olo, ohi)])


def touches(alo: Vec, ahi: Vec, blo: Vec, bhi: Vec) -> Column:
    """Boxes that share a face: they meet, and on some axis only in one bound."""
    edge = any_of([(l1 == h2) | (l2 == h1) for l1, h1, l2, h2 in zip(alo, ahi, blo, bhi)])
    return intersects(alo, ahi, blo, bhi) & edge


def area(lo: Vec, hi: Vec) -> Column:
    return reduce(Column.__mul__, sub(hi, lo))


def margin(lo: Vec, hi: Vec) -> Column:
    """Total edge length of the box: 2^(d-1) times the sum of the sides."""
    return reduce(Column.__add__, sub(hi, lo)) * F.lit(float(2 ** (len(lo) - 1)))


def overlap_area(alo: Vec, ahi: Vec, blo: Vec, bhi: Vec) -> Column:
    sides = [
        F.greatest(F.least(h1, h2) - F.greatest(l1, l2), F.lit(0.0)) for l1, h1, l2, h2 in zip(alo, ahi, blo, bhi)
    ]
    return reduce(Column.__mul__, sides)


def box_distance(alo: Vec, ahi: Vec, blo: Vec, bhi: Vec) -> Column:
    """Shortest distance of two boxes, 0 when they meet."""
    gaps = [F.greatest(l2 - h1, l1 - h2, F.lit(0.0)) for l1, h1, l2, h2 in zip(alo, ahi, blo, bhi)]
    return F.sqrt(dot(gaps, gaps))


# segments and triangles


def point_line_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance to the endless line through a and b (plane)."""
    dx, dy = sub(b, a)
    return F.abs(dx * (a[1] - p[1]) - (a[0] - p[0]) * dy) / F.sqrt(dx * dx + dy * dy)


def segment_place(p: Vec, a: Vec, b: Vec) -> Column:
    """Parameter in [0, 1] of the segment point nearest to p; 0 for a zero-length segment."""
    ab = sub(b, a)
    l2 = dot(ab, ab)
    t = F.when(l2 > 0, dot(sub(p, a), ab) / l2).otherwise(F.lit(0.0))
    return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def point_segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    near = add(a, scale(sub(b, a), segment_place(p, a, b)))
    return magnitude(sub(p, near))


def side(p: Vec, a: Vec, b: Vec) -> Column:
    """Twice the signed area of a, b, p."""
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def in_triangle(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Same side of all three edges; the boundary is inside."""
    s = [side(p, a, b), side(p, b, c), side(p, c, a)]
    return all_of([x >= 0 for x in s]) | all_of([x <= 0 for x in s])


def triangle_distance(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Distance from p to the filled triangle (plane)."""
    edges = F.least(point_segment_distance(p, a, b), point_segment_distance(p, b, c), point_segment_distance(p, c, a))
    return F.when(in_triangle(p, a, b, c), F.lit(0.0)).otherwise(edges)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return magnitude(cross(sub(b, a), sub(c, a))) * F.lit(0.5)


def signed_volume(a: Vec, b: Vec, c: Vec) -> Column:
    """Signed volume of the tetrahedron from the origin to a, b, c."""
    return dot(a, cross(b, c)) / F.lit(6.0)


def rotate(p: Vec, axis: str, angle: Column | float) -> list[Column]:
    """Rotate about a main axis, right-handed."""
    angle = angle if isinstance(angle, Column) else F.lit(angle)
    c, s = F.cos(angle), F.sin(angle)
    x, y, z = p
    if axis == "x":
        return [x, c * y - s * z, s * y + c * z]
    if axis == "y":
        return [c * x + s * z, y, c * z - s * x]
    return [c * x - s * y, s * x + c * y, z]


def transform(p: Vec, m: Sequence[float]) -> list[Column]:
    """Apply a row-major 4x4 matrix to a point."""
    x, y, z = p
    return [x * float(m[i]) + y * float(m[i + 1]) + z * float(m[i + 2]) + float(m[i + 3]) for i in (0, 4, 8)]
