"""Angles, planar poses and sonar projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def wrap(t: Column) -> Column:
    """Angle within [-pi, pi]; the remainder keeps the sign of the shifted angle."""
    up = (t + math.pi) % F.lit(TWO_PI) - math.pi
    down = (t - math.pi) % F.lit(TWO_PI) + math.pi
    return F.when(t >= 0, up).otherwise(down)


def to_frame(pose: list[Column], p: list[Column]) -> list[Column]:
    """Point seen from the pose (x, y, angle)."""
    c, s = F.cos(pose[2]), F.sin(pose[2])
    dx, dy = p[0] - pose[0], p[1] - pose[1]
    return [c * dx + s * dy, c * dy - s * dx]


def from_frame(pose: list[Column], p: list[Column]) -> list[Column]:
    """Point given in the pose's frame, in the outer frame."""
    c, s = F.cos(pose[2]), F.sin(pose[2])
    return [pose[0] + c * p[0] - s * p[1], pose[1] + s * p[0] + c * p[1]]


def pose_difference(a: list[Column], b: list[Column]) -> list[Column]:
    """Pose a (x, y, angle) seen from pose b."""
    return [*to_frame(b, a[:2]), a[2] - b[2]]


def pose_sum(a: list[Column], d: list[Column]) -> list[Column]:
    """Pose a moved by the difference d given in its frame."""
    return [*from_frame(a, d[:2]), a[2] + d[2]]


def nudge(pose: list[Column], d: list[Column]) -> list[Column]:
    """Pose plus a small change, angle wrapped."""
    return [pose[0] + d[0], pose[1] + d[1], wrap(pose[2] + d[2])]


def sonar_project(p: list[Column], model: dict) -> tuple[Column, Column, Column]:
    """(bearing bin, range bin, visible) of a point in the sensor frame."""
    x, y, z = p
    flat = F.sqrt(x * x + y * y)
    far = F.sqrt(x * x + y * y + z * z)
    bearing = (F.atan2(y, x) / model["bearing_fov"] + 0.5) * model["bearings"]
    rng = (far - model["r_min"]) / (model["r_max"] - model["r_min"]) * model["ranges"]
    lift = F.atan2(z, flat) / model["elevation_fov"]
    seen = (bearing >= 0) & (bearing < model["bearings"]) & (rng >= 0) & (rng < model["ranges"]) & (F.abs(lift) <= 0.5)
    return bearing, rng, seen


def sonar_frustum(model: dict) -> list[tuple[float, float, float]]:
    """Eight corners of the viewed volume in the sensor frame, near ones first."""
    yaw, pitch = model["bearing_fov"] / 2, model["elevation_fov"] / 2
    out = []
    for r in (model["r_min"], model["r_max"]):
        for sy, sp in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
            a, b = sy * yaw, sp * pitch
            out.append((r * math.cos(a) * math.cos(b), r * math.sin(a) * math.cos(b), -r * math.sin(b)))
    return out
