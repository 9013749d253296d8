"""Iterative neighbourhood operators on meshes and point alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import aggregates
from geoloom.operators.joins import nearest_within
from geoloom.operators.mesh import neighbours, vertex_border
from geoloom.session import checkpoint


def umbrella(verts: DataFrame, links: DataFrame, step: float, axes: Sequence[str] = "xyz") -> DataFrame:
    """Move each linked vertex by ``step`` toward the mean of its neighbours."""
    far = verts.select(F.col("vid").alias("nb"), *[F.col(a).alias(f"_{a}") for a in axes])
    mean = links.join(far, "nb").groupBy("vid").agg(*[F.avg(f"_{a}").alias(f"_{a}") for a in axes])
    out = verts.join(mean, "vid", "left")
    for a in axes:
        out = out.withColumn(a, F.when(F.col(f"_{a}").isNotNull(), F.col(a) + (F.col(f"_{a}") - F.col(a)) * step).otherwise(F.col(a)))
    return out.select(*verts.columns)


def smooth(verts: DataFrame, faces: DataFrame, steps: Sequence[float], rounds: int, fix_border: bool = True) -> DataFrame:
    """Rounds of umbrella steps; border vertices stay when ``fix_border``.

    The link table is written once; positions are checkpointed after every round so the
    plan does not grow with the number of rounds.
    """
    links = neighbours(faces)
    if fix_border:
        links = links.join(vertex_border(faces).where("is_border").select("vid"), "vid", "left_anti")
    links = checkpoint(links)
    out = verts
    for i in range(rounds):
        for s in steps:
            out = umbrella(out, links, s)
        if i + 1 < rounds:
            out = checkpoint(out)
    return out


TAUBIN = (0.330, -0.331)  # fixed values: shrink and grow weights


def diffuse(verts: DataFrame, faces: DataFrame, values: Sequence[str], sigma: float, sigma_value: float | None = None) -> DataFrame:
    """Gaussian mean of ``values`` over each vertex and its neighbours.

    With ``sigma_value`` the weight also falls with the difference in value (bilateral).
    """
    ring = neighbours(faces).unionByName(verts.select("vid", F.col("vid").alias("nb")))
    pos = list("xyz")
    names = list(dict.fromkeys([*pos, *values]))
    mine = verts.select("vid", *[F.col(c).alias(f"_m{c}") for c in names])
    theirs = verts.select(F.col("vid").alias("nb"), *[F.col(c).alias(f"_t{c}") for c in names])
    j = ring.join(mine, "vid").join(theirs, "nb")
    d2 = sum(((F.col(f"_m{c}") - F.col(f"_t{c}")) ** 2 for c in pos), start=F.lit(0.0))
    w = F.exp(d2 * (-0.5 / sigma**2))
    if sigma_value is not None:
        v2 = sum(((F.col(f"_m{c}") - F.col(f"_t{c}")) ** 2 for c in values), start=F.lit(0.0))
        w = w * F.exp(v2 * (-0.5 / sigma_value**2))
    j = j.withColumn("_w", w)
    mean = j.groupBy("vid").agg(*[(F.sum(F.col("_w") * F.col(f"_t{c}")) / F.sum("_w")).alias(c) for c in values])
    return verts.drop(*values).join(mean, "vid")


def icp(
    src: DataFrame, dst: DataFrame, sid: str, saxes: Sequence[str], did: str, daxes: Sequence[str], max_dist: float, rounds: int
) -> tuple[DataFrame, list[dict]]:
    """Iterated nearest-pair alignment of ``src`` to ``dst`` (rotation and translation).

    Each round pairs every point with its nearest within ``max_dist``; only the sums of
    the pairs reach the driver.
    """
    cur, log = src, []
    target = dst.select(F.col(did).alias("nid"), *[F.col(d).alias(f"_d{i}") for i, d in enumerate(daxes)])
    for i in range(rounds):
        near = nearest_within(cur, dst, sid, saxes, did, daxes, max_dist).where(F.col("nid").isNotNull())
        pairs = checkpoint(near.join(target, "nid"))
        fit = aggregates.rigid_align(pairs, saxes, [f"_d{i}" for i in range(len(daxes))], scaled=False)
        err = pairs.agg(F.avg("dist")).first()[0]
        log.append({"round": i, "mean_dist": err, **fit})
        rot, move = fit["rot"], fit["move"]
        moved = [
            (sum((F.col(b) * float(rot[r, c]) for c, b in enumerate(saxes)), start=F.lit(float(move[r])))).alias(a)
            for r, a in enumerate(saxes)
        ]
        cur = checkpoint(cur.select(*[c for c in cur.columns if c not in saxes], *moved))
    return cur, log
