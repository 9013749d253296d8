"""Aggregates over points and values; every one combines before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import geom as G
from geoloom.operators.knn import knn_points
from geoloom.operators.ordering import running_sums, with_order
from geoloom.session import stored, with_scalars

Keys = Sequence[str]


def bbox(df: DataFrame, axes: Keys, group: str) -> DataFrame:
    """Bounds per group and over all rows (group null)."""
    aggs = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))]
    return df.rollup(group).agg(*aggs)


def bounding_sphere(df: DataFrame, axes: Keys) -> DataFrame:
    """Sphere around all points: centre of the widest extreme pair, radius to the farthest point.

    Seven directions give the pairs, as in the usual growing method; the radius is taken
    in one pass instead of growing in row order, so the answer does not depend on order.
    """
    x, y, z = (F.col(a) for a in axes)
    dirs = [x, y, z, x + y + z, x + y - z, x - y + z, x - y - z]
    pos = [F.col(a).alias(n) for a, n in zip(axes, "xyz")]
    ends = df.agg(
        *[f(F.struct(d.alias("d"), *pos)).alias(f"{n}{i}") for i, d in enumerate(dirs) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    pairs = F.array(
        *[
            F.struct(
                sum(((F.col(f"hi{i}")[c] - F.col(f"lo{i}")[c]) ** 2 for c in "xyz"), start=F.lit(0.0)).alias("w"),
                F.lit(-i).alias("first"),
                *[((F.col(f"hi{i}")[c] + F.col(f"lo{i}")[c]) / 2).alias(f"c{c}") for c in "xyz"],
            )
            for i in range(len(dirs))
        ]
    )
    centre = ends.select(F.array_max(pairs).alias("p")).select("p.cx", "p.cy", "p.cz")
    gap = G.sub([x, y, z], G.cols("cx", "cy", "cz"))
    far = with_scalars(df, centre).groupBy("cx", "cy", "cz").agg(F.sqrt(F.max(G.dot(gap, gap))).alias("radius"))
    return far


def mean_stdev(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Mean and sample deviation; 0 where undefined."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin with truncation toward zero; outsiders still move the extremes."""
    place = ((F.col(value) - F.lit(low)) * F.lit(float(bins)) / F.lit(high - low)).cast("int")
    inside = (place >= 0) & (place < bins)
    per = df.groupBy(F.when(inside, place).alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    # one row: at most bins + 1 groups came in
    packed = per.agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"),
        F.min("lo").alias("actual_min"),
        F.max("hi").alias("actual_max"),
    )
    return packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "m", "actual_min", "actual_max"
    ).select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit((high - low) / bins)).alias("edge"),
        F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)).alias("n"),
        "actual_min",
        "actual_max",
    )


def _value_counts(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """Distinct values with their count and the number of smaller rows in the key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return running_sums(counts, keys, [value], {"_before": "_n"})


def quantile(df: DataFrame, keys: Keys, value: str, q: float, name: str) -> DataFrame:
    """Exact quantile per key, linear between ranks; 0.5 is the median.

    Equal values are counted first and ranks come from distributed running sums, so a
    key with a third of the rows is neither sorted nor held by one task.
    """
    ranked = _value_counts(df, keys, value)
    totals = ranked.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    on = ranked.join(totals, list(keys)) if keys else with_scalars(ranked, totals)
    at = (F.col("_all") - 1) * F.lit(q)
    lo, hi = F.floor(at), F.ceil(at)
    has = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_n"))
    got = on.where(has(lo) | has(hi)).groupBy(*keys).agg(
        F.max(F.when(has(lo), F.col(value))).alias("_lo"),
        F.max(F.when(has(hi), F.col(value))).alias("_hi"),
        F.max(at - lo).alias("_w"),
    )
    return got.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias(name))


def kth_smallest(df: DataFrame, keys: Keys, value: str, k: int) -> DataFrame:
    """k-th smallest value per key (1-based); keys with fewer rows are absent."""
    ranked = _value_counts(df, keys, value)
    return ranked.where((F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k)).select(*keys, value)


def weighted_median(df: DataFrame, keys: Keys, value: str, weight: str, tie: Keys) -> DataFrame:
    """Weighted median over descending values, blended with the value before it.

    Weights have a floor of 1e-30.  The first row whose running weight reaches half of
    the total decides; s = (half - weight before) / own weight blends with the row before.
    """
    src = df.withColumn("_w", F.greatest(F.col(weight).cast("double"), F.lit(1e-30)))
    ordered = with_order(src, [*keys, F.desc(value), *tie])
    # sums of the partitions, at most a row per partition and key: they tell where half of the weight is reached
    per = ordered.groupBy("_part", *keys).agg(F.sum("_w").alias("_sum"), F.min(value).alias("_least"))
    every = Window.partitionBy(*keys)
    earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "_part", *keys, "_sum", (F.sum("_sum").over(every) / 2).alias("_half"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_carry"), F.min("_least").over(earlier).alias("_above"),
    )
    # rows are summed in another order than partitions, so one that comes as close as rounding is looked at too
    near = F.lit(1e-9) * F.col("_half")
    at = per.where((F.col("_carry") <= F.col("_half") + near) & (F.col("_carry") + F.col("_sum") >= F.col("_half") - near))
    at = stored(at.drop("_sum").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), "halves")
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)], F.col("_part") == F.col("_at_part"))
    inside = ordered.join(F.broadcast(at.withColumnRenamed("_part", "_at_part")), same)
    local = Window.partitionBy("_part", *keys).orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    j = inside.withColumn("_cum", F.coalesce(F.sum("_w").over(local), F.lit(0.0)) + F.col("_carry"))
    reached = F.col("_cum") + F.col("_w") >= F.col("_half")
    got = j.groupBy(*keys).agg(
        F.min(F.when(reached, F.struct("_cum", F.col(value).alias("v"), "_w"))).alias("_at"),
        F.least(F.min(F.when(~reached, F.col(value))), F.min_by("_above", "_part")).alias("_prev"),
        F.first("_half").alias("_half"),
    )
    s = (F.col("_half") - F.col("_at._cum")) / F.col("_at._w")
    blended = s * F.col("_at.v") + (1 - s) * F.col("_prev")
    return got.select(*keys, F.coalesce(blended, F.col("_at.v")).alias("wmedian"))


def plain_weight_mean(df: DataFrame, keys: Keys, value: str, weight: str) -> DataFrame:
    """Sum of values over sum of weights (the values are not weighted)."""
    return df.groupBy(*keys).agg((F.sum(value) / F.sum(F.greatest(F.col(weight).cast("double"), F.lit(1e-30)))).alias("wmean"))


def moments(df: DataFrame, keys: Keys, axes: Keys, weight: Column | None = None) -> DataFrame:
    """Count, weight, weighted centre and second central moments (population form).

    Central moments come from sums about the overall mean, so far-off data keep precision.
    """
    w = weight if weight is not None else F.lit(1.0)
    shift = df.agg(*[F.avg(a).alias(f"_o{a}") for a in axes])
    src = with_scalars(df.withColumn("_w", w), shift)
    rel = {a: F.col(a) - F.col(f"_o{a}") for a in axes}
    sums = [F.count("*").alias("n"), F.sum("_w").alias("weight")]
    sums += [F.first(f"_o{a}").alias(f"_o{a}") for a in axes]
    sums += [F.sum(F.col("_w") * rel[a]).alias(f"_s{a}") for a in axes]
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    sums += [F.sum(F.col("_w") * rel[a] * rel[b]).alias(f"_q{a}{b}") for a, b in pairs]
    out = src.groupBy(*keys).agg(*sums)
    mean = {a: F.col(f"_s{a}") / F.col("weight") for a in axes}
    return out.select(
        *keys,
        "n",
        "weight",
        *[(F.col(f"_o{a}") + mean[a]).alias(f"m{a}") for a in axes],
        *[(F.col(f"_q{a}{b}") / F.col("weight") - mean[a] * mean[b]).alias(f"c{a}{b}") for a, b in pairs],
    )


_NUMBERS = T.ArrayType(T.DoubleType())
_EIGEN = T.StructType([T.StructField("values", _NUMBERS), T.StructField("axes", T.ArrayType(_NUMBERS))])


@F.pandas_udf(_EIGEN)
def eigen3(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """Eigenvalues (descending) and unit axes of symmetric 3x3 matrices, one per row."""
    import numpy as np

    m = np.stack([np.stack(r, axis=-1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=-2)
    val, vec = np.linalg.eigh(m.astype(float))
    val, vec = val[:, ::-1], np.swapaxes(vec, 1, 2)[:, ::-1]
    return pd.DataFrame({"values": val.tolist(), "axes": vec.tolist()})


def with_eigen(mom: DataFrame, name: str = "eig") -> DataFrame:
    return mom.withColumn(name, eigen3("cxx", "cxy", "cxz", "cyy", "cyz", "czz"))


def principal_axes(df: DataFrame, keys: Keys, axes: Keys, weight: Column | None = None) -> DataFrame:
    """Weighted centre, eigenvalues and axes; fewer than four rows give the unit basis."""
    pos = [F.col(a).alias(n) for a, n in zip(axes, "xyz")]
    wt = F.lit(1.0) if weight is None else weight
    mom = moments(df.select(*keys, *pos, wt.alias("_wt")), keys, ["x", "y", "z"], F.col("_wt"))
    for d in ("cxx", "cyy", "czz"):
        mom = mom.withColumn(d, F.when(F.col(d) <= 0, F.lit(1e-30)).otherwise(F.col(d)))
    out = with_eigen(mom)
    few = F.col("n") < 4
    unit = F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)]) for i in range(3)])
    return out.select(
        *keys,
        "n",
        "mx",
        "my",
        "mz",
        F.when(few, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))).otherwise(F.col("eig.values")).alias("values"),
        F.when(few, unit).otherwise(F.col("eig.axes")).alias("axes"),
    )


def plane_fit(df: DataFrame, keys: Keys, axes: Keys) -> DataFrame:
    """Orthogonal best plane per key: unit normal (pointing up), offset and rms distance."""
    p = principal_axes(df, keys, axes)
    n = [F.col("axes")[2][i] for i in range(3)]
    s = F.when(n[2] < 0, F.lit(-1.0)).otherwise(1.0)
    return p.select(
        *keys,
        "n",
        *[(n[i] * s).alias(f"n{c}") for i, c in enumerate("xyz")],
        (-(n[0] * F.col("mx") + n[1] * F.col("my") + n[2] * F.col("mz")) * s).alias("d0"),
        F.sqrt(F.greatest(F.col("values")[2], F.lit(0.0))).alias("rms"),
    )


def ransac_plane(df: DataFrame, axes: Keys, tie: Keys, tries: int, tol: float) -> DataFrame:
    """Plane through three sampled points with the most inliers.

    The sample is the 3 * tries rows with the lowest hash; all candidates are counted in
    one pass over the table.
    """
    x, y, z = axes
    lot = F.md5(F.concat_ws("|", *[F.col(t).cast("string") for t in tie]))
    seeds = df.select(*axes, *tie, lot.alias("_lot")).orderBy("_lot", *tie).limit(3 * tries).collect()
    planes = []
    for i in range(len(seeds) // 3):
        a, b, c = ([float(r[v]) for v in axes] for r in seeds[3 * i : 3 * i + 3])
        u, v = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)]
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        size = sum(k * k for k in n) ** 0.5
        if size > 0:
            n = [k / size for k in n]
            planes.append((*n, -sum(k * p for k, p in zip(n, a))))
    counts = [
        F.sum(F.when(F.abs(F.col(x) * p[0] + F.col(y) * p[1] + F.col(z) * p[2] + p[3]) <= tol, 1).otherwise(0)).cast("bigint").alias(f"k{i}")
        for i, p in enumerate(planes)
    ]
    rows = F.array(
        *[
            F.struct(F.col(f"k{i}").alias("inliers"), F.lit(-i).alias("try"), *[F.lit(v).alias(n) for v, n in zip(p, ("nx", "ny", "nz", "d0"))])
            for i, p in enumerate(planes)
        ]
    )
    return df.agg(*counts, F.count("*").alias("n")).select(F.array_max(rows).alias("b"), "n").select("b.nx", "b.ny", "b.nz", "b.d0", "b.inliers", "n")


def line_fit(df: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    """Least-squares line and the orthogonal one (direction angle) per key."""
    sxx, syy, sxy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        (F.atan2(2 * sxy, sxx - syy) / 2).alias("angle"),
    )


def _centred_sums(df: DataFrame, src: Keys, dst: Keys) -> tuple[int, list[float], list[float], dict[tuple[str, str], float]]:
    """(rows, mean of src, mean of dst, summed products about the means) of matched points.

    The products are summed about the means of a first pass, and what that misses is taken off, so
    points far from the origin lose no digits.  Only a few sums reach the driver.
    """
    names = [*src, *dst]
    df = df.dropna(subset=names)
    first = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    n = first["n"]
    if not n:
        raise ValueError("no matched points")
    rel = {c: F.col(c) - F.lit(float(first[c])) for c in names}
    pairs = [(a, b) for a in src for b in names] + [(b, b) for b in dst]
    sums = df.agg(*[F.sum(rel[c]).alias(f"s_{c}") for c in names], *[F.sum(rel[a] * rel[b]).alias(f"p_{a}_{b}") for a, b in pairs]).first()
    rest = {c: sums[f"s_{c}"] / n for c in names}
    mean = {c: float(first[c]) + rest[c] for c in names}
    return n, [mean[c] for c in src], [mean[c] for c in dst], {(a, b): sums[f"p_{a}_{b}"] - n * rest[a] * rest[b] for a, b in pairs}


def rigid_align(df: DataFrame, src: Keys, dst: Keys, scaled: bool = True) -> dict:
    """Best rotation, scale (1 unless ``scaled``) and translation from ``src`` to ``dst`` points.

    The decomposition of the small cross matrix is done on the driver; rows with a null do not count.
    """
    import numpy as np

    n, ma, mb, p = _centred_sums(df, src, dst)
    cross = np.array([[p[a, b] for b in dst] for a in src]) / n
    var = sum(p[a, a] for a in src) / n
    u, sig, vt = np.linalg.svd(cross.T)
    fix = np.diag([1.0] * (len(src) - 1) + [float(np.sign(np.linalg.det(u @ vt)))])
    rot = u @ fix @ vt
    scale = float((sig * np.diag(fix)).sum() / var) if scaled and var > 0 else 1.0
    return {"n": n, "rot": rot, "scale": scale, "move": np.array(mb) - scale * rot @ np.array(ma)}


def affine_align(df: DataFrame, src: Keys, dst: Keys) -> dict:
    """Least-squares affine map from ``src`` to ``dst`` points."""
    import numpy as np

    _, ma, mb, p = _centred_sums(df, src, dst)
    own = np.array([[p[a, b] for b in src] for a in src])
    matrix = np.linalg.lstsq(own, np.array([[p[a, b] for b in dst] for a in src]), rcond=None)[0].T
    return {"matrix": matrix, "move": np.array(mb) - matrix @ np.array(ma)}


def normalise_variance(df: DataFrame, axes: Keys) -> DataFrame:
    """Centre the points and scale them to a mean squared distance of 1."""
    first = df.agg(*[F.avg(a).alias(f"_m{a}") for a in axes], *[F.var_pop(a).alias(f"_v{a}") for a in axes])
    total = sum((F.col(f"_v{a}") for a in axes), start=F.lit(0.0))
    scale = first.select(*[f"_m{a}" for a in axes], F.when(total > 0, 1 / F.sqrt(total)).otherwise(1.0).alias("_k"))
    j = with_scalars(df, scale)
    return j.select(*[c for c in df.columns if c not in axes], *[((F.col(a) - F.col(f"_m{a}")) * F.col("_k")).alias(a) for a in axes])


def rotate_to_axes(df: DataFrame, axes: Keys) -> DataFrame:
    """Express the points in their principal axes (largest spread first)."""
    p = principal_axes(df, [], axes).select("axes", "mx", "my", "mz")
    j = with_scalars(df, p)
    rel = G.sub([F.col(a) for a in axes], G.cols("mx", "my", "mz"))
    return j.select(
        *[c for c in df.columns if c not in axes],
        *[G.dot([F.col("axes")[i][k] for k in range(3)], rel).alias(a) for i, a in enumerate(axes)],
    )


def blend_views(views: DataFrame, pixel: str, bands: Sequence[tuple[Column, float]], u: Column, v: Column, ok: Column) -> DataFrame:
    """Per pixel sum over bands of the weighted mean of its views.

    A view weighs exp(-160 c r) with r the distance to the image centre and c the band's
    constant; views outside the image do not count.  Pixels without a view get null.
    """
    r = F.sqrt((u - 0.5) * (u - 0.5) + (v - 0.5) * (v - 0.5))
    valid = ok & (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
    total = None
    for value, c in bands:
        w = F.when(valid, F.exp(-r * (160.0 * c)))
        part = F.sum(w * value) / F.sum(w)
        total = part if total is None else total + part
    return views.groupBy(pixel).agg(total.alias("blended"))


def track_stats(obs: DataFrame, point: str, cam: str) -> DataFrame:
    """Per camera: observations, distinct points, and points seen by at least two cameras."""
    pairs = obs.groupBy(point, cam).agg(F.count("*").alias("_n"))
    seen = pairs.groupBy(point).agg(F.count("*").alias("_views"))
    return pairs.join(seen, point).groupBy(cam).agg(
        F.sum("_n").alias("n_obs"),
        F.count("*").alias("n_points"),
        F.sum((F.col("_views") >= 2).cast("bigint")).alias("n_shared"),
    )


def distance_stats(near: DataFrame, dist: str) -> DataFrame:
    d = F.col(dist)
    return near.agg(F.count(d).alias("n"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.sqrt(F.avg(d * d)).alias("rms"))


def two_sided_distance(there: DataFrame, back: DataFrame, dist: str) -> DataFrame:
    """Statistics of the distances from each of two surfaces to the other, and the larger of the two maxima.

    ``there`` and ``back`` have a row per sample point of one surface, with its distance to the other.
    """
    names = ("n", "max", "mean", "rms")
    one = distance_stats(there, dist)
    other = distance_stats(back, dist).select(*[F.col(c).alias(f"back_{c}") for c in names])
    return with_scalars(one, other).withColumn("hausdorff", F.greatest("max", "back_max"))


def rank_with_ties(df: DataFrame, keys: Keys, order: Column | str, k: int) -> DataFrame:
    """Rows of rank <= k per key; every tie at rank k stays.

    The k first rows of a key tell which values are in and their ranks; the rows are then found by value,
    so that the ties of a key need not come together.
    """
    valued = df.withColumn("_order", F.col(order) if isinstance(order, str) else order)
    first = valued.select(*keys, "_order").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_order"))).where(F.col("_n") <= k)
    ranks = first.groupBy(*keys, "_order").agg(F.min("_n").alias("rank")).toDF(*[f"_k{i}" for i in range(len(keys))], "_v", "rank")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)] + [F.col("_order").eqNullSafe(F.col("_v"))]
    return valued.join(ranks, reduce(Column.__and__, same)).select(*df.columns, "rank")


def point_normals(pts: DataFrame, pid: str, axes: Keys, k: int = 12) -> DataFrame:
    """Plane normal over the k nearest neighbours, pointing to +z; (0, 0, 1) below three of them."""
    near = knn_points(pts, pts, pid, axes, pid, axes, k, exclude_same_id=True).select(pid, "nid")
    other = pts.select(F.col(pid).alias("nid"), *[F.col(a).alias(f"_n{i}") for i, a in enumerate(axes)])
    j = near.join(pts.select(pid, *axes), pid).join(other, "nid")
    d = {n: F.col(f"_n{i}") - F.col(a) for i, (n, a) in enumerate(zip("xyz", axes))}
    mom = j.groupBy(pid).agg(
        F.count("*").alias("n"), *[F.sum(d[a] * d[b]).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    )
    out = with_eigen(mom)
    up = F.col("eig.axes")[2]
    s = F.when(up[2] < 0, F.lit(-1.0)).otherwise(1.0)
    few = F.col("n") < 3
    return out.select(
        pid,
        "n",
        *[F.when(few, F.lit(float(i == 2))).otherwise(up[i] * s).alias(f"n{c}") for i, c in enumerate("xyz")],
        F.col("eig.values")[2].alias("spread"),
    )
