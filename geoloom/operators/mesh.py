"""Measures and rewrites of meshes held as a vertex and a face table.

Vertices have ``vid`` (unique), position and any attributes; faces have ``fid`` and
``v0, v1, v2``.  Rewrites return new tables and keep all other columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geom as G
from geoloom.operators import aggregates
from geoloom.operators.filters import face_points
from geoloom.operators.graph import components, label_all
from geoloom.operators.gridjoin import Axis, box_join
from geoloom.operators.ordering import row_numbers, running_sums
from geoloom.session import checkpoint, with_scalars

CORNERS = ("v0", "v1", "v2")


def corner_vectors() -> list[list[Column]]:
    return [G.cols(*(f"{t}{c}" for c in "xyz")) for t in "abc"]


def corners(faces: DataFrame) -> DataFrame:
    """One row per face corner: fid, k (0..2), vid."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).alias("vid")) for k, v in enumerate(CORNERS)])
    return faces.select(*[c for c in faces.columns if c not in CORNERS], F.inline(rows))


def directed_edges(faces: DataFrame) -> DataFrame:
    rows = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("s"), F.col(f"v{(k + 1) % 3}").alias("d")) for k in range(3)]
    )
    return faces.select("fid", F.inline(rows))


def edges(faces: DataFrame) -> DataFrame:
    """Undirected edges (a < b) with the number of faces that use them."""
    e = directed_edges(faces)
    return e.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.count("*").alias("n"))


def neighbours(faces: DataFrame) -> DataFrame:
    """Distinct (vid, nb) pairs, both ways."""
    e = edges(faces).select("a", "b")
    both = F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("nb")), F.struct(F.col("b").alias("vid"), F.col("a").alias("nb")))
    return e.select(F.inline(both))


def vertex_border(faces: DataFrame) -> DataFrame:
    """Neighbour and face counts per used vertex; they differ exactly on the border."""
    nn = neighbours(faces).groupBy("vid").agg(F.count("*").alias("n_neighbours"))
    nf = corners(faces).groupBy("vid").agg(F.count("*").alias("n_faces"))
    return nn.join(nf, "vid").withColumn("is_border", F.col("n_neighbours") != F.col("n_faces"))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """Face across each directed edge, -1 on the border; the lowest id if there are more."""
    e = directed_edges(faces)
    across = e.groupBy(F.col("d").alias("s"), F.col("s").alias("d")).agg(F.min("fid").alias("across"))
    return e.join(across, ["s", "d"], "left").select("fid", "k", "s", "d", F.coalesce("across", F.lit(-1).cast("bigint")).alias("across"))


# measures


def face_measures(tri: DataFrame) -> DataFrame:
    a, b, c = corner_vectors()
    n = G.cross(G.sub(b, a), G.sub(c, a))
    mid = [(p + q + r) / 3 for p, q, r in zip(a, b, c)]
    return tri.select(
        "*",
        (G.magnitude(n) / 2).alias("area"),
        G.signed_volume(a, b, c).alias("volume"),
        *[v.alias(f"n{x}") for x, v in zip("xyz", n)],
        *[v.alias(f"m{x}") for x, v in zip("xyz", mid)],
    )


def edge_lengths(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Distinct edges with squared length."""
    e = edges(faces)
    for tag in "ab":
        e = e.join(verts.select(F.col("vid").alias(tag), *[F.col(c).alias(f"{tag}{c}") for c in "xyz"]), tag)
    gap = G.sub(G.cols("ax", "ay", "az"), G.cols("bx", "by", "bz"))
    return e.select("a", "b", "n", G.dot(gap, gap).alias("l2"))


def feature_size(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Root of the median squared edge length over all face edges (one row)."""
    a, b, c = corner_vectors()
    sides = F.array(*[G.dot(g, g) for g in (G.sub(b, a), G.sub(c, b), G.sub(a, c))])
    l2 = face_points(faces, verts).select(F.explode(sides).alias("l2"))
    return aggregates.quantile(l2, [], "l2", 0.5, "m").select(F.sqrt("m").alias("size"))


def vertex_normals(tri: DataFrame) -> DataFrame:
    """Unit normal per vertex: face cross products over the product of the squared sides at the corner."""
    a, b, c = corner_vectors()
    ab, bc, ca = G.sub(a, b), G.sub(b, c), G.sub(c, a)
    l_ab, l_bc, l_ca = (G.dot(v, v) for v in (ab, bc, ca))
    n = G.cross(ab, bc)
    weights = [1.0 / (l_ab * l_ca), 1.0 / (l_bc * l_ab), 1.0 / (l_ca * l_bc)]
    rows = F.array(
        *[F.struct(F.col(v).alias("vid"), *[(x * w).alias(f"n{t}") for t, x in zip("xyz", n)]) for v, w in zip(CORNERS, weights)]
    )
    total = tri.select(F.inline(rows)).groupBy("vid").agg(*[F.sum(f"n{t}").alias(f"n{t}") for t in "xyz"])
    unit = G.normalise(G.cols("nx", "ny", "nz"))
    return total.select("vid", *[u.alias(f"n{t}") for t, u in zip("xyz", unit)])


def point_areas(tri: DataFrame) -> DataFrame:
    """Surface share per vertex: a corner owns the part of its faces that is nearer to it than to the others.

    In a face without an obtuse angle this part is bounded by half of the two sides at the corner and
    the bisectors on them, which gives side^2 cot(opposite angle) / 8 for each side.  Where another
    corner is obtuse, the bisector of the side to it cuts off a right triangle, side^2 tan(own angle)
    / 8; the obtuse corner owns what is left.  Faces without area give nothing.
    """
    p = corner_vectors()
    arm = {(i, j): G.sub(p[j], p[i]) for i in range(3) for j in range(3) if i != j}
    sides = ((0, 1), (0, 2), (1, 2))
    known = tri.select(
        *CORNERS,
        (G.magnitude(G.cross(arm[0, 1], arm[0, 2])) / 2).alias("area"),
        *[G.dot(arm[i, (i + 1) % 3], arm[i, (i + 2) % 3]).alias(f"dot{i}") for i in range(3)],
        *[G.dot(arm[s], arm[s]).alias(f"sq{s[0]}{s[1]}") for s in sides],
    ).where("area > 0")
    area = F.col("area")
    dot = G.cols("dot0", "dot1", "dot2")

    def square(i: int, j: int) -> Column:
        return F.col(f"sq{min(i, j)}{max(i, j)}")

    def cot(i: int) -> Column:
        return dot[i] / (2 * area)

    def cut_off(i: int, obtuse: int) -> Column:
        return square(i, obtuse) * (2 * area / dot[i]) / 8

    shares = []
    for i in range(3):
        j, k = (n for n in range(3) if n != i)
        whole = (square(i, j) * cot(k) + square(i, k) * cot(j)) / 8
        shares.append(
            F.when(dot[i] <= 0, area - cut_off(j, i) - cut_off(k, i)).when(dot[j] <= 0, cut_off(i, j)).when(dot[k] <= 0, cut_off(i, k)).otherwise(whole)
        )
    rows = F.array(*[F.struct(F.col(v).alias("vid"), s.alias("share")) for v, s in zip(CORNERS, shares)])
    return known.select(F.inline(rows)).groupBy("vid").agg(F.sum("share").alias("area"))


def mesh_report(faces: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Counts per mesh, Euler characteristic and the longest border loop (in edges)."""
    of_face = faces.select("fid", mesh)
    e = (
        directed_edges(faces)
        .join(of_face, "fid")
        .groupBy(mesh, F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"))
        .agg(F.count("*").alias("n"))
    )
    n_v = corners(faces).select(mesh, "vid").distinct().groupBy(mesh).agg(F.count("*").alias("n_vertices"))
    n_e = e.groupBy(mesh).agg(F.count("*").alias("n_edges"), F.sum((F.col("n") == 1).cast("bigint")).alias("n_border"))
    n_f = faces.groupBy(mesh).agg(F.count("*").alias("n_faces"))
    rim = checkpoint(e.where("n = 1").select(mesh, "a", "b"))
    loop = rim.join(components(rim, "a", "b").withColumnRenamed("id", "a"), "a").groupBy(mesh, "comp").agg(F.count("*").alias("_len"))
    longest = loop.groupBy(mesh).agg(F.max("_len").alias("longest_loop"))
    return (
        n_f.join(n_e, mesh)
        .join(n_v, mesh)
        .join(longest, mesh, "left")
        .withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))
        .withColumn("longest_loop", F.coalesce("longest_loop", F.lit(0)))
    )


# rewrites


def remap(faces: DataFrame, mapping: DataFrame, old: str = "vid", new: str = "rep") -> DataFrame:
    """Replace corner ids through a (old, new) table; unmapped ids stay."""
    out = faces
    for v in CORNERS:
        m = mapping.select(F.col(old).alias(v), F.col(new).alias("_to"))
        out = out.join(m, v, "left").withColumn(v, F.coalesce("_to", v)).drop("_to")
    return out.select(*faces.columns)


def drop_collapsed(faces: DataFrame) -> DataFrame:
    return faces.where("v0 <> v1 AND v1 <> v2 AND v2 <> v0")


def drop_degenerate(faces: DataFrame, verts: DataFrame) -> DataFrame:
    """Drop faces with repeated corners or zero area."""
    tri = face_points(drop_collapsed(faces), verts)
    return tri.where(G.triangle_area(*corner_vectors()) > 0).select(*faces.columns)


def dedup_faces(faces: DataFrame) -> DataFrame:
    """Keep the lowest face id among faces with the same corner set."""
    rest = [c for c in faces.columns if c != "fid"]
    best = faces.groupBy(F.array_sort(F.array(*CORNERS)).alias("_set")).agg(F.min(F.struct("fid", *rest)).alias("_f"))
    return best.select("_f.*").select(*faces.columns)


def merge_meshes(verts: DataFrame, faces: DataFrame, mesh: str, local: str) -> tuple[DataFrame, DataFrame]:
    """Concatenate meshes with local vertex numbers; corner ids shift by earlier vertex counts."""
    counts = verts.groupBy(mesh).agg(F.count("*").alias("_n"))
    shift = running_sums(counts, [], [mesh], {"_shift": "_n"}).select(mesh, "_shift")
    v = verts.join(shift, mesh).withColumn("vid", F.col(local) + F.col("_shift")).drop("_shift")
    f = faces.join(shift, mesh)
    for c in CORNERS:
        f = f.withColumn(c, F.col(c) + F.col("_shift"))
    return v, f.drop("_shift")


def unshare(faces: DataFrame, verts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give every face corner its own vertex, numbered 3 f + k in face order."""
    numbered = checkpoint(row_numbers(faces, ["fid"], "_f"))
    base = (F.col("_f") - 1) * 3
    new_faces = numbered.select(
        *[c for c in faces.columns if c not in CORNERS], *[(base + k).alias(v) for k, v in enumerate(CORNERS)]
    ).select(*faces.columns)
    corner = corners(numbered).select(((F.col("_f") - 1) * 3 + F.col("k")).alias("new_vid"), "vid")
    new_verts = corner.join(verts, "vid").withColumn("vid", F.col("new_vid")).drop("new_vid")
    return new_verts, new_faces


def dedup_vertices(verts: DataFrame, faces: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Merge vertices that agree in ``keys``; the lowest id stays."""
    low = verts.groupBy(*keys).agg(F.min("vid").alias("rep"))
    mapping = verts.join(low, list(keys)).select("vid", "rep")
    kept = verts.join(low.select(F.col("rep").alias("vid")), "vid", "left_semi")
    return kept, remap(faces, mapping)


def close_groups(verts: DataFrame, radius: float) -> DataFrame:
    """(vid, rep): vertices chained by distances up to ``radius``, lowest id first.

    Vertices in one small cell (diagonal below the radius) are in one group without any
    pair test; only pairs of different cells are tested, and they collapse to cell pairs
    before any shuffle.
    """
    small = radius / 3.0**0.5 * (1.0 - 1e-9)
    cell = [F.floor(F.col(c) / F.lit(small)).cast("bigint").alias(f"_c{c}") for c in "xyz"]
    pos = verts.select("vid", "x", "y", "z", *cell)
    heads = pos.groupBy("_cx", "_cy", "_cz").agg(F.min("vid").alias("head"))
    placed = checkpoint(pos.join(heads, ["_cx", "_cy", "_cz"]).select("vid", "x", "y", "z", "head"))
    spots = placed.groupBy("x", "y", "z").agg(F.min("head").alias("head"))
    a = spots.select(*[F.col(c).alias(f"a{c}") for c in "xyz"], F.col("head").alias("a_head"))
    b = spots.select(*[F.col(c).alias(f"b{c}") for c in "xyz"], F.col("head").alias("b_head"))
    axes = []
    for c in "xyz":
        b = b.withColumn(f"_l{c}", F.col(f"b{c}") - radius).withColumn(f"_h{c}", F.col(f"b{c}") + radius)
        axes.append(Axis(f"a{c}", f"a{c}", f"_l{c}", f"_h{c}", 2.0 * radius))
    gap = G.sub(G.cols("ax", "ay", "az"), G.cols("bx", "by", "bz"))
    near = (F.col("a_head") < F.col("b_head")) & (G.dot(gap, gap) <= radius * radius)
    links = box_join(a, b, axes, near).select("a_head", "b_head").distinct()
    lab = label_all(placed.select(F.col("head")).distinct(), "head", links, "a_head", "b_head")
    out = placed.select("vid", "head").join(lab, "head")
    rep = out.groupBy("comp").agg(F.min("vid").alias("rep"))
    return out.join(rep, "comp").select("vid", "rep")


def merge_close(verts: DataFrame, faces: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    groups = checkpoint(close_groups(verts, radius))
    kept = verts.join(groups.where("vid = rep"), "vid", "left_semi")
    return kept, drop_collapsed(remap(faces, groups))


def cluster_vertices(
    verts: DataFrame, faces: DataFrame, size: float, values: Sequence[str], within: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """One averaged vertex per grid cell; collapsed and duplicate faces go."""
    cell = [F.floor(F.col(c) / F.lit(size)).cast("bigint").alias(f"_c{c}") for c in "xyz"]
    keys = [*within, "_cx", "_cy", "_cz"]
    placed = verts.select("*", *cell)
    reps = placed.groupBy(*keys).agg(F.min("vid").alias("rep"), F.count("*").alias("merged"), *[F.avg(v).alias(v) for v in values])
    mapping = placed.join(reps.select(*keys, "rep"), keys).select("vid", "rep")
    out = reps.select(F.col("rep").alias("vid"), *within, *values, "merged")
    return out, dedup_faces(drop_collapsed(remap(faces, mapping)))


def drop_unreferenced(verts: DataFrame, faces: DataFrame) -> DataFrame:
    return verts.join(corners(faces).select("vid"), "vid", "left_semi")


def drop_listed(df: DataFrame, order: Sequence[str], drop: DataFrame, index: str) -> DataFrame:
    """Remove rows by 0-based place; repeated and out-of-range places do nothing."""
    numbered = row_numbers(df, order, "_place").withColumn("_place", F.col("_place") - 1)
    return numbered.join(drop.select(F.col(index).alias("_place")), "_place", "left_anti").drop("_place")


def longest_side2() -> Column:
    a, b, c = corner_vectors()
    return F.greatest(*[G.dot(g, g) for g in (G.sub(b, a), G.sub(c, b), G.sub(a, c))])


def drop_long_edges(faces: DataFrame, verts: DataFrame, limit: float | None = None, quantile: float | None = None) -> DataFrame:
    """Drop faces with a side longer than ``limit`` or than a quantile of all edges."""
    tri = face_points(faces, verts)
    if limit is None:
        lens = edge_lengths(faces, verts).select(F.sqrt("l2").alias("len"))
        cut = aggregates.quantile(lens, [], "len", quantile, "_cut")
        tri = with_scalars(tri, cut)
        return tri.where(F.sqrt(longest_side2()) <= F.col("_cut")).select(*faces.columns)
    return tri.where(F.sqrt(longest_side2()) <= F.lit(limit)).select(*faces.columns)


def drop_slivers(faces: DataFrame, verts: DataFrame, factor: float = 4.0, cos2: float = 0.85) -> DataFrame:
    """Drop large faces whose smallest angle is very sharp.

    A face goes when some side reaches ``factor`` feature sizes and the squared cosine of
    its smallest angle reaches ``cos2``.
    """
    tri = with_scalars(face_points(faces, verts), feature_size(faces, verts))
    a, b, c = corner_vectors()
    sides = F.array_sort(F.array(*[G.dot(g, g) for g in (G.sub(b, a), G.sub(c, b), G.sub(a, c))]))
    low, mid, high = (sides[i] for i in range(3))
    # law of cosines at the corner opposite the shortest side
    twice = mid + high - low
    sharp = twice * twice / F.when(mid > 0, 4.0 * mid * high)
    big = high >= F.col("size") * F.col("size") * (factor * factor)
    return tri.where(~(big & F.coalesce(sharp >= cos2, F.lit(True)))).select(*faces.columns)


def vertex_components(faces: DataFrame) -> DataFrame:
    return components(edges(faces), "a", "b").withColumnRenamed("id", "vid")


def drop_small_components(
    verts: DataFrame, faces: DataFrame, share: float | None = None, min_faces: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep components whose box diagonal reaches ``share`` of the whole, or by face count."""
    comp = checkpoint(vertex_components(faces))
    v = verts.join(comp, "vid")
    if share is not None:
        size = lambda src: G.magnitude([F.max(c) - F.min(c) for c in "xyz"])
        whole = v.agg(size(v).alias("_all"))
        per = v.groupBy("comp").agg(size(v).alias("_diag"))
        keep = with_scalars(per, whole).where(F.col("_diag") >= F.col("_all") * share).select("comp")
    else:
        per = faces.join(comp.withColumnRenamed("vid", "v0"), "v0").groupBy("comp").agg(F.count("*").alias("_n"))
        keep = per.where(F.col("_n") >= min_faces).select("comp")
    kept = v.join(keep, "comp", "left_semi").drop("comp")
    return kept, faces.join(kept.select(F.col("vid").alias("v0")), "v0", "left_semi").select(*faces.columns)


def erode(verts: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove border vertices and every face that touches one."""
    rim = vertex_border(faces).where("is_border").select("vid")
    hit = corners(faces).join(rim, "vid", "left_semi").select("fid").distinct()
    return verts.join(rim, "vid", "left_anti"), faces.join(hit, "fid", "left_anti")


def flip(faces: DataFrame) -> DataFrame:
    swap = {"v0": "v2", "v2": "v0"}
    return faces.select(*[F.col(swap.get(c, c)).alias(c) for c in faces.columns])


def split_seam(corner: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """New vertex number per distinct (vid, attributes) over corner rows (fid, k, vid, ...)."""
    uses = corner.groupBy("vid", *attrs).agg(F.count("*").alias("_n"))
    ids = row_numbers(uses, ["vid", *attrs], "new_vid").withColumn("new_vid", F.col("new_vid") - 1).drop("_n")
    return corner.join(ids, ["vid", *attrs])


def flat_normals(tri: DataFrame) -> DataFrame:
    """Corner rows with position and the unit face normal."""
    a, b, c = corner_vectors()
    n = G.normalise(G.cross(G.sub(b, a), G.sub(c, a)))
    named = [u.alias(f"n{t}") for t, u in zip("xyz", n)]
    rows = F.array(
        *[F.struct(F.lit(k).alias("k"), F.col(v).alias("vid"), *[x.alias(t) for t, x in zip("xyz", p)]) for k, (v, p) in enumerate(zip(CORNERS, (a, b, c)))]
    )
    return tri.select("fid", *named, F.inline(rows))


def split_crease(faces: DataFrame, verts: DataFrame, cos_limit: float) -> DataFrame:
    """(fid, k, vid, part): corners of one vertex in different parts are across a crease.

    Corners of a shared edge are linked when the two face normals differ by no more than
    the angle; a part is a connected set of corners, named by its lowest corner number.
    """
    tri = face_points(faces, verts)
    a, b, c = corner_vectors()
    n = G.normalise(G.cross(G.sub(b, a), G.sub(c, a)))
    normal = checkpoint(tri.select("fid", *[u.alias(f"n{t}") for t, u in zip("xyz", n)]))
    pairs = face_adjacency(faces).where("across >= 0 AND fid < across")
    other = normal.select(F.col("fid").alias("across"), *[F.col(f"n{t}").alias(f"m{t}") for t in "xyz"])
    smooth = pairs.join(normal, "fid").join(other, "across").where(
        G.dot(G.cols("nx", "ny", "nz"), G.cols("mx", "my", "mz")) >= cos_limit
    )
    ends = smooth.select("fid", "across", F.explode(F.array("s", "d")).alias("vid"))
    corner = checkpoint(corners(faces).select("fid", "k", "vid", (F.col("fid") * 3 + F.col("k")).alias("cid")))
    mine = ends.join(corner.select("fid", "vid", "cid"), ["fid", "vid"])
    links = mine.join(corner.select(F.col("fid").alias("across"), "vid", F.col("cid").alias("cid2")), ["across", "vid"])
    lab = label_all(corner, "cid", links.select("cid", "cid2"), "cid", "cid2")
    return lab.select("fid", "k", "vid", F.col("comp").alias("part"))


def orient(faces: DataFrame) -> DataFrame:
    """Make winding agree across shared edges, led by the lowest face of each component.

    Each face is two nodes, kept (2 f) and flipped (2 f + 1).  Faces that already agree
    link equal nodes, others link crossed ones.  The component of node 2 f then shows
    which of the two states of the leading face fits.
    """
    und = directed_edges(faces).select("fid", F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b"), (F.col("s") < F.col("d")).alias("up"))
    # chain the faces of an edge to its lowest face: linear, also for edges with many faces
    lead = und.groupBy("a", "b").agg(F.min(F.struct("fid", "up")).alias("l"))
    pairs = und.join(lead, ["a", "b"]).where(F.col("fid") != F.col("l.fid"))
    cross = (F.col("up") == F.col("l.up")).cast("int")
    links = pairs.select(
        F.inline(
            F.array(
                *[F.struct((F.col("l.fid") * 2 + s).alias("a"), (F.col("fid") * 2 + F.abs(cross - s)).alias("b")) for s in (0, 1)]
            )
        )
    )
    comp = components(links, "a", "b").where("id % 2 = 0").select(F.expr("id div 2").alias("fid"), (F.col("comp") % 2).alias("_flip"))
    out = faces.join(comp, "fid", "left").withColumn("_flip", F.coalesce("_flip", F.lit(0)) == 1)
    return out.select(
        *[F.when(F.col("_flip"), F.col({"v0": "v2", "v2": "v0"}[c])).otherwise(F.col(c)).alias(c) if c in ("v0", "v2") else F.col(c) for c in faces.columns]
    )


def triangulate_grid(grid: DataFrame, col: str, row: str, vid: str, pos: Sequence[str], slivers: bool = True) -> DataFrame:
    """Triangles from valid grid cells; without ``slivers`` large sharp faces are dropped at the end.

    Every cell reports to the four squares it is a corner of; one aggregate per square
    then sees up to four corners.  Four corners split along the shorter diagonal, three
    give one triangle, fewer none.
    """
    packed = F.struct(F.col(vid).alias("vid"), *[F.col(p).alias(t) for p, t in zip(pos, "xyz")])
    roles = [("ll", 0, 0), ("lr", 1, 0), ("ul", 0, 1), ("ur", 1, 1)]
    rows = F.array(
        *[F.struct((F.col(col) - dx).alias("qc"), (F.col(row) - dy).alias("qr"), F.lit(n).alias("role")) for n, dx, dy in roles]
    )
    told = grid.where(F.col(vid).isNotNull()).select(packed.alias("p"), F.inline(rows))
    quad = told.groupBy("qc", "qr").agg(*[F.max(F.when(F.col("role") == n, F.col("p"))).alias(n) for n, _, _ in roles])
    p = {n: F.col(n) for n, _, _ in roles}

    def tri(*names: str) -> Column:
        return F.struct(*[p[n]["vid"].alias(v) for n, v in zip(names, CORNERS)])

    def d2(m: str, n: str) -> Column:
        gap = [p[m][t] - p[n][t] for t in "xyz"]
        return G.dot(gap, gap)

    full = F.when(d2("ll", "ur") < d2("lr", "ul"), F.array(tri("ll", "lr", "ur"), tri("ll", "ur", "ul"))).otherwise(
        F.array(tri("ll", "lr", "ul"), tri("lr", "ur", "ul"))
    )
    order = ["ll", "lr", "ur", "ul"]
    missing = sum((p[n].isNull().cast("int") for n in order), start=F.lit(0))
    faces = F.when(missing == 0, full)
    for n in order:
        faces = faces.when((missing == 1) & p[n].isNull(), F.array(tri(*[m for m in order if m != n])))
    out = quad.select("qc", "qr", F.inline(faces))
    if slivers:
        return out
    verts = grid.where(F.col(vid).isNotNull()).select(F.col(vid).alias("vid"), *[F.col(p).alias(t) for p, t in zip(pos, "xyz")])
    return drop_slivers(checkpoint(out), verts)
