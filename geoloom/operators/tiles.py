"""Pixel tables: tiles, pyramids, masks and height lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import checkpoint, with_scalars


def drape(points: DataFrame, pid: str, x: str, y: str, grid: DataFrame) -> DataFrame:
    """Bilinear height of each point from the four cells around it; none missing.

    Each point asks four cells with one equi-join; the weighted sum combines per point.
    """
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    asks = F.array(
        *[
            F.struct(
                (F.floor(x).cast("bigint") + dx).alias("col"),
                (F.floor(y).cast("bigint") + dy).alias("row"),
                ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("_w"),
            )
            for dy in (0, 1)
            for dx in (0, 1)
        ]
    )
    asked = points.select(pid, F.inline(asks))
    return (
        asked.join(grid.select("col", "row", "value"), ["col", "row"])
        .groupBy(pid)
        .agg(F.sum(F.col("_w") * F.col("value")).alias("z"), F.count("*").alias("_n"))
        .where("_n = 4")
        .drop("_n")
    )


def tile_assign(pixels: DataFrame, size: int, levels: int) -> DataFrame:
    """Tile (level, tx, ty) and place inside it for every pixel and level."""
    out = pixels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    at = lambda c: F.expr(f"shiftright(cast({c} as bigint), level)")
    return out.select(
        *pixels.columns,
        "level",
        F.floor(at("col") / size).alias("tx"),
        F.floor(at("row") / size).alias("ty"),
        F.pmod(at("col"), F.lit(size)).alias("px"),
        F.pmod(at("row"), F.lit(size)).alias("py"),
    )


def tile_border(pixels: DataFrame, width: int, height: int, size: int, border: int) -> DataFrame:
    """Tiles of ``size`` pixels with a border on every side.

    Inner borders come from the neighbour tile; outside the image the border strip repeats
    the outermost strip of the image.  Each pixel names the places it fills, so no join is
    needed.
    """

    def places(c: str, extent: int) -> Column:
        p = F.col(c)
        return F.array_compact(
            F.array(p, F.when(p < border, p - border), F.when(p >= extent - border, p + border))
        )

    def tiles(c: str, extent: int) -> Column:
        last = (extent - 1) // size
        p = F.col(c)
        return F.sequence(
            F.greatest(F.floor((p - border) / size), F.lit(0)), F.least(F.floor((p + border) / size), F.lit(last))
        )

    out = pixels.withColumn("_x", F.explode(places("col", width))).withColumn("_y", F.explode(places("row", height)))
    out = out.withColumn("tx", F.explode(tiles("_x", width))).withColumn("ty", F.explode(tiles("_y", height)))
    px, py = F.col("_x") - F.col("tx") * size + border, F.col("_y") - F.col("ty") * size + border
    inside = (px >= 0) & (px < size + 2 * border) & (py >= 0) & (py < size + 2 * border)
    return out.where(inside).select("tx", "ty", px.alias("px"), py.alias("py"), *[c for c in pixels.columns if c not in ("col", "row")])


def halve(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    return pixels.groupBy(*keys, F.floor(F.col("col") / 2).alias("col"), F.floor(F.col("row") / 2).alias("row")).agg(
        F.avg(value).alias(value)
    )


def tile_pyramid(pixels: DataFrame, size: int, tile: int, value: str = "value", first: int = 0, keys: list[str] | None = None) -> DataFrame:
    """All levels (level, col, row, value): the image is halved while it holds a whole tile.

    Every level has a quarter of the rows of the one below and is written once, so the
    whole pyramid costs about a third more than its base.
    """
    keys = keys or []
    level = checkpoint(pixels.select(*keys, "col", "row", value))
    out = [level.withColumn("level", F.lit(first))]
    n = first
    while size // 2 >= tile:
        size //= 2
        n += 1
        level = checkpoint(halve(level, keys, value))
        out.append(level.withColumn("level", F.lit(n)))
    return reduce(DataFrame.unionByName, out)


def tile_merge(sets: DataFrame, set_id: str, side: int, size: int, tile: int, value: str = "value") -> DataFrame:
    """Merge side x side pyramids of one size: levels are shifted, then new top levels follow.

    Set s lies at column s % side and row s / side.
    """
    base = tile_pyramid(sets, size, tile, value, keys=[set_id])
    s = F.col(set_id)
    moved = base.select(
        "level",
        (F.col("col") + (s % side) * F.expr(f"shiftright({size}, level)")).alias("col"),
        (F.col("row") + F.floor(s / side) * F.expr(f"shiftright({size}, level)")).alias("row"),
        value,
    )
    top = 0
    while size // 2 >= tile:
        size //= 2
        top += 1
    highest = moved.where(F.col("level") == top).drop("level")
    upper = tile_pyramid(highest, size * side, tile, value, first=top).where(F.col("level") > top)
    return moved.unionByName(upper.select(*moved.columns))


def grid_fill(cells: DataFrame, rows: int, cols: int, spark) -> DataFrame:
    """Every cell of the grid with its file or a missing flag; rows count from the bottom."""
    frame = (
        spark.range(rows)
        .select(F.col("id").alias("row"))
        .withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint"))))
    )
    j = frame.join(cells, ["row", "col"], "left")
    rest = [c for c in cells.columns if c not in ("row", "col")]
    return j.select(
        (F.lit(rows - 1) - F.col("row")).alias("out_row"), "col", F.col(rest[0]).isNotNull().alias("valid"), *rest
    )


def best_source(files: DataFrame, group: str, fid: str, ok: Column, ratio: Column) -> DataFrame:
    """Per file name the compatible version whose resolution is nearest to the target."""
    score = F.abs(F.log(ratio))
    best = files.where(ok).groupBy(group).agg(F.min(F.struct(score.alias("score"), F.col(fid).alias("best"))).alias("b"))
    return best.select(group, "b.best", "b.score")


def mask_boxmax(pixels: DataFrame, on: Column, block: int) -> DataFrame:
    """255 for every block with a set pixel, else 0."""
    return pixels.groupBy(F.floor(F.col("col") / block).alias("col"), F.floor(F.col("row") / block).alias("row")).agg(
        F.max(F.when(on, 255).otherwise(0)).alias("mask")
    )


def mask_dilate(pixels: DataFrame, width: int, height: int, rounds: int, binary: bool = False) -> DataFrame:
    """Grow filled pixels (value > 0): an empty pixel takes the integer mean of its filled neighbours.

    Filled pixels stay; the binary form writes 255.  Filled pixels tell their eight
    neighbours, one aggregate per round.
    """
    step = F.sequence(F.lit(-1), F.lit(1))
    cur = pixels.where("value > 0").select(
        F.col("col").cast("bigint").alias("col"),
        F.col("row").cast("bigint").alias("row"),
        (F.lit(255) if binary else F.col("value")).cast("bigint").alias("value"),
    )
    for i in range(rounds):
        told = cur.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
        here = (F.col("dx") == 0) & (F.col("dy") == 0)
        told = told.select(
            (F.col("col") + F.col("dx")).alias("col"),
            (F.col("row") + F.col("dy")).alias("row"),
            F.when(here, F.col("value")).alias("own"),
            F.when(~here, F.col("value")).alias("near"),
        ).where((F.col("col") >= 0) & (F.col("col") < width) & (F.col("row") >= 0) & (F.col("row") < height))
        agg = told.groupBy("col", "row").agg(F.max("own").alias("own"), F.sum("near").alias("s"), F.count("near").alias("k"))
        cur = agg.select("col", "row", F.coalesce("own", F.expr("s div k")).alias("value"))
        if i + 1 < rounds:
            cur = checkpoint(cur)
    return cur


def raster_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of the values, and 255 where a is set (255) and b is not."""
    j = a.select("col", "row", F.col("value").alias("va")).join(b.select("col", "row", F.col("value").alias("vb")), ["col", "row"])
    return j.select(
        "col",
        "row",
        (F.col("va") - F.col("vb")).alias("diff"),
        F.when((F.col("va") == 255) & (F.col("vb") != 255), 255).otherwise(0).alias("mask"),
    )


def stretch_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """Stretch channels to 0..255 by their global range, rounded."""
    span = df.agg(*[f(c).alias(f"_{n}{c}") for c in channels for n, f in (("lo", F.min), ("hi", F.max))])
    j = with_scalars(df, span)
    out = [
        F.round((F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * 255.0).cast("int").alias(c)
        for c in channels
    ]
    return j.select(*[c for c in df.columns if c not in channels], *out)


def raster_vertices(pixels: DataFrame, width: int, height: int, sx: float, sy: float, nodata: float = 255.0) -> DataFrame:
    """Vertices of a raster on a plate 100 units wide, centred; nodata becomes null."""
    ratio = abs(sy) / abs(sx)
    scale = 100.0 / width / sx
    return pixels.select(
        (F.col("row") * width + F.col("col")).alias("vid"),
        (F.col("col") * (100.0 / (width - 1)) - 50.0).alias("x"),
        (F.col("row") * (100.0 * ratio / (height - 1)) - 50.0 * ratio).alias("y"),
        (F.nullif(F.col("value"), F.lit(nodata)) * scale).alias("z"),
        (F.col("col") / float(width)).alias("u"),
        (1.0 - F.col("row") / float(height)).alias("v"),
    )
