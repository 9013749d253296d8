"""Readers of the line formats; sentinels become null, bad lines are kept apart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.session import with_scalars


NULL = "null"  # what stands for a missing value in a line


def fields(c: str = "value") -> Column:
    """Words of a line, split at spaces, tabs and newlines."""
    return F.array_remove(F.split(c, r"[ \t\n]+"), "")


def line(*cols: Column) -> Column:
    """Values as one line, a sentinel for null.

    A text that would not come back (empty, with white space, or equal to the sentinel) is an error.
    """
    words = []
    for c in cols:
        word = c.cast("string")
        odd = (word == "") | (word == NULL) | word.rlike(r"\s")
        words.append(F.when(word.isNull(), NULL).when(odd, F.raise_error(F.concat(F.lit("cannot be written as a word: "), word))).otherwise(word))
    return F.concat_ws(" ", *words)


def _typed(words: Column, names: Sequence[tuple[str, str]]) -> list[Column]:
    """Words by place as typed columns; the sentinel and what does not fit are null."""
    return [F.nullif(F.get(words, F.lit(i)), F.lit(NULL)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)]


def _fits(words: Column, kinds: Sequence[str]) -> Column:
    """Every word is there and is of its kind or the sentinel."""
    tests = [(F.get(words, F.lit(i)) == NULL) | F.get(words, F.lit(i)).try_cast(t).isNotNull() for i, t in enumerate(kinds)]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ink and their words, which are split once for all tests and columns that read them."""
    return spark.read.text(path).where(F.trim("value") != "").select("value", F.inline(F.array(F.struct(fields().alias("w")))))


def _kept_apart(lines: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    return lines.where(good), lines.where(~good).select("value")


def read_scene_boxes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(boxes, bad lines): id, file, six bounds and a 4x4 matrix per line."""
    names = [("id", "bigint"), ("file", "string")] + [(n, "double") for n in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")]
    good, bad = _kept_apart(_lines(spark, path), _fits(F.col("w"), [t for _, t in names] + ["double"] * 16))
    matrix = F.transform(F.slice("w", 9, 16), lambda v: F.nullif(v, F.lit(NULL)).try_cast("double"))
    return good.select(*_typed(F.col("w"), names), matrix.alias("m")), bad


def _first_lines(lines: DataFrame) -> DataFrame:
    """The first line of every file: lowest row of the block that starts the file."""
    start = lines.where("_start = 0")
    return start.groupBy("_path").agg(F.min(F.struct("_at", "value")).alias("f")).select("_path", "f._at", "f.value")


def read_mosaic_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, extents, bad lines); the first line of a file is its extent and grid size.

    Cells without a file (``null``) are dropped; lines without nine fields are bad.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
    )
    names = [(n, "double") for n in ("xmin", "xmax", "ymin", "ymax", "zmin", "zmax")] + [("col", "int"), ("row", "int"), ("file", "string")]
    split = lines.where(F.trim("value") != "").withColumn("w", fields())
    fits = (F.size("w") == 9) & _fits(F.col("w"), [t for _, t in names])
    bad = split.where(~fits).select("value")
    heads = _first_lines(lines)
    head_words = heads.withColumn("w", fields())
    extents = head_words.select("_path", *_typed(F.col("w"), names[:6]), *[F.get("w", F.lit(i)).try_cast("int").alias(n) for i, n in ((6, "cols"), (7, "rows"))])
    body = split.where(fits).join(heads.select("_path", "_at"), ["_path", "_at"], "left_anti")
    cells = body.select(*_typed(F.col("w"), names)).where("file is not null")
    return cells, extents, bad


POSE_COLUMNS = (
    [("pose_id", "bigint"), ("pose_time", "double"), ("latitude", "double"), ("longitude", "double")]
    + [(n, "double") for n in ("x", "y", "z", "phi", "theta", "psi")]
    + [("left_image", "string"), ("right_image", "string"), ("altitude", "double"), ("footprint", "double"), ("overlap", "int")]
)


def write_poses(poses: DataFrame, origin: tuple[float, float], path: str) -> None:
    """Pose lines plus the two origin lines."""
    spark = poses.sparkSession
    head = spark.range(1).select(
        F.explode(F.array(F.lit(f"ORIGIN_LATITUDE {origin[0]!r}"), F.lit(f"ORIGIN_LONGITUDE {origin[1]!r}"))).alias("value")
    )
    body = poses.select(line(*[F.col(n) for n, _ in POSE_COLUMNS]).alias("value"))
    head.unionByName(body).write.text(path)


def read_poses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(poses with the origin of the data set as two columns, bad lines); % begins a comment."""
    lines = _lines(spark, path).where(~F.col("value").startswith("%"))
    key = F.get("w", F.lit(0))
    named = key.startswith("ORIGIN_")
    known = key.isin("ORIGIN_LATITUDE", "ORIGIN_LONGITUDE") & F.get("w", F.lit(1)).try_cast("double").isNotNull()
    whole = (F.size("w") == len(POSE_COLUMNS)) & _fits(F.col("w"), [t for _, t in POSE_COLUMNS])
    good, bad = _kept_apart(lines, F.coalesce(F.when(named, known).otherwise(whole), F.lit(False)))
    origin = good.where(named).agg(
        *[F.max(F.when(key == f"ORIGIN_{n}", F.get("w", F.lit(1)).try_cast("double"))).alias(f"origin_{n.lower()}") for n in ("LATITUDE", "LONGITUDE")]
    )
    rows = good.where(~named).select(*_typed(F.col("w"), POSE_COLUMNS))
    pose = F.array("x", "y", "z", "phi", "theta", "psi").alias("pose")
    rest = [n for n, _ in POSE_COLUMNS if n not in ("x", "y", "z", "phi", "theta", "psi", "overlap")]
    out = with_scalars(rows, origin).select(*rest, pose, (F.col("overlap") != 0).alias("overlap"), "origin_latitude", "origin_longitude")
    return out, bad


def read_patches(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(patches, bad lines): ``id;strong,strong;weak,weak`` as an id with two lists of images."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("p", F.split("value", ";"))
    images = lambda i: F.filter(F.split(F.get("p", F.lit(i)), ","), lambda v: v != "")
    numbers = lambda i: F.transform(images(i), lambda v: v.try_cast("int"))
    fits = (F.size("p") == 3) & F.get("p", F.lit(0)).try_cast("bigint").isNotNull()
    fits &= F.forall(numbers(1), lambda v: v.isNotNull()) & F.forall(numbers(2), lambda v: v.isNotNull())
    good, bad = _kept_apart(lines, F.coalesce(fits, F.lit(False)))
    return good.select(F.get("p", F.lit(0)).try_cast("bigint").alias("patch_id"), numbers(1).alias("strong"), numbers(2).alias("weak")), bad


def patch_images(patches: DataFrame, weak: bool = False) -> DataFrame:
    return patches.select("patch_id", F.explode("weak" if weak else "strong").alias("image"))


def read_mesh_bounds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bounds per mesh name and over all (name null), bad lines) from ``name x1 y1 z1 x2 y2 z2`` lines."""
    names = [("name", "string")] + [(n, "double") for n in ("x1", "y1", "z1", "x2", "y2", "z2")]
    good, bad = _kept_apart(_lines(spark, path), _fits(F.col("w"), [t for _, t in names]))
    aggs = [f(F.col(f"{c}{i}")).alias(f"{n}{c}") for c in "xyz" for i, n, f in ((1, "min", F.min), (2, "max", F.max))]
    return good.select(*_typed(F.col("w"), names)).rollup("name").agg(*aggs), bad


TRACK = T.StructType(
    [
        T.StructField("point", T.LongType()),
        T.StructField(
            "views",
            T.ArrayType(
                T.StructType([T.StructField("cam", T.IntegerType()), T.StructField("key", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
            ),
        ),
    ]
)


def read_tracks(spark: SparkSession, path: str, cameras: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, rejected, bad lines): one row per view of a point.

    Camera numbers must be below ``cameras``, otherwise the view is rejected; lines that are no record
    of a point with views are bad.
    """
    recs = spark.read.text(path).where(F.trim("value") != "").withColumn("t", F.from_json("value", TRACK))
    whole = F.coalesce(F.col("t.point").isNotNull() & F.col("t.views").isNotNull(), F.lit(False))
    lines, bad = _kept_apart(recs, whole)
    obs = lines.select(F.col("t.point").alias("point_id"), F.inline("t.views"))
    good = F.coalesce((F.col("cam") >= 0) & (F.col("cam") < cameras), F.lit(False))
    return obs.where(good), obs.where(~good), bad


def visibility_pairs(df: DataFrame, point: str, mask: Column) -> DataFrame:
    """(point, cam) for every non-zero entry of a dense visibility row."""
    return df.select(point, F.posexplode(mask).alias("cam", "_on")).where("_on <> 0").drop("_on")
