"""Writers of point and mesh tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.mesh import corners


def write_oriented_points(faces: DataFrame, verts: DataFrame, normals: DataFrame, path: str) -> None:
    """Position and normal of every face corner as six floats."""
    pts = corners(faces).select("fid", "k", "vid").join(verts.select("vid", "x", "y", "z"), "vid").join(normals, "vid")
    names = ["x", "y", "z", "nx", "ny", "nz"]
    pts.select("fid", "k", *[F.col(c).cast("float").alias(c) for c in names]).write.parquet(path)


def write_mesh(verts: DataFrame, faces: DataFrame, path: str, mesh: str = "mesh_id", buckets: int = 64) -> None:
    """Merged mesh with all columns; a merged mesh keeps unknown properties.

    Rows lie in ``buckets`` folders by a hash of the mesh id, which stays a column of its own type, so
    the number of folders does not grow with the meshes.  A reader of one mesh needs one folder.  The
    rebalance hint gathers small meshes into few files and splits a mesh that holds most of the rows
    over several tasks.
    """
    for name, df in (("vertices", verts), ("faces", faces)):
        dealt = df.withColumn("bucket", mesh_bucket(mesh, buckets))
        dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")


def mesh_bucket(mesh: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(mesh).cast("string")), F.lit(buckets)).cast("int")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) as they were written."""
    return tuple(spark.read.parquet(f"{path}/{name}").drop("bucket") for name in ("vertices", "faces"))
