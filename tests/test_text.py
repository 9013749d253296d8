"""Line formats: what is written comes back, what does not fit is kept apart."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoloom.sources import sinks, text


def put(spark, tmp_path, *lines):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def bad(df):
    return sorted(r.value for r in df.collect())


def test_poses_with_nulls_come_back(spark, tmp_path):
    names = [n for n, _ in text.POSE_COLUMNS]
    kinds = ", ".join(f"{n} {t}" for n, t in text.POSE_COLUMNS)
    rows = [
        (1, 1.5, -31.0, 115.0, 1.0, None, 3.0, 0.0, 0.0, 0.5, "L1.png", "R1.png", 2.0, 1.0, 1),
        (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    path = str(tmp_path / "poses")
    text.write_poses(spark.createDataFrame(rows, kinds), (-31.8, 115.5), path)
    spark.createDataFrame([("3 4 5",), ("% a comment",), ("ORIGIN_LATITUDE x",), ("x" + " 1" * 14,)], "value string").write.mode("append").text(path)
    good, rejected = text.read_poses(spark, path)
    got = {r.pose_id: r for r in good.collect()}
    assert got[1].pose[1] is None and got[1].pose[2] == 3.0
    assert (got[1].left_image, got[1].right_image, got[1].altitude, got[1].footprint, got[1].overlap) == ("L1.png", "R1.png", 2.0, 1.0, True)
    assert got[2].left_image is None and got[2].pose_time is None and got[2].origin_latitude == -31.8
    assert bad(rejected) == ["3 4 5", "ORIGIN_LATITUDE x", "x" + " 1" * 14]
    assert len(names) == 15


@pytest.mark.parametrize("word", ["", "two words", "null"])
def test_words_that_would_not_come_back_are_refused(spark, tmp_path, word):
    with pytest.raises(PySparkException):
        spark.range(1).select(text.line(F.lit(1), F.lit(word))).collect()


def test_scene_boxes_and_bounds(spark, tmp_path):
    whole = "7 a.ply 0 0 0 1 1 1 " + " ".join(["1"] * 16)
    path = put(spark, tmp_path, whole, "8 b.ply 0 0 0 1 1", whole.replace("7", "x", 1), whole[:-1] + "one", " ", whole.replace("a.ply 0", "null null"))
    good, rejected = text.read_scene_boxes(spark, path)
    rows = good.orderBy(F.col("file").desc_nulls_last()).collect()
    assert [(r.id, r.file, r.xmin) for r in rows] == [(7, "a.ply", 0.0), (7, None, None)]
    assert rejected.count() == 3
    bounds, rejected = text.read_mesh_bounds(spark, put(spark, tmp_path / "b", "m 1 2 3 4 5 6", "m 0 2 3 9 5 6", "m 1 2", "n 1 2 3 4 5 x"))
    assert {(r.name, r.minx, r.maxx) for r in bounds.collect()} == {("m", 0.0, 9.0), (None, 0.0, 9.0)}
    assert bad(rejected) == ["m 1 2", "n 1 2 3 4 5 x"]


def test_patches_and_tracks(spark, tmp_path):
    good, rejected = text.read_patches(spark, put(spark, tmp_path, "1;2,3;", "2;x;4", "3;1", "y;1;2", "4;;5"))
    assert sorted((r.patch_id, r.strong, r.weak) for r in good.collect()) == [(1, [2, 3], []), (4, [], [5])]
    assert bad(rejected) == ["2;x;4", "3;1", "y;1;2"]
    view = '{"cam": %d, "key": 1, "x": 1.0, "y": 2.0}'
    lines = ['{"point": 1, "views": [%s, %s]}' % (view % 2, view % 9), '{"point": 2, "vi', "[]", '{"point": "z", "views": []}']
    obs, off, rejected = text.read_tracks(spark, put(spark, tmp_path / "t", *lines), 5)
    assert [(r.point_id, r.cam) for r in obs.collect()] == [(1, 2)]
    assert [r.cam for r in off.collect()] == [9]
    assert bad(rejected) == sorted(lines[1:])


def test_mosaic_with_bad_numbers(spark, tmp_path):
    cells, extents, rejected = text.read_mosaic_cells(
        spark, put(spark, tmp_path, "0 9 0 9 0 9 3 3 total", "0 1 0 1 0 1 0 0 a.tif", "0 1 0 1 0 1 1 0 null", "0 1 0 1 0 1 zero 0 b.tif", "0 1 0")
    )
    assert [r.file for r in cells.collect()] == ["a.tif"]
    assert extents.first().cols == 3
    assert bad(rejected) == ["0 1 0", "0 1 0 1 0 1 zero 0 b.tif"]


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_mesh_ids_keep_their_type(spark, tmp_path, kind):
    verts = spark.range(500).selectExpr(f"CAST(id % 300 AS {kind}) AS mesh_id", "id AS vid", "id * 0.5 AS x")
    faces = spark.range(10).selectExpr(f"CAST(id AS {kind}) AS mesh_id", "id AS fid")
    path = str(tmp_path / "mesh")
    sinks.write_mesh(verts, faces, path, buckets=8)
    back, back_faces = sinks.read_mesh(spark, path)
    assert back.dtypes == verts.dtypes and sorted(back.collect()) == sorted(verts.collect())
    assert back_faces.count() == 10
    assert len([p for p in (tmp_path / "mesh" / "vertices").iterdir() if p.name.startswith("bucket=")]) == 8


def test_words_of_a_line_are_split_once(spark, tmp_path):
    bounds, rest = text.read_mesh_bounds(spark, put(spark, tmp_path, "a 1 2 3 4 5 6", "b 1 2"))
    assert bounds._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert {(r.name, r.minx, r.maxz) for r in bounds.collect()} == {("a", 1.0, 6.0), (None, 1.0, 6.0)} and bad(rest) == ["b 1 2"]
