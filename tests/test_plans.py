"""Physical plans: filters reach the scan, columns are pruned, top-k and joins have the wanted form."""

import pytest

import __spark_entry__ as entry
from smallest import SF

QUERIES = entry.queries()


def plan(spark, name):
    run = QUERIES[name](spark, SF)._jdf.queryExecution()
    return spark._jvm.PythonSQLUtils.explainString(run, "formatted")


def test_window_filter_reaches_the_scan(spark):
    p = plan(spark, "box_window_bounds")
    assert "LessThanOrEqual(l_quantity,20.0)" in p and "LessThanOrEqual(l_extendedprice,40000.0)" in p
    assert "l_shipdate" not in p.split("ReadSchema")[-1]


def test_top_k_forms(spark):
    assert "TakeOrderedAndProject" in plan(spark, "topk_queue")
    assert "WindowGroupLimit" in plan(spark, "win_rank_ties")


@pytest.mark.parametrize(
    "name",
    ["box_box_join", "radius_join", "overlap_anti_join", "temporal_overlap_join", "moving_range_join", "camera_vertex_join", "inside_mesh", "patch_neighbors", "agg_normalize_variance", "agg_bsphere", "drop_slivers", "src_poses"],
)
def test_no_pairing_without_keys(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
