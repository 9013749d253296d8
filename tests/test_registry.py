"""Every registered query with a SQL twin agrees with it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import norm, oracle, rows
from smallest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toArrow(), con.execute(SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_names_and_twins():
    assert set(SQL) <= set(QUERIES)
    # only what SQL cannot say, which tests/llm and test_approximate.py hold against brute force, has no twin
    assert {n for n in QUERIES if n not in SQL and not n.startswith("op")} <= {"pipeline", "knn_approx_neighbours", "agg_approx_errors"}
    assert norm(float("nan")) == "nan"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
