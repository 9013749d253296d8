"""Two-view fits against numpy over all matches, split hot pairs, and odd tables."""

import math
import random

import numpy as np
import pytest

from geoloom.operators import twoview
from geoloom.operators.twoview import two_view_fit

SCHEMA = "pair long, mid long, x1 double, y1 double, x2 double, y2 double"
TRIES, TOL = 40, 0.5


def planted(kind, pair, n, rng, wild=0.3):
    """Noisy matches of a pair, some of them wrong."""
    rows = []
    for k in range(n):
        x, y = rng.uniform(0, 600), rng.uniform(0, 400)
        if kind == "homography":
            w = 1 + x * 1e-4 + y * 2e-4
            u, v = (1.1 * x + 0.2 * y + 5 * pair) / w, (0.9 * y - 0.1 * x + 9) / w
        else:
            z = rng.uniform(2, 9)
            u, v = x + (900 + 50 * pair) / z, y + 300 / z
        u, v = u + rng.gauss(0, 0.05), v + rng.gauss(0, 0.05)
        if rng.random() < wild:
            u, v = u + rng.choice([-1, 1]) * rng.uniform(30, 90), v + rng.choice([-1, 1]) * rng.uniform(30, 90)
        rows.append((pair, k, x, y, u, v))
    return rows


def errors(kind, model, xy):
    """Distances of matches from a model, by matrices."""
    m = np.asarray(model).reshape(3, 3)
    p = np.c_[xy[:, :2], np.ones(len(xy))]
    q = np.c_[xy[:, 2:], np.ones(len(xy))]
    if kind == "homography":
        to = p @ m.T
        return np.hypot(*(to[:, :2] / to[:, 2:] - xy[:, 2:]).T)
    line, back = p @ m.T, q @ m
    return np.abs((q * line).sum(axis=1)) / np.sqrt((line[:, :2] ** 2).sum(axis=1) + (back[:, :2] ** 2).sum(axis=1))


@pytest.mark.parametrize("kind", ["homography", "fundamental"])
def test_votes_equal_all_matches_counted(spark, kind):
    rng = random.Random(5)
    rows = [r for pair, n in [(1, 60), (2, 300), (3, 25)] for r in planted(kind, pair, n, rng)]
    # the pool holds every match, so the draws depend on the order by hash alone
    lots = spark.createDataFrame(rows, SCHEMA).selectExpr("pair", "xxhash64(mid, 0) AS lot", "x1", "y1", "x2", "y2").orderBy("pair", "lot").toPandas()
    got = {r["pair"]: r for r in two_view_fit(spark.createDataFrame(rows, SCHEMA), ["pair"], ["mid"], kind, TOL, tries=TRIES).collect()}
    assert set(got) == {1, 2, 3}
    for pair, r in got.items():
        xy = lots[lots["pair"] == pair][list(twoview.XY)].to_numpy()
        models, _, _ = twoview._Solver(kind, TRIES, 0).sampled(xy)
        votes = [int((errors(kind, m, xy) <= TOL).sum()) for m in models]
        assert r["sampled_inliers"] == max(votes) and r["n_matches"] == len(xy)
        err = errors(kind, r["model"], xy)
        assert r["n_inliers"] == int((err <= TOL).sum()) >= max(votes)
        assert math.isclose(r["mean_sq"], float((err[err <= TOL] ** 2).mean()), rel_tol=1e-6)
        assert math.isclose(np.linalg.norm(r["model"]), 1.0, rel_tol=1e-9)


def test_pieces_of_a_hot_pair_give_the_same(spark):
    rng = random.Random(8)
    rows = planted("homography", 7, 4000, rng) + [r for pair in range(30) if pair != 7 for r in planted("homography", pair, 40, rng)]
    m = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (
        {r["pair"]: (r["n_matches"], r["sampled_inliers"], r["n_inliers"], [round(v, 7) for v in r["model"]]) for r in two_view_fit(m, ["pair"], ["mid"], "homography", TOL, tries=20, piece_rows=n).collect()}
        for n in (10_000, 300)
    )
    assert whole == cut and len(whole) == 30


def test_odd_matches(spark):
    """Nulls, infinite values, too few matches, equal and collinear ones, a key with other columns' names."""
    nan = float("nan")
    good = [(1, *r[1:]) for r in planted("homography", 1, 30, random.Random(2), wild=0.0)]
    rows = good + [(1, 90, None, 0.0, 0.0, 0.0), (1, 91, nan, 0.0, 0.0, 0.0), (1, 92, float("inf"), 0.0, 0.0, 0.0), (None, 1, 1.0, 1.0, 1.0, 1.0)]
    rows += [(2, k, 1.0 * k, 2.0 * k, 3.0, 4.0 * k) for k in range(3)]  # fewer than four
    rows += [(3, k, 5.0, 5.0, 6.0, 6.0) for k in range(20)]  # one match, repeated
    m = spark.createDataFrame(rows, SCHEMA).selectExpr("pair AS n_matches_", "*", "1 AS _try", "2 AS models", "3 AS _piece")
    got = {r["pair"]: r for r in two_view_fit(m, ["pair"], ["mid"], "homography", TOL).collect()}
    assert {k: (r["n_matches"], r["n_inliers"]) for k, r in got.items()} == {1: (30, 30), 2: (3, 0), 3: (20, 0)}
    assert got[2]["model"] is None and got[3]["model"] is None and got[3]["mean_sq"] is None


def test_no_matches(spark):
    assert two_view_fit(spark.createDataFrame([], SCHEMA), ["pair"], ["mid"], "fundamental", TOL).collect() == []
