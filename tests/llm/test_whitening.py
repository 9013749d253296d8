import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16):
    """Components by numpy's own decomposition; whole-number parts by Python."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in good}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    explained = e[::-1][:k] / np.trace(centred.T @ centred / n)
    return n, explained, {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x.items()}, e[::-1][:k], u[:, ::-1][:, :k], {i: np.array([(n * c - s) / n for c, s in zip(v, sums)]) for i, v in x.items()}


def check(spark, rows, partitions):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(partitions)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    n, explained, deviation, e, u, away = brute(rows)
    assert {(r.vec_id, r.component) for r in got} == {(i, c + 1) for i in deviation for c in range(len(e))}
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(away[r.vec_id] @ u[:, r.component - 1]) / math.sqrt(e[r.component - 1]), rel=1e-6, abs=1e-6)
        assert r.identity_error < 1e-9


def test_equals_numpy(spark):
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((400, 20)) * np.linspace(0.2, 1.5, 20) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]  # one vector in very many rows counts once
    check(spark, rows, 7)


def test_whole_table_does_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = whitening.fit(df), whitening.fit(df.repartition(13))
    assert (a.n, a.centre, a.rest) == (b.n, b.centre, b.rest)
    assert (a.variance == b.variance).all() and (a.axes == b.axes).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, [1.5, -1.0]), (3, [0.25, 4.0]), (None, [0.5, 1.0]), (1, [0.5, 1.0])]
    odd = [(4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, []), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], SCHEMA)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, c) for i, _ in rows for c in (1, 2))
    assert {r.n for r in got} == {3}


def test_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
        out = whitening.whiten(df, whitening.fit(df))
        assert out.count() == 0 and "whitened" in out.columns


def test_far_vectors_and_clashing_names(spark):
    rows = [(k, [(-1.0) ** k * 1e30 * (k + 1), float(k)], 1, 2) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key long, d long")
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 3} and all(math.isfinite(r.whitened) for r in got)
    assert {r.deviation for r in got} == {None}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 8), st.integers(0, 10**6))
def test_factors(d, rank, seed):
    rng = np.random.default_rng(seed)
    half = rng.standard_normal((d, min(rank, d))) * 10.0 ** rng.integers(-3, 4)
    v = half @ half.T
    low = whitening.pivoted_cholesky(v)
    assert np.allclose(low @ low.T, v, rtol=1e-9, atol=1e-12 * abs(v).max())
    turned = whitening.jacobi(low)
    gram = turned.T @ turned
    assert np.allclose(gram - np.diag(gram.diagonal()), 0, atol=1e-12 * max(gram.max(initial=0), 1e-30))
    assert np.allclose(gram.diagonal(), np.linalg.eigvalsh(v)[::-1][: turned.shape[1]], rtol=1e-7, atol=1e-10 * abs(v).max())
