import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import quality
from geoloom.llm.trees import train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def measured(texts):
    s = quality.measure(pa.array(texts, pa.string()))
    return list(zip(*(s[k].tolist() for k in quality.STATS)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab#é　 \n\t$", max_size=60)), min_size=1, max_size=5))
def test_statistics_equal_brute_force(texts):
    assert measured(texts) == [brute(t) for t in texts]


def test_statistics_of_the_table(sample):
    texts = [t for _, t in sample]
    assert measured(texts) == [brute(t) for t in texts]


@pytest.fixture(scope="module")
def model(spark, make_docs, sample):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)


def test_verdicts(spark, model):
    """On another table: good documents stay, bad ones go."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id >= 1000")
    rows = quality.assess(docs, model).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_base_rules(make_docs, model):
    nine, ten = "a b c d e f g h i", "a b c d e f g h i j"
    half = "one two three four five " * 2 + " ".join(f"w{i}" for i in range(40))
    rows = {r.doc_id: r for r in quality.assess(make_docs([(1, nine), (2, ten), (3, half), (4, half + " z")]), model).collect()}
    assert [rows[k].base_failed for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert rows[3].n_repeat_words == 10 and rows[3].n_words == 50
    more = {r.doc_id: r for r in quality.assess(make_docs([(5, "one two three four five " * 2 + " ".join(f"w{i}" for i in range(39)))]), model).collect()}
    assert more[5].base_failed


def test_monotone_forest():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.standard_normal(4000)) > 0.6).astype(float)
    forest = train(x, y, {0: 1, 1: -1})
    grid = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5), np.full(200, 0.5)], 1)
    assert (np.diff(forest.score(grid)) >= 0).all()
    assert (np.diff(forest.score(grid[:, [1, 0, 2]])) <= 0).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.8


@pytest.mark.parametrize("seed", range(6))
def test_monotone_on_many_lines(seed):
    """Features that act on each other, steps and noise; the score is followed along both features from many points."""
    rng = np.random.default_rng(seed)
    x = rng.random((3000, 3))
    push = np.sin(7 * x[:, 0] + 5 * x[:, 1]) * np.where(x[:, 2] > 0.5, 3, -2) + 2 * (x[:, 0] > x[:, 1]) * x[:, 2]
    y = (push + rng.standard_normal(3000) > 0.4).astype(float)
    for rounds in (1, 10, 60):
        forest = train(x, y, {0: 1, 1: -1}, rounds=rounds, depth=4)
        for f, side in ((0, 1), (1, -1)):
            points = np.repeat(rng.random((150, 3)), 60, axis=0)
            points[:, f] = np.tile(np.linspace(0, 1, 60), 150)
            assert (side * np.diff(forest.margin(points).reshape(150, 60)) >= -1e-12).all()


def test_first_tree_equals_brute_force():
    """One round of depth one: every cut of every feature, with the weights written out."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (200, 4)).astype(float)
    y = (x[:, 2] + 2 * rng.standard_normal(200) > 4).astype(float)
    for monotone in ({}, {2: -1}, {2: 1, 3: -1}):
        p = y.mean()
        best = (1e-6, None)
        for f in range(4):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
                go = x[:, f] <= cut
                if min(go.sum(), (~go).sum()) < 10:
                    continue
                g, h = [(y - p)[s].sum() for s in (go, ~go)], [p * (1 - p) * s.sum() for s in (go, ~go)]
                w = [a / (b + 1) for a, b in zip(g, h)]
                gain = sum(a * b for a, b in zip(g, w)) - sum(g) ** 2 / (sum(h) + 1)
                if (w[1] - w[0]) * monotone.get(f, 0) >= 0 and gain > best[0] + 1e-9:
                    best = (gain, f, cut, w)
        _, f, cut, w = best
        want = np.log(p / (1 - p)) + 0.2 * np.where(x[:, f] <= cut, w[0], w[1])
        assert np.allclose(train(x, y, monotone, rounds=1, depth=1).margin(x), want)


def test_odd_rows(odd_docs, no_docs, crowded_names, model, spark):
    rows = quality.assess(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    assert quality.assess(no_docs, model).count() == 0
    assert quality.keep(odd_docs, model).schema == odd_docs.schema
    assert quality.keep(crowded_names, model).columns == crowded_names.columns
    nobody = quality.fit(odd_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.assess(odd_docs, nobody).collect()} == {0.5}


def test_repeated_labelled_ids_count_once(spark, make_docs, monkeypatch):
    """However often a labelled id is repeated, one row of it is sent to the driver."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y, monotone: seen.append((x.tolist(), y.tolist())))
    texts = [(i, " ".join(f"w{i}x{k}y{j}" for j in range(12 + k % 7))) for i in (1, 2) for k in range(50)]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    for rows in (texts, texts[::-1]):
        quality.fit(make_docs(rows), labels)
    assert len(seen[0][0]) == 2 and seen[0][1] == [0.0, 1.0] and seen[0] == seen[1]
