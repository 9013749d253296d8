import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from geoloom.llm import simhash
from geoloom.operators.graph import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def linked(spark, fps):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    comp = {r.id: r.comp for r in components(simhash.links(df)).collect()}
    return [comp.get(v, v) for v in signed]


def partition(labels):
    at = {}
    for i, x in enumerate(labels):
        at.setdefault(x, []).append(i)
    return sorted(at.values())


def test_fingerprints(sample, spark):
    for _, text in sample[:60]:
        assert simhash.text_fingerprint(text) == slow_fingerprint(text)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


@pytest.mark.parametrize("pairwise,ball,held", [(64, 20_000, 500_000), (2, 20_000, 500_000), (2, 20_000, 3_000), (2, 3, 500_000)])
def test_links_find_every_pair_within_four_bits(spark, monkeypatch, pairwise, ball, held):
    """Through compared pairs, local balls at once and by classes, and shuffled balls alike."""
    monkeypatch.setattr(simhash, "BALL_ROWS", held)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "LOCAL_BALL", ball)
    rng, fps = random.Random(5), set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                v ^= 1 << b
            fps.add(v)
    base = rng.getrandbits(64)
    fps |= {base, base ^ 0b1111, base ^ (0b1111 << 60), base ^ (0b11 << 30) ^ (0b11 << 40), base ^ (0b111 << 10) ^ (1 << 50)}
    fps = sorted(fps)
    assert partition(linked(spark, fps)) == partition(slow_components(fps))


def test_table_equals_brute_force(make_docs, sample):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(sample)).collect()}
    fps = [slow_fingerprint(t) for _, t in sample]
    root = slow_components(fps)
    low = {}
    for (i, _), r in zip(sample, root):
        low[r] = min(low.get(r, i), i)
    assert got == {i: (f"{fp:016x}", low[r]) for (i, _), fp, r in zip(sample, fps, root)}


def test_odd_rows(odd_docs, no_docs, crowded_names):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert zero == {1}  # null, empty and white texts link
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(crowded_names).columns == ["doc_id", "fingerprint", "component_id"]


def test_keep_first(odd_docs, no_docs, crowded_names, make_docs):
    kept = [(r.doc_id, (r.text or "")[:12]) for r in simhash.keep_first(odd_docs).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 4, 5, 6]
    assert (None, "no id at all") in kept and (None, "") not in kept
    assert simhash.keep_first(no_docs).count() == 0
    assert simhash.keep_first(crowded_names).columns == crowded_names.columns
    twice = simhash.keep_first(make_docs([(None, "same words here now"), (None, "Same  words here now")]))
    assert twice.count() == 1
