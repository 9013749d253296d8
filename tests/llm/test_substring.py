import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import substring
from geoloom.llm.fm import FMIndex


def brute(texts, width):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def run(docs, **options):
    return [(r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(docs, **options).collect()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 9))
def test_matching_statistics_equal_brute_force(patterns, limit):
    size = np.array([len(p) for p in patterns])
    start = np.cumsum(size + 1) - size - 1
    text = np.concatenate([[*p, 0] for p in patterns])
    got = FMIndex(text, 4).repeated(text, start, size, limit)
    every = [tuple(p[i : i + k]) for p in patterns for k in range(1, limit + 1) for i in range(len(p) - k + 1)]
    count = Counter(every)
    for p, a in zip(patterns, start):
        for i in range(len(p)):
            want = max((k for k in range(1, limit + 1) if i + k <= len(p) and count[tuple(p[i : i + k])] > 1), default=0)
            assert got[a + i] == want


@pytest.mark.parametrize("width", [35, 9, 3])
def test_equals_brute_force_on_the_table(make_docs, sample, width):
    assert sorted(run(make_docs(sample), width=width)) == sorted(brute([t for _, t in sample], width))


def test_crowded_anchors_are_dealt_by_window(make_docs, sample, monkeypatch):
    monkeypatch.setattr(substring, "CROWDED", 1)
    got = run(make_docs(sample), width=9, shard_words=2000)
    assert sorted(got) == sorted(brute([t for _, t in sample], 9))


def test_a_passage_in_many_documents(make_docs):
    quote = " ".join(f"q{i}" for i in range(40))
    docs = [(k, f"a{k} b{k} {quote} c{k} d{k}") for k in range(300)] + [(1000, "a b " * 60)]
    got = {r.doc_id: r.n_removed for r in substring.report(make_docs(docs)).collect()}
    assert got == {k: 40 for k in range(300)} | {1000: 120}


def test_odd_rows(odd_docs, no_docs):
    rows = {(r.doc_id, r.n_words): r.n_removed for r in substring.report(odd_docs).collect()}
    assert substring.report(odd_docs).count() == odd_docs.count()
    assert rows[1, 0] == rows[2, 0] == rows[3, 0] == 0
    assert rows[6, 120_000] == 0
    assert substring.report(no_docs).count() == 0
    assert substring.remove_repeats(no_docs).count() == 0


def test_repeated_rows_are_copies(make_docs):
    text = " ".join(f"w{i}" for i in range(50))
    docs = make_docs([(1, text), (1, text), (None, text + " tail")])
    assert sorted(r.n_removed for r in substring.report(docs).collect()) == [50, 50, 50]


def test_keeps_other_columns(crowded_names):
    out = substring.remove_repeats(crowded_names)
    assert out.schema == crowded_names.schema
    assert sorted(out.collect()) == sorted(crowded_names.collect())
