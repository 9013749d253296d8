import hashlib
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, periods=4, length=6):
    """Every period in turn; a stretch counts for the smallest one."""
    out, seen = [], set()
    for q in range(1, len(w)):
        k = q
        while k < len(w):
            if w[k] != w[k - q]:
                k += 1
                continue
            e = k
            while e < len(w) and w[e] == w[e - q]:
                e += 1
            stretch = (k - q, e - k + q)
            if stretch[1] >= max(length, periods * q) and stretch not in seen:
                seen.add(stretch)
                out.append((*stretch, q))
            k = e
    return sorted(out)


def found(w, periods=4, length=6):
    ids = np.array(w, np.int64)
    width = periodic.gram_width(periods, length)
    return periodic.find(ids, periodic.grams(ids, width), periods, length) if len(w) >= width else []


PART = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 30)).map(lambda p: (p[0] * 30)[: p[1]])


@settings(max_examples=200, deadline=None)
@given(st.lists(PART, max_size=6).map(lambda parts: sum(parts, [])), st.sampled_from([(4, 6), (2, 2), (3, 10), (2, 5)]))
def test_runs_equal_brute_force(w, limits):
    assert found(w, *limits) == brute(w, *limits)


@pytest.mark.parametrize(
    "w, runs",
    [
        ([0] * 100_000, 1),
        (list(range(10)) * 10_000, 1),
        ([0, 0, 0, 0, 0, 0, 1] * 10_000, 10_001),
        ([x for k in range(3000) for x in [*range(10), 100 + k]], 0),
    ],
)
def test_long_texts(w, runs):
    began = time.time()
    assert len(found(w)) == runs
    assert time.time() - began < 30


def slow_row(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(x for i, x in enumerate(words) if i not in gone)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(runs), *facts, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(kept)


def rows(docs, **options):
    return sorted((tuple(r) for r in periodic.collapse(docs, rewrite=periodic.copied_tail, texts=False, **options).collect()), key=str)


def test_table_equals_brute_force(make_docs, sample):
    short = [(i, t) for i, t in sample if len(t or "") < 6000]
    more = [(1_000_000 + k, "a b " * k + "é é é é é é é " + "long text of some words " * (k % 7)) for k in range(60)]
    want = sorted((slow_row(i, t) for i, t in short + more), key=str)
    assert rows(make_docs(short + more).repartition(4)) == want
    assert sum(r[1] for r in want) > 40


def test_odd_rows(odd_docs, no_docs, crowded_names, make_docs):
    assert len(rows(odd_docs)) == odd_docs.count()
    assert {r[1] for r in rows(odd_docs) if r[0] in (1, 2, 3, None)} == {0}
    assert rows(no_docs) == [] and len(rows(crowded_names)) == 5
    out = periodic.collapse(make_docs([(1, "so so so so so so it is"), (2, None)])).collect()
    assert [(r.n_runs, r.collapsed) for r in sorted(out)] == [(1, "so it is"), (0, "")]
    assert [tuple(r) for r in periodic.runs(make_docs([(1, "so so so so so so it is")])).collect()] == [(1, 0, 6, 1)]
