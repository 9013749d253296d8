import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import chunks


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(random.Random(3).randbytes(500), np.uint8)
    got = chunks.gear_hashes(data)
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - chunks.WINDOW + 1) : i + 1].tolist():
            h = ((h << 1) + int(chunks.GEAR[b])) % 2**64
        assert int(got[i]) == h


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400))
def test_chunks_cover_the_text(text):
    raw = text.encode()
    ends = chunks.borders(np.frombuffer(raw, np.uint8)).tolist()
    assert ends == sorted(set(ends)) and (ends[-1:] == [len(raw)] or not raw)
    size = np.diff([0, *ends])
    assert all(chunks.LEAST <= s <= chunks.MOST for s in size[:-1])
    own = chunks.fingerprint(text)
    assert sum(own.values()) == len(raw) and chunks.parse(chunks.show(own)) == own
    assert chunks.likeness(own, own) == 1.0


def test_shift_resistance():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(2000))
    moved = chunks.fingerprint("some new words first " + text)
    assert chunks.containment(chunks.fingerprint(text), moved) > 0.95
    half = chunks.fingerprint(text[: len(text) // 2])
    assert chunks.containment(half, chunks.fingerprint(text)) > 0.95
    assert 0.4 < chunks.likeness(half, chunks.fingerprint(text)) < 0.6


def slow(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = map(chunks.fingerprint, (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), chunks.show(a), chunks.show(b), chunks.likeness(a, b), chunks.likeness(a, c)))
    return sorted(out, key=str)


def test_neighbours_across_ranges(make_docs, sample):
    got = chunks.edited_likeness(make_docs(sample).repartition(5), task_bytes=20_000)
    assert sorted(map(tuple, got.collect()), key=str) == slow(sample)


def test_odd_rows(odd_docs, no_docs, crowded_names, make_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, chunks.edited_likeness(odd_docs).collect()), key=str) == slow(rows)
    assert chunks.edited_likeness(no_docs).count() == 0
    assert chunks.edited_likeness(crowded_names).count() == 5
    alone = chunks.edited_likeness(make_docs([(9, "only one document here")])).first()
    assert alone.near_next == 1.0
    assert {r.fingerprint for r in chunks.fingerprints(odd_docs).collect() if r.doc_id in (1, 2)} == {""}
