import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import bpe, packing
from geoloom.llm.queries import tokenizer_path
from geoloom.llm.tokens import WordIds, load

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = ["don't DON'T it's 's", "a\x1cb c", "é É  x", "<|endoftext|> a<|endoftext|>b <|startoftext|>", "12 ab12 ²", "  　tab\t\n", "ΑΣ Σ", "!!! word!!! \"q\" a.b. ,", "日本語 テキスト", "İstanbul ﬁ", ""]
TEXT = st.text("aBé'., \n\t1!<|>́\x1c ", max_size=30)


@pytest.fixture(scope="module")
def words():
    return WordIds(WORDS, limit=10_000)


def check_words(words, texts):
    ids, begin = words(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == words.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_ids_of_odd_texts(words, sample):
    check_words(words, ODD)
    check_words(words, [t for _, t in sample])


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_word_ids_of_any_text(words, texts):
    check_words(words, texts)


@pytest.mark.parametrize("top", [1, 199, 200, 70_000, 3_000_000, 4_000_000])
def test_word_numbers_come_back(top):
    numbers = np.concatenate([np.random.default_rng(top).integers(0, top + 1, 1000), [top]])
    assert (bpe._from_ranks(bpe._ranks(numbers)) == numbers).all()
    assert len(bpe._from_ranks(bpe._ranks(numbers[:0]))) == 0


def slow_codes(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), digest(",".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("chars", [1 << 25, 3000])
def test_byte_pairs_equal_the_library(make_docs, sample, odd_docs, monkeypatch, chars):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
    tokenizer = load(BYTES)
    docs = make_docs([*sample, *((10_000 + k, t) for k, t in enumerate([*ODD, None, "x " * 50_000]))])
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, BYTES).collect()}
    assert got == {i: slow_codes(tokenizer, t) for i, t in rows.items()}
    assert bpe.encode_decode(odd_docs, BYTES).count() == odd_docs.count()


@settings(max_examples=300, deadline=None)
@given(st.text("aé's <|endoftx>\n\t1!　", max_size=40))
def test_split_equals_the_library(text):
    """Encoding word by word is encoding the text."""
    tokenizer = load_once()
    words = bpe._Block(["<|endoftext|>"]).words(text)
    assert "".join(words) == text
    assert [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


_LOADED = []


def load_once():
    if not _LOADED:
        _LOADED.append(load(BYTES))
    return _LOADED[0]


def test_empty_and_named(no_docs, crowded_names):
    assert bpe.encode_decode(no_docs, BYTES).count() == 0
    assert bpe.encode_decode(crowded_names, BYTES).count() == 5
    assert packing.pack(no_docs, WORDS).count() == 0
    assert packing.pack(crowded_names, WORDS).count() == 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit(size):
    bins = packing.best_fit(size, 50)
    fill = {}
    for b, s in zip(bins, size):
        fill[b] = fill.get(b, 0) + s
    assert all(v <= 50 for v in fill.values())
    assert len(fill) <= 1 + 11 * -(-sum(size) // 50) / 9 + 1


def whole(rows, length):
    """Every document's pieces in order, and every sequence without gaps or overflow."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return {i: sorted(p) for i, p in docs.items()}, len(sequences)


@pytest.mark.parametrize("items", [60_000, 20])
def test_packing(make_docs, sample, monkeypatch, items):
    monkeypatch.setattr(packing, "ITEMS", items)
    tokenizer, length = load(WORDS), 512
    got, n = whole(packing.pack(make_docs(sample).repartition(6), WORDS, length=length).collect(), length)
    total = 0
    for i, text in sample:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        cuts = range(0, len(ids), length)
        assert got[i] == [(k, s, len(ids[s : s + length]), zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes())) for k, s in enumerate(cuts)]
    assert n <= 1.03 * -(-total // length) + 2


def test_packing_odd_rows(odd_docs):
    rows = packing.pack(odd_docs, WORDS).collect()
    whole(rows, 4096)
    assert [(r.start, r.length) for r in rows if r.doc_id == 1] == [(0, 1)]
    assert len([r for r in rows if r.doc_id == 4]) == 2
    assert sum(r.doc_id is None for r in rows) == 2
    assert max(r.piece for r in rows) > 20
