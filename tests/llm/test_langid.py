import zlib

import numpy as np
import pytest

from geoloom.llm import langid


@pytest.fixture(scope="module")
def net(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.fit(docs.where(~langid.held_out()))


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_tables_equal_convolution(net):
    """The lookup tables used for answers and the products used in training agree."""
    rng = np.random.default_rng(2)
    windows = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    tops, _, _ = net.pooled(windows)
    z = np.maximum(tops + net.bias, 0) @ net.out + net.out_bias
    want = z - np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(net.logits(windows), want, atol=1e-3)


def test_gradients(net):
    rng = np.random.default_rng(3)
    windows, y = rng.integers(97, 122, (4, 32)).astype(np.uint8), np.array([0, 1, 2, 3])

    def loss():
        tops, _, _ = net.pooled(windows)
        z = np.maximum(tops + net.bias, 0) @ net.out + net.out_bias
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(4), y]).mean())

    for p, g in zip(net.params(), langid._gradients(net, windows, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, step = p[at], np.float32(1e-2)
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        down = loss()
        p[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.25, abs=1e-3)


def test_windows_cover_every_byte():
    for n in (0, 1, langid.WINDOW, langid.WINDOW + 1, 1000, 2 * langid.WINDOW):
        raw = (np.arange(n) % 251).astype(np.uint8)
        w = langid.windows_of(raw)
        assert w.shape[1] == langid.WINDOW
        places = set()
        for begin in [*range(0, n - langid.OVERLAP, langid.WINDOW - langid.OVERLAP)] or [0]:
            begin = max(0, min(begin, n - langid.WINDOW))
            places |= set(range(begin, begin + langid.WINDOW))
        assert places >= set(range(n))


def test_odd_rows(odd_docs, no_docs, crowded_names, net, make_docs):
    rows = langid.identify(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    assert langid.identify(make_docs([(1, "123 !? 45")]), net).first().lang_pred == "und"
    assert not langid.identify(make_docs([(None, "abc")]), net).first().held_out
    assert langid.identify(no_docs, net).count() == 0
    assert langid.identify(crowded_names, net).columns == ["doc_id", "held_out", "lang_pred", "score"]
    nothing = langid.fit(odd_docs)  # no languages
    assert {r.lang_pred for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_rare_languages_are_learned(spark):
    """A language with one row in 500 has its part of a sample that is much smaller than the table."""
    common, rare = "the cat sat on the mat and then it went off ", "zzyx qwrk vvlp zzyx wrkk qqjx "
    rows = [(k, (common if k % 500 else rare) * (3 + k % 5), "aa" if k % 500 else "bb") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, rows=20)
    assert net.names == ["aa", "bb"]
    assert langid.predict(net, [rare * 4, common * 4])[0] == ["bb", "aa"]
    again = langid.fit(docs.repartition(9), rows=20)
    assert all((a == b).all() for a, b in zip(net.params(), again.params()))
