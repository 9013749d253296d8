"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over windows of fixed length, each filter's
largest answer in a window is kept, and a softmax layer names the language.  A text's answer is the
mean over all its windows.  Training and use are plain numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.arrow_text import slices, tidy

#: Bytes of a window, and bytes by which windows overlap so that no filter misses a border.
WINDOW, OVERLAP = 256, 4
EMBED = 6
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
#: Documents that are trained on, at most, as many of each language; those with the lowest hashes.
TRAIN_ROWS = 3000
#: Windows of each of them, at most; picked by the hash as well.
TRAIN_WINDOWS = 3
EPOCHS, BATCH, RATE = 8, 64, 0.01

_LETTER = regex.compile(r"\p{L}")
#: Windows that go through the network at once.
CHUNK = 256


@dataclass
class Net:
    names: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width * EMBED x FILTERS, by width
    bias: np.ndarray
    out: np.ndarray  # all filters x languages
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """Largest answer of each filter in each window, and where it was."""
        x = self.embed[windows]  # n x WINDOW x EMBED
        n, length, _ = x.shape
        tops, at = [], []
        flat = x.reshape(n, length * EMBED)
        for width, f in zip(WIDTHS, self.filters):
            places = length - width + 1
            seen = np.lib.stride_tricks.as_strided(
                flat, (n, places, width * EMBED), (flat.strides[0], EMBED * flat.itemsize, flat.itemsize), writeable=False
            )
            # one product per offset in the embedding, over contiguous rows
            answer = np.ascontiguousarray(seen).reshape(-1, width * EMBED) @ f
            answer = answer.reshape(n, places, FILTERS)
            at.append(answer.argmax(1))
            tops.append(np.take_along_axis(answer, at[-1][:, None], 1)[:, 0])
        return np.concatenate(tops, 1), at, x

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """Log chances of the languages for each window."""
        tables = self._tables()
        out = np.empty((len(windows), len(self.names)), np.float32)
        for k in range(0, len(windows), CHUNK):
            part = windows[k : k + CHUNK]
            tops = []
            for width, rows in zip(WIDTHS, tables):
                places = part.shape[1] - width + 1
                answer = rows[0][part[:, :places]]
                for j in range(1, width):
                    answer += rows[j][part[:, j : j + places]]
                tops.append(answer.max(1))
            hidden = np.maximum(np.concatenate(tops, 1) + self.bias, 0)
            z = hidden @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            out[k : k + CHUNK] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def _tables(self) -> list[list[np.ndarray]]:
        """Answers of each byte at each place of a filter: embedding and filter multiplied out."""
        return [[np.ascontiguousarray(self.embed @ f[j * EMBED : (j + 1) * EMBED], np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filters)]


def windows_of(raw: np.ndarray) -> np.ndarray:
    """Whole text as windows; the last is moved back to end with the text, short texts are padded."""
    n = len(raw)
    if n <= WINDOW:
        return np.concatenate([raw, np.full(WINDOW - n, 32, np.uint8)])[None]
    begin = np.arange(0, n - OVERLAP, WINDOW - OVERLAP)
    begin = np.minimum(begin, n - WINDOW)
    return raw[begin[:, None] + np.arange(WINDOW)]


def some_windows(text: str, count: int, seed: int) -> np.ndarray:
    """At most ``count`` windows of a text."""
    every = windows_of(np.frombuffer(text.encode(), np.uint8))
    return every[np.random.default_rng(seed).permutation(len(every))[:count]]


def train(texts: list[str], langs: list[str], seed: int = 7, windows: int = TRAIN_WINDOWS) -> Net | None:
    """Fit the network to windows of texts; None without any language."""
    cut = [some_windows(text, windows, k) for k, text in enumerate(texts)]
    return learn(cut, langs, seed)


def learn(cut: list[np.ndarray], langs: list[str], seed: int = 7) -> Net | None:
    """Fit the network with Adam to the windows of each text; None without any language."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = cut, [names.index(lang) for own, lang in zip(cut, langs) for _ in own]
    x, y = np.concatenate(xs), np.array(ys)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    total = FILTERS * len(WIDTHS)
    net = Net(
        names, rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5, [init(w * EMBED, FILTERS) for w in WIDTHS],
        np.zeros(total, np.float32), init(total, len(names)), np.zeros(len(names), np.float32),
    )
    first, second, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            step += 1
            for p, g, m, v in zip(net.params(), _gradients(net, x[rows], y[rows]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Net, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n = len(windows)
    tops, at, x = net.pooled(windows)
    pre = tops + net.bias
    hidden = np.maximum(pre, 0)
    z = hidden @ net.out + net.out_bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    back = (p @ net.out.T) * (pre > 0)
    d_embed, d_filters = np.zeros_like(net.embed), []
    for k, (width, f) in enumerate(zip(WIDTHS, net.filters)):
        b = back[:, k * FILTERS : (k + 1) * FILTERS]
        place = at[k][:, :, None] + np.arange(width)  # n x FILTERS x width
        byte = windows[np.arange(n)[:, None, None], place]
        seen = net.embed[byte].reshape(n, FILTERS, width * EMBED)
        d_filters.append(np.einsum("nf,nfe->ef", b, seen))
        d_seen = (b[:, :, None] * f.T[None]).reshape(-1, EMBED)
        np.add.at(d_embed, byte.ravel(), d_seen)
    return [d_embed, *d_filters, back.sum(0), hidden.T @ p, p.sum(0)]


def predict(net: Net | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its chance for each text; ``und`` and 0 without a letter or a network."""
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    if net is None:
        return names, score
    for k, text in enumerate(texts):
        if not text or not _LETTER.search(text):
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        total, count = np.zeros(len(net.names)), 0
        step = (WINDOW - OVERLAP) * 4096
        for at in range(0, max(1, len(raw) - OVERLAP), step):
            answer = net.logits(windows_of(raw[at : at + step + OVERLAP]))
            total += answer.sum(0, dtype=np.float64)
            count += len(answer)
        mean = np.exp(total / count)
        best = int(mean.argmax())
        names[k], score[k] = net.names[best], float(mean[best] / mean.sum())
    return names, score


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS
) -> Net | None:
    """A network from at most ``rows`` documents with text and language and ``windows`` windows of each.

    Every language has the same part of the rows, so rare ones are learned too; of more than ``rows``
    languages the most frequent ones are.  Only the windows are sent to the driver.
    """
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("y")).where("t is not null and y is not null")
    # at most `rows` languages are sent to all executors
    many = known.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(rows)
    each = max(1, rows // max(1, many.count()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    # about twice as many rows as are wanted go on from where they are read
    near = known.join(F.broadcast(many), "y").withColumn("h", place).where(F.col("h") * F.col("n") <= 2.0 * each * (1 << 31))
    rank = Window.partitionBy("y").orderBy("h", "id", "t")
    picked = near.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= each).select("id", "h", "y", "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [some_windows(t, windows, h).tobytes() for t, h in zip(batch.column("t").to_pylist(), batch.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(own, pa.binary())], ["id", "y", "w"])

    got = sorted((r.id is not None, r.id or 0, r.y, bytes(r.w)) for r in picked.mapInArrow(cut, "id long, y string, w binary").collect())
    return learn([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for *_, w in got], [y for _, _, y, _ in got])


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; such rows are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row, from its whole text alone.

    ``lang_pred`` is a language that the network knows, with the lexically first of equal chances, or
    ``und`` with score 0 if the text is null or has no letter or nothing was learned.  Repeated rows
    get the same answer; no rows give no rows.  A null id is not held out.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                names, score = predict(net, part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("h"), pa.array(names, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"]
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("h"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), "id long, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
