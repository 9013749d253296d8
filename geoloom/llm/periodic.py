"""Stretches of words that repeat with a period, found in one pass over each text.

Every word looks up its earlier occurrences; each gives a lag, and the match length of a lag grows
while words so far apart go on being equal.  When a lag's match ends, its run is put out at once if
it is long enough.  Only lags that can still come to something are kept:

* a run matches several words at its lag, so occurrences are those of that many words together;
* a lag begins where the words before differ, and only if the end of the match it needs is there;
* a lag that is a multiple of a live one and begins in the same place ends with it, as the same
  stretch of a shorter period.

Words are numbered exactly, so what is equal is decided by the words and not by hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import SPACE, Words, buffers, slices, split, tidy

PERIODS = 4
LENGTH = 6
#: Occurrences of a group of words are looked up by the words before, where these are so few.
FEW_PARTS = 8

Rewrite = Callable[[int | None, int], np.ndarray | None]


def needed(period: int, periods: int = PERIODS, length: int = LENGTH) -> int:
    """Words that must match at a lag for a run of that period."""
    return max(length - period, (periods - 1) * period)


def gram_width(periods: int = PERIODS, length: int = LENGTH) -> int:
    """Words that match at the lag of any run."""
    return min(needed(q, periods, length) for q in range(1, max(2, length)))


def word_numbers(words: Words) -> np.ndarray:
    """A number for each word, the same for equal words."""
    ink = words.data[~SPACE[words.data]]
    at = np.concatenate(([0], np.cumsum(words.end - words.start)))
    spelled = pa.Array.from_buffers(pa.large_string(), len(words.start), [None, pa.py_buffer(at), pa.py_buffer(ink)])
    return spelled.dictionary_encode().indices.to_numpy().astype(np.int64)


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair."""
    if not len(a):
        return a
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].reshape(-1)


def grams(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for every ``width`` consecutive words, the same for equal ones."""
    out, have = ids, 1
    while have < width:
        more = min(have, width - have)
        # the last `have` of the first `have + more` words overlap nothing when more == have
        out = _numbered(out[: max(0, len(ids) - have - more + 1)], (out if more == have else grams(ids, more))[have : len(ids) - more + 1])
        have += more
    return out


def find(ids: np.ndarray, gram: np.ndarray, periods: int = PERIODS, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, by start, then period.

    ``ids`` are the numbers of its words, ``gram`` those of its words by ``gram_width``.
    """
    width = len(ids) - len(gram) + 1
    n, total = len(gram), len(ids)
    if n < 2:
        return []
    before = np.concatenate(([-1], gram[:-1]))
    # places by group of words, then by the group before, then in order of the text
    order = np.lexsort((before, gram))
    new = np.concatenate(([True], gram[order][1:] != gram[order][:-1]))
    if new.all():
        return []
    turn = new | np.concatenate(([True], before[order][1:] != before[order][:-1]))
    kind = np.cumsum(new) - 1
    lows = np.flatnonzero(turn)
    highs = np.append(lows[1:], n)
    parts = np.searchsorted(lows, np.append(np.flatnonzero(new), n))  # the parts of each kind
    kind_of, part_of = np.empty(n, np.int64), np.empty(n, np.int64)
    kind_of[order], part_of[order] = kind, np.cumsum(turn) - 1
    flat = np.argsort(gram, kind="stable")  # as `order`, but places of a kind in order of the text
    lone = np.diff(np.append(np.flatnonzero(new), n)) == 1
    again = np.flatnonzero(~lone[kind_of])
    found: list[tuple[int, int, int]] = []
    live: dict[int, int] = {}  # lag: where its match began
    g, last = gram.tolist(), -2

    def ended(lag: int, at: int) -> None:
        match = at - live.pop(lag) + width - 1
        if match >= needed(lag, periods, length):
            found.append((at + width - 1 - match - lag, match + lag, lag))

    def starts(i: int, part: int, lo: int, hi: int) -> list[int]:
        """Lags that begin at i, shortest first."""
        reach = i - (n - 1 - i + width) // (periods - 1)  # a match begun further back has no room
        if hi - lo <= FEW_PARTS:
            slices = [order[lows[k] : highs[k]] for k in range(lo, hi) if k != part]
        else:
            slices = [flat[lows[lo] : highs[hi - 1]]]
        near = [j[np.searchsorted(j, reach) : np.searchsorted(j, i)] for j in slices]
        j = np.concatenate(near)
        j = j[before[j] != before[i]] if hi - lo > FEW_PARTS else j
        if not len(j):
            return []
        lag = i - j
        end = i + np.maximum(length - lag, (periods - 1) * lag) - width  # the last group of words that the match needs
        lag, end = lag[end < n], end[end < n]
        return sorted(lag[gram[end] == gram[end - lag]].tolist())

    low_part, high_part = parts[:-1][kind_of].tolist(), parts[1:][kind_of].tolist()
    own_part = part_of.tolist()
    for i in again.tolist():
        if i != last + 1:
            for lag in list(live):
                ended(lag, last + 1)
        else:
            for lag in [lag for lag in live if g[i - lag] != g[i]]:
                ended(lag, i)
        last = i
        if high_part[i] - low_part[i] < 2:
            continue  # every occurrence follows the same words, so no match begins here
        for d in starts(i, own_part[i], low_part[i], high_part[i]):
            if not any(d % q == 0 and began - q == i - d for q, began in live.items()):
                live[d] = i
    for lag in list(live):
        ended(lag, last + 1)
    return sorted((s, size, q) for s, size, q in found if s + size <= total)


def digests(ids: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent in thousandths, digest of the runs, words kept)."""
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    gone = np.zeros(len(ids) + 1, np.int64)
    for s, size, q in runs:
        gone[s + q] += 1
        gone[s + size] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    best: tuple = (None, None, None)
    for s, size, q in runs:  # by start, then period, so the first of equals stays
        if best[0] is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    return len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), kept


def copied_tail(doc: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a text with a copied tail, or None for other texts.

    One id in ten is chosen by its checksum.  From word a on, words go round among the next p.
    """
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def _texts(column: pa.Array, ids: pa.Array, rewrite: Rewrite | None, periods: int, length: int):
    """(row, words, where its words come from, their numbers, runs) of each text."""
    words = split(*buffers(column))
    number, width = word_numbers(words), gram_width(periods, length)
    take = np.arange(len(number))
    if rewrite is not None:
        for k, doc in enumerate(ids.to_pylist()):
            lo, hi = words.first[k : k + 2]
            place = rewrite(doc, int(hi - lo))
            if place is not None:
                take[lo:hi] = lo + place
    number = number[take]
    gram = grams(number, width)
    for k, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        own = number[lo:hi]
        runs = find(own, gram[lo : max(lo, hi - width + 1)], periods, length) if hi - lo >= max(length, periods) else []
        yield k, words, take[lo:hi], own, runs


REPORT = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, periods: int = PERIODS, length: int = LENGTH, texts: bool = True
) -> DataFrame:
    """Runs of every row of ``docs`` and its text with each run cut down to its first period.

    A run is a stretch of words whose words one period apart are equal, with the smallest such period,
    that cannot be lengthened and holds at least ``periods`` periods and ``length`` words.  Returns
    id_col, n_runs, start, length, period and exponent_milli of the run with the most periods (of equals
    the first, then the shortest period; null without a run), digests of all runs and of the collapsed
    text, and that text (null without ``texts``).  ``rewrite`` may say for (id, words) which word stands
    at each place; a null id is an id like others.  Null, empty and white texts have no words.  Each row
    is read by itself, so repeated rows give equal rows and no rows give none.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                names, out = part.column("id").to_pylist(), []
                for k, words, take, own, runs in _texts(part.column("t"), part.column("id"), rewrite, periods, length):
                    *facts, kept = digests(own, runs)
                    raw = words.data
                    left = take[kept]
                    text = b" ".join([raw[a:b].tobytes() for a, b in zip(words.start[left].tolist(), words.end[left].tolist())])
                    out.append((names[k], *facts, hashlib.sha256(text).hexdigest(), text.decode() if texts else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], NAMES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(tidy(run), REPORT).withColumnRenamed("id", id_col)
    return found if texts else found.drop("collapsed")


NAMES = [c.split(" ")[0] for c in REPORT.split(", ")]
KINDS = [pa.int64()] * 6 + [pa.string()] * 3


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, periods: int = PERIODS, length: int = LENGTH) -> DataFrame:
    """(id_col, start, length, period) of every run of every row, as in ``collapse``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                names, out = part.column("id").to_pylist(), []
                for k, _, _, _, found in _texts(part.column("t"), part.column("id"), rewrite, periods, length):
                    out += [(names[k], *r) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["id", "start", "length", "period"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), "id long, start long, length long, period long").withColumnRenamed("id", id_col)
