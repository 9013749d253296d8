"""Words of Arrow string columns, found on the raw UTF-8 bytes.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return.  None of these bytes occurs inside a multi-byte character, so working on
bytes gives the words of the text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; longer texts are handled alone.
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Offset basis and prime of the 64-bit FNV-1a hash, and the two factors of the 64-bit
#: finaliser of MurmurHash3 (fixed values).
FNV_BASIS = np.uint64(0xCBF29CE484222325)
FNV_PRIME = np.uint64(0x00000100000001B3)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in ``data`` and, per text, ranges of words."""

    data: np.ndarray
    begin: np.ndarray  # of texts, in bytes; one more than there are texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of texts, in words; one more than there are texts

    def text_of(self) -> np.ndarray:
        """Index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, begin: np.ndarray) -> Words:
    n = len(data)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[begin] = True
    ink = ~space
    head = ink.copy()
    head[1:] &= space[:-1] | edge[1:n]
    tail = ink.copy()
    tail[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return Words(data, begin, start, end, np.searchsorted(start, begin))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or one row."""
    _, at = buffers(batch.column(column))
    row, n = 0, batch.num_rows
    while row < n:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield batch.slice(row, upto - row)
        row = upto


def release() -> None:
    """Give memory that is free back to the system, so that a worker does not keep a task's peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc has it, others manage without
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with memory given back at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX_A
    h = (h ^ (h >> np.uint64(33))) * MIX_B
    return h ^ (h >> np.uint64(33))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    size = words.end - words.start
    h = np.full(len(size), FNV_BASIS)
    live, k = np.arange(len(size)), 0
    while len(live):
        h[live] = (h[live] ^ words.data[words.start[live] + k]) * FNV_PRIME
        k += 1
        live = live[size[live] > k]
    return mix(h)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words, by first word (over text borders as well)."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = (out + h[k : k + count]) * MIX_B
    return mix(out)


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true."""
    step = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for some start s."""
    step = np.zeros(n + width + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step)[:n] > 0
