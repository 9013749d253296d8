"""A compressed full-text index over numbered words, searched for many patterns at once.

The index holds the Burrows-Wheeler transform as a wavelet matrix: one bit vector per bit of the
word numbers, with counts per 64 bits.  Backward search maps an interval of suffixes to that of the
pattern with one more word in front.  Matching statistics shorten a match that cannot be extended
to the next shorter one that can, by the common-prefix lengths of neighbouring suffixes (Ohlebusch,
Gog and Kuegel, 2010).  Suffixes are sorted by their first 48 words, which is enough for patterns
of up to 48 words.
"""

from __future__ import annotations

import numpy as np

#: Words by which suffixes are sorted: three at first, then twice as many in each round.
STEPS = (3, 6, 12, 24, 48)
LONGEST = STEPS[-1]


class WaveletMatrix:
    """Ranks of any symbol in a sequence."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.levels = max(1, int(count - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        at = symbols
        for level in range(self.levels):
            bit = (at >> (self.levels - 1 - level)) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        self.begin = self.descend(np.arange(count), np.zeros(count, np.int64))

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the border before ``place`` lands in the last level, on the symbol's way down."""
        for level in range(self.levels):
            word = place >> 6
            low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & low)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self.descend(symbol, place) - self.begin[symbol]


class FMIndex:
    """Index of a text of word numbers; 0 is kept for separators, which no pattern holds."""

    def __init__(self, text: np.ndarray, count: int):
        n = len(text)
        self.size = n
        after = np.concatenate([text, np.full(LONGEST, -1)]) + 1
        if count < 1 << 20:
            key = (after[:n] << 42) | (after[1 : n + 1] << 21) | after[2 : n + 2]
        else:
            two = after[:n] * (count + 1) + after[1 : n + 1]
            key = np.unique(two, return_inverse=True)[1] * (count + 1) + after[2 : n + 2]
        ranks = {}
        for step in STEPS:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
            ranks[step] = rank
            key = rank.astype(np.int64) * (n + 1)
            key[: max(0, n - step)] += rank[step:] + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=count))))[:-1]
        self.matrix = WaveletMatrix(text[order - 1], count)
        self.common = self._common(order, ranks, text)
        self.borders: dict[int, np.ndarray] = {}

    def _common(self, suffixes: np.ndarray, ranks: dict[int, np.ndarray], text: np.ndarray) -> np.ndarray:
        """Common prefix length of each suffix with the one before it, at most 48; -1 at both ends."""
        a, b = suffixes[:-1], suffixes[1:]
        full = ranks[LONGEST][a] == ranks[LONGEST][b]
        at = np.flatnonzero(~full)
        a, b = a[at], b[at]
        same = np.zeros(len(at), np.int64)
        for step, rank in [*sorted(ranks.items(), reverse=True)[1:], (1, text), (1, text)]:
            i, j = a + same, b + same
            inside = (i < self.size) & (j < self.size)
            equal = inside & (rank[np.where(inside, i, 0)] == rank[np.where(inside, j, 0)])
            same += step * equal
        out = np.full(self.size + 1, LONGEST, np.int8)
        out[at + 1] = same
        out[[0, -1]] = -1
        return out

    def widen(self, low: np.ndarray, high: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of all suffixes that share ``depth`` words with those of the given intervals."""
        if depth not in self.borders:
            self.borders[depth] = np.flatnonzero(self.common < depth).astype(np.int32)
        at = self.borders[depth]
        first = np.searchsorted(at, low.astype(np.int32), "right") - 1  # of the same type, or all of ``at`` is cast
        last = np.searchsorted(at, high.astype(np.int32), "left")
        return at[first].astype(np.int64), at[last].astype(np.int64)

    def extend(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        both = self.matrix.rank(np.concatenate([word, word]), np.concatenate([low, high]))
        return self.first[word] + both[: len(low)], self.first[word] + both[len(low) :]

    def repeated(self, patterns: np.ndarray, start: np.ndarray, size: np.ndarray, limit: int, least: int = 2) -> np.ndarray:
        """Matching statistics of patterns, streamed from their ends, cut off at ``limit`` words.

        ``patterns`` holds all patterns' words, pattern p being ``size[p]`` words from ``start[p]``.
        Returns, for every word, the length of the longest match that starts there, lies in the
        pattern and occurs at least ``least`` times in the text.
        """
        if not 0 < limit <= LONGEST:
            raise ValueError("limit is out of range")
        out = np.zeros(len(patterns), np.int8)
        # where the suffixes that share limit - 1 words begin and end, as every full match asks for it
        border, place = self.common < limit - 1, np.arange(self.size + 1)
        before = np.maximum.accumulate(np.where(border, place, 0))
        after = np.minimum.accumulate(np.where(border, place, self.size)[::-1])[::-1]
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        low, high = np.zeros(len(size), np.int64), np.full(len(size), self.size)
        depth = np.zeros(len(size), np.int64)
        for step in range(int(size.max(initial=0))):
            lanes = int(np.searchsorted(-size, -step, "left"))
            place = start[:lanes] + size[:lanes] - 1 - step
            word = patterns[place]
            full = np.flatnonzero(depth[:lanes] == limit)
            if len(full):
                low[full], high[full] = before[low[full]], after[high[full]]
                depth[full] = limit - 1
            todo = np.arange(lanes)
            while len(todo):
                a, b = self.extend(low[todo], high[todo], word[todo])
                good = b - a >= least
                done = todo[good]
                low[done], high[done] = a[good], b[good]
                depth[done] += 1
                todo = todo[~good]
                todo = todo[depth[todo] > 0]  # the word alone is too rare
                if not len(todo):
                    break
                shorter = np.maximum(self.common[low[todo]], self.common[high[todo]]).astype(np.int64)
                shorter = np.clip(shorter, 0, depth[todo] - 1)
                depth[todo] = shorter
                by = np.argsort(shorter, kind="stable")
                cuts = np.flatnonzero(np.diff(shorter[by])) + 1
                for part in np.split(todo[by], cuts):
                    d = int(depth[part[0]])
                    if d:
                        low[part], high[part] = self.widen(low[part], high[part], d)
                    else:
                        low[part], high[part] = 0, self.size
            out[place] = depth[:lanes]
        return out
