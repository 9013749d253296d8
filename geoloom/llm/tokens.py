"""Token ids of texts by distinct words.

Words repeat far more often than they are new, so a tokenizer is asked once per word and the
answers are put together.  This is exact where no token spans two words.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import regex

from geoloom.llm.arrow_text import SPACE, buffers, split

#: New words that go through the tokenizer as one text; its own records of a text take many times its size.
TOGETHER = 8_000
#: Bytes that one remembered word takes: its letters, its ids and a place in a table.
WORD_COST = 230

#: Letters and ASCII marks after them: two parts for the tokenizer, which nothing joins.
_MARKED = regex.compile(r"(\p{L}+)([!-/:-@\[-`{-~]+)")


def load(path: str):
    """A tokenizer from a file, with truncation and padding off."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordIds:
    """Little-endian 32-bit ids of texts, for a tokenizer that drops white space, lower-cases, parts
    letters from marks and has pieces of its own for the ends of words.

    New words of some texts are encoded together: words of letters only, which the tokenizer never
    parts, go through it as one text, and the pieces that end a word tell where the next one begins.
    The words met last are remembered, in two generations of about ``limit`` bytes, so memory is bounded
    and frequent words stay.
    """

    def __init__(self, path: str, limit: int = 48 << 20):
        self.tokenizer, self.limit, self.held = load(path), limit, 0
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return [self.ids(w) for w in words]
        raw, upto = ids.tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip([0, *upto], upto)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of different words."""
        if self.held > self.limit:
            self.old, self.known, self.held = self.known, {}, 0
        known, old, parts, plain, before = self.known, self.old, [], set(), len(self.known)
        for word in words:
            if word in known:
                continue
            if word in old:
                known[word] = old[word]
                continue
            core, mark = word, ""
            if not word.isalpha():
                m = _MARKED.fullmatch(word)
                if m is None:
                    known[word] = self.ids(word)
                    continue
                core, mark = m.groups()
            if core.isascii():
                core = core.lower()
            parts.append((word, core, mark))
            if core not in known:
                if core in old:
                    known[core] = old[core]
                else:
                    plain.add(core)
        if plain:
            names = list(plain)
            for at in range(0, len(names), TOGETHER):
                some = names[at : at + TOGETHER]
                known.update(zip(some, self._letters(some)))
        for word, core, mark in parts:
            if mark and mark not in known:
                known[mark] = self.ids(mark)
            known[word] = known[core] + known[mark] if mark else known[core]
        self.held += WORD_COST * (len(known) - before)
        return list(map(known.__getitem__, words))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after another, and where each text's begin."""
        words = split(*buffers(column))
        ink = words.data[~SPACE[words.data]]  # the words' bytes, as words are all that is not space
        at = np.concatenate(([0], np.cumsum(words.end - words.start)))
        spelled = pa.Array.from_buffers(pa.large_string(), len(words.start), [None, pa.py_buffer(at), pa.py_buffer(ink)])
        coded = spelled.dictionary_encode()
        pool = self._learn(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        begin = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        upto = np.concatenate(([0], np.cumsum(size[word])))
        take = np.repeat(begin[word] - upto[:-1], size[word]) + np.arange(upto[-1])
        return np.frombuffer(b"".join(pool), "<u4")[take], upto[words.first]
