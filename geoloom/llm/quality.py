"""Quality rules: fixed limits and gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import SPACE, buffers, cover, gram_hashes, hashes, slices, split, tidy
from geoloom.llm.columns import lowest_hashes
from geoloom.llm.trees import Forest, train

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document stays if the trees give it at least this chance of being good.
KEEP_SCORE = 0.35
#: Labelled documents that the trees are fitted on, at most; those with the lowest hashes.
TRAIN_ROWS = 20_000

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
#: Bytes that begin a character.
LEAD = (np.arange(256) & 0xC0) != 0x80

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_kinds", "n_doubled")
FEATURES = ("symbols_per_word", "dup_lines", "repeat_words", "upper", "digits", "distinct", "doubled", "word_length", "words_per_line", "log_words")
#: The first features can only lower the score as they grow; distinct words can only raise it.
MONOTONE = {0: -1, 1: -1, 2: -1, 3: -1, 5: 1, 6: -1}


def _per_text(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[begin[1:]] - total[begin[:-1]]


def _lines(text: str | None) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\v\f")]
    return len(lines), len(lines) - len(set(lines))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of each text of a string column, as longs."""
    words = split(*buffers(column))
    text, n = words.text_of(), np.diff(words.first)
    size = len(words.start)
    h = hashes(words)
    own = h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    grams = gram_hashes(own, WINDOW)
    whole = text[: len(grams)] == text[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    order = np.argsort(grams[at], kind="stable")
    g = grams[at][order]
    same = g[1:] == g[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    # equal hashes in different texts are not repeats: the text is part of the hash
    again = cover(at[twice], WINDOW, size)
    ink = LEAD[words.data] & ~SPACE[words.data]
    order = np.argsort(own, kind="stable")
    kinds = np.zeros(size, bool)
    kinds[order] = np.concatenate(([True], own[order][1:] != own[order][:-1])) if size else True
    doubled = np.zeros(size, bool)
    doubled[1:] = own[1:] == own[:-1]
    lines = np.array([_lines(t) for t in column.to_pylist()], np.int64).reshape(-1, 2)
    by_byte = lambda table: _per_text(table[words.data], words.begin)
    by_word = lambda flags: _per_text(flags, words.first)
    return {
        "n_words": n,
        "word_chars": _per_text(ink, words.begin),
        "n_symbols": by_byte(SYMBOL),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": by_word(again),
        "n_lines": lines[:, 0],
        "n_upper": by_byte(UPPER),
        "n_digits": by_byte(DIGIT),
        "n_kinds": by_word(kinds),
        "n_doubled": by_word(doubled),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    n, chars, lines = (np.maximum(1, s[k]).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    columns = [
        s["n_symbols"] / n, s["n_dup_lines"] / lines, s["n_repeat_words"] / n, s["n_upper"] / chars, s["n_digits"] / chars,
        s["n_kinds"] / n, s["n_doubled"] / n, s["word_chars"] / n, s["n_words"] / lines, np.log1p(s["n_words"]),
    ]
    return np.stack(columns, 1)


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    """Too few words, or too many of them in windows that the text repeats."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                s = measure(part.column("t"))
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(s[k]) for k in STATS + MORE]], ["id", *STATS, *MORE])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), "id long, " + ", ".join(f"{k} long" for k in STATS + MORE))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Trees from at most ``rows`` labelled documents; without labels every document gets 0.5.

    Of rows that repeat a labelled id, the one with the lowest statistics is taken.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna()
    known = lowest_hashes(known.groupBy("id").agg(F.max("y").alias("y")), "id", [], rows)
    # at most `rows` ids and labels are sent to all executors
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(F.broadcast(known), "id")
    single = statistics(picked, "id", "t").groupBy("id").agg(F.min(F.struct(*STATS, *MORE)).alias("s")).select("id", "s.*")
    table = single.join(F.broadcast(known), "id").toPandas().sort_values("id")
    s = {k: table[k].to_numpy(np.int64) for k in STATS + MORE}
    good = ~base_failed(s)
    return train(features(s)[good], table["y"].to_numpy(float)[good], MONOTONE)


def assess(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """Statistics and verdict of every row of ``docs``.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    score.  A text fails the base rules with fewer than 10 words, or if over a fifth of them lie in
    five-word windows that occur twice in it; otherwise it is kept if the trees' score reaches
    ``keep_score``.  Null is an empty text, which fails.  Each row is judged by its own text, so
    repeated rows get the same verdict; no rows give no rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                s = measure(part.column("t"))
                failed = base_failed(s)
                score = model.score(features(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[pa.array(s[k]) for k in STATS], pa.array(failed), pa.array(~failed & (score >= keep_score)), pa.array(score)],
                    ["id", *STATS, "base_failed", "kept", "score"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    schema = "id long, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Forest, text_col: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, all columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                s = measure(part.column(text_col))
                yield part.filter(pa.array(~base_failed(s) & (model.score(features(s)) >= keep_score)))

    return docs.mapInArrow(tidy(run), docs.schema)
