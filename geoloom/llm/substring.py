"""Removal of passages that occur more than once, by compressed indexes over shards of windows.

A window is ``width`` consecutive words of a document.  Its anchor is the lowest hash of its
eight-word groups, so equal windows have equal anchors; consecutive windows around one place of an
anchor make a segment.  Segments whose anchor occurs once are settled by an aggregate of anchors.  The
others are dealt to shards by anchor, so that all occurrences of a window meet in one shard; equal
segments are sent once with their number.  A shard indexes its segments and streams them through
the index: matching statistics tell which windows occur at another place.  The ranges found go
back to their documents, where the words they cover are removed.

Anchors with very many different segments (what surrounds a passage that everybody quotes) would
make one shard too large; their windows are dealt one by one, by the hash of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import MIX_A, SPACE, Words, buffers, gram_hashes, hashes, mix, runs, slices, split, tidy
from geoloom.llm.columns import unused
from geoloom.llm.fm import FMIndex
from geoloom.session import checkpoint

WIDTH = 35
GROUP_WORDS = 8
#: Words that a shard is meant to index.
SHARD_WORDS = 800_000
SEGMENT_WORDS = 50  # of a usual segment
#: Text per partition where documents are dealt by id.
TASK_BYTES = 24 << 20
#: An anchor is crowded if so many of 64 marks are set, of one in 64 of its different segments each.
CROWDED = 25


class Segments:
    """Runs of windows around the same place of an anchor in some texts."""

    def __init__(self, words: Words, width: int):
        self.words = words
        group = min(GROUP_WORDS, width)
        h = hashes(words)
        n = len(h) - width + 1
        text = words.text_of()
        if n <= 0:
            self.key = np.zeros(0, np.uint64)
            self.first = self.count = self.text = np.zeros(0, np.int64)
            return
        span = width - group + 1
        low, have = gram_hashes(h, group), 1
        at = np.arange(len(low))
        while have < span:  # leftmost sliding minimum by doubling
            more = min(have, span - have)
            later = low[more:] < low[: len(low) - more]
            at = np.where(later, at[more:], at[: len(at) - more])
            low = np.minimum(low[: len(low) - more], low[more:])
            have += more
        whole = text[:n] == text[width - 1 :]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:n] != text[: n - 1]) | (whole[1:] != whole[:-1])))
        begin = np.flatnonzero(new)
        self.count = np.diff(np.concatenate((begin, [n])))
        keep = whole[begin]
        self.first, self.count = begin[keep], self.count[keep]
        self.key, self.text, self.hashes, self.width = low[self.first], text[self.first], h, width

    def digests(self) -> np.ndarray:
        """A 64-bit hash of the words of each segment."""
        if not len(self.first):
            return np.zeros(0, np.uint64)
        n = len(self.hashes)
        power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, MIX_A))))
        inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(MIX_A), -1, 1 << 64))))))
        total = np.concatenate(([np.uint64(0)], np.cumsum(self.hashes * power[:-1], dtype=np.uint64)))
        return mix((total[self.first + self.count + self.width - 1] - total[self.first]) * inverse[self.first])

    def spaced(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by a space, and where each begins."""
        w = self.words
        size = w.end - w.start
        begin = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 32, np.uint8)
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = w.data[~SPACE[w.data]]
        return out.tobytes(), np.concatenate((begin, [len(out)]))


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(rid, key, digest) of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                segs = Segments(split(*buffers(part.column("t"))), width)
                rid = part.column("rid").to_numpy()[segs.text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), pa.array(segs.key.view(np.int64)), pa.array(segs.digests().view(np.int64))], ["rid", "key", "digest"]
                )

    return docs.select("rid", "t").mapInArrow(tidy(run), "rid long, key long, digest long")


def _wanted(docs: DataFrame, width: int) -> DataFrame:
    """(rid, keys, crowded): per document, its anchors that occur more than once."""
    mark = F.when(F.col("digest").bitwiseAND(63) == 0, F.expr("shiftleft(1L, cast(shiftrightunsigned(digest, 6) & 63 as int))")).otherwise(0)
    seen = _anchors(docs, width).select("key", mark.alias("m")).groupBy("key").agg(F.count("*").alias("n"), F.bit_or("m").alias("marks"))
    # written, so that the join below can split an anchor with very many documents
    twice = checkpoint(seen.where("n > 1").select("key", (F.bit_count("marks") >= CROWDED).alias("crowded")))
    pairs = _anchors(docs, width).select("rid", "key").join(twice, "key")
    return checkpoint(pairs.groupBy("rid").agg(F.collect_set(F.struct("key", "crowded")).alias("keys")))


@dataclass(frozen=True)
class _Names:
    """Columns of the dealt rows; helpers have names that the input does not use."""

    text: str
    rid: str
    hash: str
    keys: str
    ranges: str


def _pieces(part: pa.RecordBatch, names: _Names, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, first word, shard key, words) of the segments of wanted anchors, crowded ones by window."""
    segs = Segments(split(*buffers(part.column(names.text))), width)
    lists = part.column(names.keys)
    flat = lists.flatten()
    key = flat.field("key").to_numpy().view(np.uint64)
    crowded = flat.field("crowded").to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    named = lambda row, anchor: mix(anchor ^ mix(row.astype(np.uint64) + np.uint64(1)))
    own, wanted = named(segs.text, segs.key), named(of, key)
    by_window = np.isin(own, wanted[crowded])
    grams = gram_hashes(segs.hashes, width) if by_window.any() else None
    raw, begin = segs.spaced()
    picked = np.flatnonzero(np.isin(own, wanted))
    first, count = segs.first[picked], segs.count[picked]
    place = first - segs.words.first[segs.text[picked]]
    ends = begin[first + count + width - 1] - 1
    rows = zip(segs.text[picked].tolist(), place.tolist(), segs.key[picked].tolist(), begin[first].tolist(), ends.tolist(), by_window[picked].tolist(), first.tolist(), count.tolist())
    for row, at, anchor, x, y, split_, word, windows in rows:
        if not split_:
            yield row, at, anchor, raw[x:y]
            continue
        for w in range(word, word + windows):
            yield row, at + w - word, int(grams[w]), raw[begin[w] : begin[w + width] - 1]


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


_ROWS = "shard int, sid binary, words binary, n long, rid long, h long, a int, b int"
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
_FOUND = "rid long, h long, a int, b int"


def _batch(kinds: list[pa.DataType], schema: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split(" ")[0] for c in schema.split(", ")])


def _segments(rows: DataFrame, names: _Names, width: int, shards: int) -> DataFrame:
    """Segments for the shards, each with the place where it stands.

    Segments that a batch holds more than once are settled: their places are ranges already, which go
    along without a segment id, and the shard gets one copy with their number.  So a segment with very
    many copies gives its shard a row per batch at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, tuple[int, bytes, list]] = {}
            for part in slices(batch, names.text):
                rid, h = part.column(names.rid).to_pylist(), part.column(names.hash).to_pylist()
                for row, place, anchor, words in _pieces(part, names, width):
                    found.setdefault(_digest(words), (anchor % shards, words, []))[2].append((rid[row], h[row], place))
            out = []
            for sid, (shard, words, places) in found.items():
                if len(places) == 1:
                    out.append((shard, sid, words, 1, *places[0], None))
                    continue
                out.append((shard, sid, words, len(places), None, None, None, None))
                size = words.count(b" ") + 1
                out += [(r % shards, None, None, None, r, h_, a, a + size) for r, h_, a in places]
            yield _batch(_KINDS, _ROWS, out)

    return rows.mapInArrow(tidy(run), _ROWS)


def _search(segments: list[list], width: int) -> pa.RecordBatch:
    """Ranges of repeated words in the documents of a shard's segments."""
    parts, counts = [s[1] for s in segments], np.array([s[2] for s in segments])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    words = split(raw, np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))))
    at = np.concatenate(([0], np.cumsum(words.end - words.start)))
    spelled = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(at), pa.py_buffer(raw[~SPACE[raw]])])
    coded = spelled.dictionary_encode()
    size = np.diff(words.first)
    start = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int64)  # a separator follows each segment
    text[np.arange(len(words.start)) + words.text_of()] = coded.indices.to_numpy() + 1
    # segments with copies are settled; they are in the index for the others' sake
    single = counts == 1
    again = np.zeros(len(text), bool)
    if single.any():
        index = FMIndex(text, len(coded.dictionary) + 1)
        again = index.repeated(text, start[single], size[single], width) >= width
    step = np.zeros(len(text) + 1, np.int8)
    step[start[~single]] += 1
    step[(start + size - width + 1)[~single]] -= 1
    again |= np.cumsum(step[:-1], dtype=np.int8) > 0
    begins, ends = runs(again)  # no window begins in a segment's last words, so runs don't span segments
    of = np.searchsorted(start, begins, "right") - 1
    number = np.array([len(s[3]) for s in segments])
    first = np.cumsum(number) - number
    places = np.array([p for s in segments for p in s[3]], np.int64).reshape(-1, 3)
    times = number[of]
    pick = np.repeat(first[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    rid, h, place = places[pick].T
    a = place + np.repeat(begins - start[of], times)
    b = place + np.repeat(ends - start[of] + width - 1, times)
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(h), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["rid", "h", "a", "b"])


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(rid, h, a, b) from shards that come one after another, sorted by segment id."""
    shard, held = None, []
    for batch in batches:
        settled = pc.is_null(batch.column("sid"))
        yield batch.filter(settled).select(["rid", "h", "a", "b"])
        rest = batch.filter(pc.invert(settled)).select(["shard", "sid", "words", "n", "rid", "h", "a"])
        for s, sid, words, n, rid, h, a in zip(*(c.to_pylist() for c in rest.columns)):
            if s != shard and held:
                yield _search(held, width)
                held = []
            shard = s
            if not held or held[-1][0] != sid:
                held.append([sid, words, 0, []])
            held[-1][2] += n
            if rid is not None:
                held[-1][3].append((rid, h, a))
    if held:
        yield _search(held, width)


def _cut(text: str | None, ranges: list[dict]) -> tuple[list[bytes], int]:
    """(kept words, number of removed words)."""
    words = (text or "").encode().split()
    if not ranges:
        return words, 0
    kept, upto, removed = [], 0, 0
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if a > upto:
            kept += words[upto:a]
        removed += max(0, b - max(a, upto))
        upto = max(upto, b)
    return kept + words[upto:], removed


_PLACES = "array<struct<h:bigint,a:int,b:int>>"


def _with_ranges(docs: DataFrame, text_col: str, id_col: str, width: int, shard_words: int) -> tuple[DataFrame, str]:
    """``docs`` with a column of the ranges of repeated words of each row, and its name.

    The texts are shuffled once, by row id.  Both uses of that exchange ask for the same columns, so
    that the plan can share it.
    """
    names = _Names(text_col, *(unused(docs, c) for c in ("_rid", "_hash", "_keys", "_ranges")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # null ids are spread by text; ids need not differ, as ranges also name the text
    own = docs.withColumn(names.rid, F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)))
    size = own.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    wanted = _wanted(own.select(F.col(names.rid).alias("rid"), text.alias("t")), width)
    many = wanted.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"]
    shards = int(max(cores, many * SEGMENT_WORDS // shard_words + 1))
    # with fewer partitions than the session's the joins would deal the texts out again
    tasks = int(max(cores, size // TASK_BYTES + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = own.repartition(tasks, names.rid)
    keys = wanted.withColumnsRenamed({"rid": names.rid, "keys": names.keys}).repartition(tasks, names.rid)
    rows = dealt.join(keys, names.rid).withColumn(names.hash, F.xxhash64(text))
    found = (
        _segments(rows, names, width, shards).repartitionById(shards, "shard").sortWithinPartitions("shard", "sid")
        .mapInArrow(tidy(lambda batches: _shards(batches, width)), _FOUND)
    )
    places = found.withColumnRenamed("rid", names.rid).repartition(tasks, names.rid)
    by_doc = places.groupBy(names.rid).agg(F.collect_set(F.struct("h", "a", "b")).alias(names.ranges))
    mine = F.filter(F.coalesce(names.ranges, F.array().cast(_PLACES)), lambda x: x["h"] == F.xxhash64(text))
    return dealt.join(by_doc, names.rid, "left").withColumn(names.ranges, mine), names.ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, ``text_col`` without the words of repeated windows.

    Words are what white space parts.  Texts that lose words become their kept words with single
    spaces; others stay as they are.  Windows are judged on the input.  A row that repeats another
    makes all its windows repeated.  Null and short texts have no window and stay.
    """

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                out = []
                for old, ranges in zip(part.column(text_col).to_pylist(), part.column(ranges_col).to_pylist()):
                    out.append(b" ".join(_cut(old, ranges)[0]).decode() if ranges else old)
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, text_col, pa.array(out, pa.string())).select(names)

    marked, ranges_col = _with_ranges(docs, text_col, id_col, width, shard_words)
    return marked.mapInArrow(tidy(run), docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of every row; see ``remove_repeats``.

    Null is a text without words.  Repeated rows, equal ids with different texts and null ids give a
    row each.  No rows give no rows.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, ranges in zip(part.column("text").to_pylist(), part.column(ranges_col).to_pylist()):
                    kept, removed = _cut(text, ranges)
                    rows.append((len(kept) + removed, removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
                kinds = [pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked, ranges_col = _with_ranges(rows, "text", "id", width, shard_words)
    marked = marked.select("id", "text", ranges_col)
    return marked.mapInArrow(tidy(run), "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
