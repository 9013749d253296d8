"""Best-fit packing of tokenized documents in rounds.

Round one packs the pieces that lie in one partition by best fit, longest first.  Sequences with
less room than the shortest of all sequences needs are done, as nothing can join them.  The others
are dealt out to fewer partitions, where they are the items of the next round, until one partition
holds what is left or a round saves less than one sequence per partition.
A sequence carries its members (at most as many as it has tokens), so no join is needed to place
them, and a task holds a bounded number of items at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import slices, tidy
from geoloom.llm.tokens import WordIds
from geoloom.session import checkpoint

LENGTH = 4096
END_ID = 1
#: Text whose new words are encoded together.
WORDS_BYTES = 4 << 20
#: Bytes of words that a worker remembers, in each of two generations.
MEMORY_BYTES = 48 << 20
#: Items and pieces that a task packs at once.
ITEMS = 60_000
PIECES = 1_000_000

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BINS = f"sequence_id bigint, fill int, members array<{MEMBER}>"
MEMBER_TYPE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


@lru_cache(maxsize=1)
def _encoder(tokenizer: str, remembered: int) -> WordIds:
    """A worker keeps its words for its next task."""
    return WordIds(tokenizer, remembered)


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, together: int = WORDS_BYTES, remembered: int = MEMORY_BYTES
) -> DataFrame:
    """Token pieces of every document as unpacked sequences of one member each."""
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, remembered)
        for batch in batches:
            for part in slices(batch, "t", together):
                rows: list[tuple] = []
                ids, begin = encode(part.column("t"))
                for doc, a, b in zip(part.column("id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
                    own = np.concatenate([ids[a:b], end])
                    n = len(own)
                    rows += [(doc, k, s, min(length, n - s), zlib.crc32(own[s : s + length]), 0) for k, s in enumerate(range(0, n, length))]
                columns = zip(*rows)
                members = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MEMBER_TYPE)], fields=list(MEMBER_TYPE))
                yield _bins(np.arange(len(rows) + 1), members, np.arange(len(rows)))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), BINS)


def _bins(offsets: np.ndarray, members: pa.StructArray, number: np.ndarray) -> pa.RecordBatch:
    """Sequences of consecutive members; each member gets its place in its sequence."""
    size = members.field("length").to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(size)))
    fill = upto[offsets[1:]] - upto[offsets[:-1]]
    place = upto[:-1] - np.repeat(upto[offsets[:-1]], np.diff(offsets))
    fields = [members.field(f.name) for f in MEMBER_TYPE][:-1] + [pa.array(place, pa.int64())]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(MEMBER_TYPE)))
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(fill, pa.int32()), lists], ["sequence_id", "fill", "members"])


def best_fit(size: list[int], room_at_all: int) -> list[int]:
    """Bin of each item, longest first, each into the fullest bin that has room."""
    bins, by_room, has = [0] * len(size), [[] for _ in range(room_at_all + 1)], 0
    made = 0
    for i in sorted(range(len(size)), key=lambda k: -size[k]):
        fits = has >> size[i]
        if fits:
            room = size[i] + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                has ^= 1 << room
        else:
            room, at = room_at_all, made
            made += 1
        bins[i] = at
        room -= size[i]
        if room:
            if not by_room[room]:
                has |= 1 << room
            by_room[room].append(at)
    return bins


def _pack(held: list[pa.RecordBatch], length: int, base: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    lists = rows.column("members")
    members, count = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(count) - count
    place = np.array(best_fit(rows.column("fill").to_pylist(), length))
    order = np.argsort(place, kind="stable")
    take = np.repeat(first[order] - (np.cumsum(count[order]) - count[order]), count[order]) + np.arange(count.sum())
    sizes = np.bincount(place, weights=count).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return _bins(offsets, members.take(pa.array(take)), base + np.arange(len(sizes)))


def _round(bins: DataFrame, level: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        held, items, members = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ITEMS):
                part = batch.slice(at, ITEMS)
                held.append(part)
                items += part.num_rows
                members += len(part.column("members").flatten())
                if items >= ITEMS or members >= PIECES:
                    out = _pack(held, length, base)
                    yield out
                    base += out.num_rows
                    held, items, members = [], 0, 0
        if items:
            yield _pack(held, length, base)

    return bins.mapInArrow(tidy(run), BINS)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, together: int = WORDS_BYTES, remembered: int = MEMORY_BYTES
) -> DataFrame:
    """Place every token piece of ``docs`` in a sequence of at most ``length`` tokens.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset.  A document is its token
    ids and the id 1, so a null or empty text is one token long; only longer documents than a
    sequence are cut.  Every row is a document of its own, repeated rows and null ids included.
    No rows give no rows.  Other columns are ignored.  A worker encodes the new words of ``together`` bytes
    of text at once and remembers about twice ``remembered`` bytes of words; less of both takes less memory
    and more time.
    """
    level, parts, tasks, opened = 1, [], None, 0
    bins = checkpoint(_round(pieces(docs, tokenizer, id_col, text_col, length, together, remembered), level, length))
    while True:
        total, shortest = bins.agg(F.count("*"), F.min("fill")).first()
        fits = F.col("fill") + (shortest or 0) <= length
        n = bins.where(fits).count()
        if n < 2 or tasks and (tasks == 1 or opened - total < tasks):
            parts.append(bins)
            break
        parts.append(bins.where(~fits))
        level, tasks, opened = level + 1, -(-n // ITEMS), n
        bins = checkpoint(_round(bins.where(fits).repartition(tasks, F.xxhash64("sequence_id", F.lit(level))), level, length))
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    placed = done.select("sequence_id", F.explode("members").alias("m"))
    return placed.select(F.col("m.doc_id").alias(id_col), "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
