"""Byte-pair encoding by a distinct-word table, and decoding by a piece table.

Words cannot be shuffled one by one within the disk allowance, so they travel by blocks.  A block
is some 32 MB of text; it keeps, for every position, the number of the word that stands there, and
sends its distinct words, dealt by hash into buckets, to the tables.  A table holds each distinct
word of the blocks of 64 partitions once, and each is encoded once; the ids go back to the block, where they
are joined to the positions.  Decoding joins the ids to the pieces of the vocabulary, which is a
table of fixed size.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import slices, tidy
from geoloom.llm.tokens import load

#: The split pattern of byte-level BPE (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

BLOCK_CHARS = 32 << 20
BUCKETS = 64
#: Partitions whose blocks share tables.  A block's number is its partition, shifted, and its place there.
GROUP = 64
SHIFT = 32

ROWS = "bucket int, family long, block long, a binary, b binary, c binary"
_NAMES = ["bucket", "family", "block", "a", "b", "c"]


#: Numbers below it take one byte at a position; others a class byte and two more.
SHORT = 200


def _squeeze(values) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(values.tobytes() if isinstance(values, np.ndarray) else values)


def _restore(blob: bytes, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def _planes(codes: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes, then all second bytes and so on: small ones compress well."""
    return _squeeze(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(_restore(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _ranks(ranks: np.ndarray) -> bytes:
    """Word numbers by position, frequent words low: a byte for most, two more for the rest."""
    if len(ranks) and ranks.max() >= SHORT + ((256 - SHORT) << 16):
        return b"\0" + _planes(ranks)
    long = ranks[ranks >= SHORT] - SHORT
    first = ranks.copy()
    first[ranks >= SHORT] = SHORT + (long >> 16)
    parts = [_squeeze(v.astype(np.uint8)) for v in (first, long & 255, (long >> 8) & 255)]
    return b"\1" + np.array([len(v) for v in parts], "<u8").tobytes() + b"".join(parts)


def _from_ranks(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\0":
        return _from_planes(blob[1:]).astype(np.int64)
    at = 25 + np.concatenate(([0], np.cumsum(np.frombuffer(blob[1:25], "<u8").astype(np.int64))))
    first, low, high = (_restore(blob[i:j], np.uint8).astype(np.int64) for i, j in zip(at[:-1], at[1:]))
    long = first >= SHORT
    first[long] = SHORT + ((first[long] - SHORT) << 16 | high << 8 | low)
    return first


def _row(bucket: int, block: int, a: bytes, b: bytes, c: bytes | None) -> pa.RecordBatch:
    values = [[bucket], [(block >> SHIFT) // GROUP], [block], [a], [b], [c]]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], _NAMES)


class _Block:
    """Documents as numbers of words, in order of first appearance."""

    def __init__(self, special: list[str]):
        self.number: defaultdict = defaultdict(count().__next__)
        self.codes: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.chars = 0
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return PATTERN.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else PATTERN.findall(part)
        return out

    def add(self, doc: int | None, text: str) -> None:
        words = self.words(text)
        self.codes.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc)
        self.chars += len(text)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """The positions, then the distinct words of each bucket; frequent words get low numbers."""
        size = np.array([len(c) for c in self.codes], np.int64)
        codes = np.concatenate(self.codes)
        self.codes = []
        order = np.argsort(-np.bincount(codes, minlength=len(self.number)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = np.array([d is not None for d in self.ids])
        doc = np.array([d or 0 for d in self.ids], np.int64)
        yield _row(-1, block, _squeeze(np.concatenate([doc, known.astype(np.int64), size])), _ranks(rank[codes]), None)
        words = [w.encode() for w in self.number]
        bucket = np.fromiter((crc32(w) % BUCKETS for w in words), np.int64, len(words))
        for k in range(BUCKETS):
            at = np.flatnonzero(bucket == k)
            if len(at):
                mine = [words[i] for i in at]
                yield _row(k, block, _squeeze(b"".join(mine)), _planes(np.fromiter(map(len, mine), np.int64, len(mine))), _planes(rank[at]))


def _split(batches: Iterator[pa.RecordBatch], special: list[str]) -> Iterator[pa.RecordBatch]:
    base, held = TaskContext.get().partitionId() << SHIFT, _Block(special)
    for batch in batches:
        for part in slices(batch, "t"):
            for doc, text in zip(part.column("id").to_pylist(), part.column("t").to_pylist()):
                held.add(doc, text or "")
                if held.chars >= BLOCK_CHARS:
                    yield from held.rows(base)
                    base, held = base + 1, _Block(special)
    if held.ids:
        yield from held.rows(base)


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """Words of a bucket to ids; rows come sorted by bucket and family, which share a table."""
    encoder, key, table = load(tokenizer), None, {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] < 0:
                yield _row(-1, r["block"], r["a"], r["b"], None)
                continue
            if key != (r["bucket"], r["family"]):
                key, table = (r["bucket"], r["family"]), {}
            raw, end = _restore(r["a"]), np.cumsum(_from_planes(r["b"]).astype(np.int64))
            words = [raw[i:j] for i, j in zip([0, *end[:-1].tolist()], end.tolist())]
            new = [w for w in words if w not in table]
            for w, e in zip(new, encoder.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                table[w] = np.array(e.ids, "<u4").tobytes()
            ids = [table[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            yield _row(r["bucket"], r["block"], _planes(np.frombuffer(b"".join(ids), "<u4")), _planes(sizes), r["c"])


def byte_pieces(tokenizer: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    raw = lambda t: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
    return [raw(names[i]) if i in names else b"" for i in range(max(names) + 1)]


@lru_cache(maxsize=1)
def _pieces(tokenizer: str) -> tuple[list[bytes], list[bytes]]:
    pieces = byte_pieces(tokenizer)
    return pieces, [str(i).encode() for i in range(len(pieces))]


def _pick(table: list[bytes], ids: list[int], glue: bytes) -> bytes:
    return glue.join(itemgetter(*ids)(table)) if len(ids) > 1 else b"".join(table[i] for i in ids)


def _join(rows: list[dict], tokenizer: str) -> pa.RecordBatch:
    """Ids back to the positions of a block, and its documents with their digests."""
    pieces, digits = _pieces(tokenizer)
    head = next(r for r in rows if r["bucket"] < 0)
    doc, known, size = _restore(head["a"], np.int64).reshape(3, -1)
    codes = _from_ranks(head["b"])
    blocks = [(_from_planes(r["a"]), _from_planes(r["b"]).astype(np.int64), _from_planes(r["c"])) for r in rows if r["bucket"] >= 0]
    n = sum(len(b[2]) for b in blocks)
    pool = np.concatenate([np.zeros(0, "<u4"), *[b[0] for b in blocks]])
    length, at, done = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for ids, sizes, place in blocks:
        length[place] = sizes
        at[place] = done + np.cumsum(sizes) - sizes
        done += len(ids)
    out, word = [], 0
    for k, words in enumerate(size.tolist()):
        mine = codes[word : word + words]
        word += words
        count_ = length[mine]
        upto = np.cumsum(count_)
        total = int(upto[-1]) if words else 0
        ids = pool[np.repeat(at[mine] - (upto - count_), count_) + np.arange(total)].tolist()
        text = _pick(pieces, ids, b"").decode("utf-8", "replace")
        out.append((int(doc[k]) if known[k] else None, total, hashlib.sha256(_pick(digits, ids, b",")).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    columns = list(zip(*out))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _assemble(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    block, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["block"] != block and held:
                yield _join(held, tokenizer)
                held = []
            block = r["block"]
            held.append(r)
    if held:
        yield _join(held, tokenizer)


def special_words(tokenizer: str) -> list[str]:
    with open(tokenizer, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again: (id_col, n_tokens, ids_sha256, decoded_sha256).

    Ids are those of the tokenizer library without added special tokens; the names of special
    tokens inside a text become their ids, as there.  Null is an empty text with no tokens.  Every
    row gives a row, repeated rows and null ids included; no rows give no rows.  Other columns are
    ignored.  ``docs`` must give its rows in a stable order, as stored tables and checkpoints do.
    """
    special = special_words(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    split = rows.mapInArrow(tidy(lambda batches: _split(batches, special)), ROWS)
    # dealt by number, as the few and large groups would share partitions if they were dealt by hash
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.shiftright("block", SHIFT) + F.col("block").bitwiseAND((1 << SHIFT) - 1) * (tasks // 2 + 1)
    table = F.when(F.col("bucket") >= 0, F.col("bucket") + F.col("family") * BUCKETS).otherwise(own)
    by_word = split.repartitionById(tasks, F.pmod(table, F.lit(tasks)).cast("int")).sortWithinPartitions("bucket", "family", "block")
    coded = by_word.mapInArrow(tidy(lambda batches: _encode(batches, tokenizer)), ROWS)
    by_block = coded.repartitionById(tasks, F.pmod(own, F.lit(tasks)).cast("int")).sortWithinPartitions("block", "bucket")
    out = by_block.mapInArrow(tidy(lambda batches: _assemble(batches, tokenizer)), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
