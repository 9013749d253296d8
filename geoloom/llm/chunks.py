"""Document fingerprints from content-defined chunks.

A gear hash runs over the bytes; where its high bits are zero, a chunk ends.  Chunk lengths are
normalised: before the usual length more bits must be zero, after it fewer.  A fingerprint is the
set of chunk digests with their lengths in bytes, so an edit changes only the chunks it touches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import slices, tidy

LEAST, USUAL, MOST = 24, 64, 512
#: High bits that must be zero for a border before and after the usual length.
STRICT_BITS, LOOSE_BITS = 7, 5
#: Text bytes per task of the pass that needs neighbours.
TASK_BYTES = 24 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gears() -> np.ndarray:
    """One random-looking 64-bit number per byte value, by a rule (SplitMix64)."""
    z = (np.arange(1, 257, dtype=np.uint64) * _MIX).copy()
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


GEAR = _gears()
WINDOW = 32  # bytes that the hash sees


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte: the gears of the last 32 bytes, older ones shifted further."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        older = h[:-span] << np.uint64(span)
        h = h.copy()
        h[span:] += older
        span *= 2
    return h


def borders(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks."""
    n = len(data)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    h = gear_hashes(data)
    # the lowest bits see few bytes, so the border is decided by high bits of the 32 seen ones
    loose = np.flatnonzero((h >> np.uint64(64 - LOOSE_BITS)) == 0) + 1
    strict = ((h[loose - 1] >> np.uint64(64 - STRICT_BITS)) == 0).tolist()
    ends, begin, k, places, count = [], 0, 0, loose.tolist(), len(loose)
    while n - begin > LEAST:
        while k < count and places[k] < begin + LEAST:
            k += 1
        j = k
        while j < count and places[j] < begin + USUAL and not strict[j]:
            j += 1
        cut = places[j] if j < count else n
        cut = min(cut, begin + MOST, n)
        ends.append(cut)
        begin = cut
    if begin < n:
        ends.append(n)
    return np.array(ends, np.int64)


def fingerprint(text: str | None) -> dict[int, int]:
    """Chunk digest to total length in bytes; an empty text has none."""
    raw = (text or "").encode()
    out: dict[int, int] = {}
    begin = 0
    for end in borders(np.frombuffer(raw, np.uint8)).tolist():
        key = int.from_bytes(hashlib.blake2b(raw[begin:end], digest_size=6).digest(), "big")
        out[key] = out.get(key, 0) + end - begin
        begin = end
    return out


def show(chunks: dict[int, int]) -> str:
    """Fingerprint as text: digest:length, by digest."""
    return ",".join(f"{k:012x}:{v}" for k, v in sorted(chunks.items()))


def parse(fingerprint_: str) -> dict[int, int]:
    return {int(k, 16): int(v) for k, v in (x.split(":") for x in fingerprint_.split(","))} if fingerprint_ else {}


def shared(a: dict[int, int], b: dict[int, int]) -> int:
    """Bytes that both fingerprints hold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return sum(min(v, large[k]) for k, v in small.items() if k in large)


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's bytes in chunks that b holds; an empty a is contained in anything."""
    total = sum(a.values())
    return shared(a, b) / total if total else 1.0


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The smaller of the two containments: 1 for equal texts, 0 without a common chunk."""
    if not a and not b:
        return 1.0
    return min(containment(a, b), containment(b, a)) if a and b else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every row; null is an empty text, whose fingerprint is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                out = [show(fingerprint(t)) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), "id long, fingerprint string").withColumnRenamed("id", id_col)


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _compare(doc, text: str, own: dict, after: str, following: dict) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    changed = own if edited == text else fingerprint(edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return doc, len(text), digest, show(own), show(changed), likeness(own, changed), likeness(own, following)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how alike they and the next text are.

    In the edited text the last half of the code points is replaced by the first as many of the next
    document by ascending id; after the last comes the first.  Null is an empty text.  Rows with a
    null id come first; rows with equal ids follow each other by text, repeated rows among them.  A
    single row is its own next document.  No rows give no rows.  Other columns are ignored.

    The ids are cut into ranges of about ``task_bytes`` of text; the first row of each range is also
    sent to the range before it, so that a range can be read in order on its own.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("o"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = rows.agg(F.sum(F.octet_length("t")).alias("b"), F.count("*").alias("n")).first()
    if not size["n"]:
        return rows.mapInArrow(lambda batches: iter(()), _OUT).withColumnRenamed("id", id_col)
    tasks = max(cores, size["b"] // task_bytes + 1)
    # as many numbers as there are ranges
    cuts = rows.select("o").repartitionByRange(tasks, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("o"))
    first = np.array(sorted({r["o"] for r in cuts.collect()}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = batch.column("o").to_numpy()
            part = np.searchsorted(first, o, "right") - 1
            yield _dealt(batch, part, False)
            head = np.flatnonzero(first[part] == o)
            if len(head):
                yield _dealt(batch.take(pa.array(head)), (part[head] - 1) % len(first), True)

    dealt = rows.mapInArrow(tidy(deal), "part int, guest boolean, o long, id long, t string")
    # a range to a task: by hash some tasks would get several ranges and others none
    placed = dealt.repartitionById(int(tasks), "part").sortWithinPartitions("part", "guest", "o", "t")
    return placed.mapInArrow(tidy(_walk), _OUT).withColumnRenamed("id", id_col)


def _dealt(batch: pa.RecordBatch, part: np.ndarray, guest: bool) -> pa.RecordBatch:
    columns = [pa.array(part, pa.int32()), pa.array(np.full(len(part), guest)), *batch.columns]
    return pa.RecordBatch.from_arrays(columns, ["part", "guest", "o", "id", "t"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order, then its guests, of which the first is the next row."""
    part, last, over = None, None, False
    for batch in batches:
        out = []
        for k, guest, _, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            if k != part:
                part, last, over = k, None, False
            if over:
                continue
            own = fingerprint(text)
            if last is not None:
                out.append(_compare(*last, text, own))
            last, over = (doc, text, own), guest
        if out:
            yield _emit(out)
