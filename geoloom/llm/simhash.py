"""Near-duplicate documents by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common value within ceil(r / 2) bits of
both, so if each emits everything within that radius, they meet there.  The whole ball of
radius 2 around 64 bits has 2,081 values, which as rows is more than the disk allowance.
Hence two steps.  First, of two fingerprints at distance 4 one of the two 32-bit halves
differs in at most 2 bits: every fingerprint emits the radius-1 ball of each half (66 rows),
is shuffled on these variants, and meets all its partners.  Second, where many fingerprints
meet under one variant, their other halves are hashed by balls as well, with the radius that
is left; what meets then is linked without comparing pairs.  Both steps are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.arrow_text import slices, tidy
from geoloom.llm.columns import unused
from geoloom.operators.graph import components
from geoloom.session import checkpoint

SEED = 42
BITS = 4  # differing bits that still link
#: Fingerprints under one variant up to which all pairs are compared.
PAIRWISE = 64
#: Fingerprints under one variant whose balls are kept in one task; larger groups are
#: shuffled on the whole midpoint.
LOCAL_BALL = 20_000
#: Midpoints that a task holds at once.
BALL_ROWS = 500_000


def text_fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles: a bit is set if more than half of the hashes have it."""
    words = (text or "").encode().lower().split()  # on bytes both mean ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    begin, end = start[:n].tolist(), (start + size)[last:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 18):
        part = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin[at : at + (1 << 18)], end[at : at + (1 << 18)])]
        ones += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long.  Null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                fp = np.array([text_fingerprint(t, width) for t in part.column("t").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), "id long, fp long")


@cache
def _masks(bits: int) -> np.ndarray:
    """All 32-bit masks with at most ``bits`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(32), k)], np.uint64)


def _close_pairs(fp: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a small group that link, each only at one of the variants where it meets."""
    a, b = np.triu_indices(len(fp), 1)
    x, y = fp[a], fp[b]
    diff = x ^ y
    near = np.bitwise_count(diff) <= BITS
    x, y, diff = x[near], y[near], diff[near]
    low = diff & np.uint64(0xFFFFFFFF)
    high = diff >> np.uint64(32)
    in_low = np.bitwise_count(low) <= 2
    half = np.where(in_low, low, high)
    own = np.where(in_low, x & np.uint64(0xFFFFFFFF), x >> np.uint64(32))
    lowest = half & (~half + np.uint64(1))
    flip = np.where(np.bitwise_count(half) == 2, lowest, np.uint64(0))
    mine = (own ^ flip) | np.where(in_low, np.uint64(0), np.uint64(1) << np.uint64(32))
    here = mine == np.uint64(key)
    return x[here], y[here]


def _midpoints(fp: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(midpoint, fp) of a group: the other half's ball with the radius that is left."""
    high = bool(key >> 32)
    mid = np.uint64(key & 0xFFFFFFFF)
    own = fp >> np.uint64(32) if high else fp & np.uint64(0xFFFFFFFF)
    other = fp & np.uint64(0xFFFFFFFF) if high else fp >> np.uint64(32)
    at, of = [], []
    for dist in (0, 1):
        rows = np.flatnonzero(np.bitwise_count(own ^ mid) == dist)
        masks = _masks(2 - dist)
        at.append((other[rows, None] ^ masks).ravel())
        of.append(np.repeat(fp[rows], len(masks)))
    at = np.concatenate(at)
    whole = (mid << np.uint64(32)) | at if high else (at << np.uint64(32)) | mid
    return whole, np.concatenate(of)


def _stars(mid: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from everything at a midpoint to the lowest fingerprint there."""
    order = np.lexsort((fp, mid))
    mid, fp = mid[order], fp[order]
    head = np.concatenate(([True], mid[1:] != mid[:-1])) if len(mid) else np.zeros(0, bool)
    low = fp[np.flatnonzero(head)][np.cumsum(head) - 1]
    link = low != fp
    return low[link], fp[link]


def _local_links(fp: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group by its midpoints, a class of midpoints at a time, so that memory is bounded."""
    classes = max(1, -(-len(fp) * len(_masks(2)) // BALL_ROWS))
    xs, ys = [], []
    for c in range(classes):
        mids, fps = [], []
        for at in range(0, len(fp), 1024):
            mid, of = _midpoints(fp[at : at + 1024], key)
            if classes > 1:
                mine = (mid * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(classes) == c
                mid, of = mid[mine], of[mine]
            mids.append(mid)
            fps.append(of)
        x, y = _tree(*_stars(np.concatenate(mids), np.concatenate(fps)))
        xs.append(x)
        ys.append(y)
    return _tree(np.concatenate(xs), np.concatenate(ys))


def _tree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, each fingerprint to the lowest of its component."""
    names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    root = np.arange(len(names))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[root[moved]], names[moved]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(key, fps) of rows that come sorted by key."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        fps = batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cut = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(keys)])).tolist()):
            if keys[a] != key:
                if held:
                    yield key, np.concatenate(held)
                key, held = int(keys[a]), []
            held.append(fps[a:b])
    if held:
        yield key, np.concatenate(held)


def _rows(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["kind", "a", "b"]
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (kind 0) of each variant's group; midpoints (kind 1) of the largest groups."""
    xs, ys, held = [], [], 0
    for key, fp in _groups(batches):
        if len(fp) < 2:
            continue
        if len(fp) <= PAIRWISE:
            x, y = _close_pairs(np.sort(fp), key)
        elif len(fp) <= LOCAL_BALL:
            x, y = _local_links(fp, key)
        else:
            for at in range(0, len(fp), 4096):
                yield _rows(1, *_midpoints(fp[at : at + 4096], key))
            continue
        if len(x):
            xs.append(x)
            ys.append(y)
            held += len(x)
        if held > 1 << 18:
            yield _rows(0, *_tree(np.concatenate(xs), np.concatenate(ys)))
            xs, ys, held = [], [], 0
    if xs:
        yield _rows(0, *_tree(np.concatenate(xs), np.concatenate(ys)))


def _meet_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to the first fingerprint of each midpoint; rows come sorted, nothing is held."""
    key = first = None
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        head = np.concatenate(([keys[0] != key], keys[1:] != keys[:-1]))
        at = np.maximum.accumulate(np.where(head, np.arange(len(keys)), -1))
        low = np.where(at >= 0, fps[at], first if first is not None else 0)
        key, first = keys[-1], low[-1]
        link = low != fps
        yield _rows(0, np.ascontiguousarray(low[link]).view(np.uint64), np.ascontiguousarray(fps[link]).view(np.uint64))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all fingerprints at distance <= 4.

    ``fps`` has one row per distinct fingerprint ``fp``.
    """
    ball = "concat(array({0}), transform(sequence(0, 31), i -> {0} ^ shiftleft(1L, i)))"
    low = F.expr(ball.format("(fp & 4294967295L)"))
    high = F.expr("transform(" + ball.format("shiftrightunsigned(fp, 32)") + ", v -> v | 4294967296L)")
    variants = fps.select(F.explode(F.concat(low, high)).alias("key"), "fp")
    schema = "kind int, a long, b long"
    met = checkpoint(variants.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_meet), schema))
    wide = met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    more = wide.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(_meet_whole), schema)
    return met.where("kind = 0").unionByName(more).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Fingerprint and component of every row of ``docs``: (id_col, fingerprint, component_id).

    ``component_id`` is the smallest id that links reach, over fingerprints that differ in at most
    4 bits.  Rows are kept as they are: repeated rows and repeated ids give a row each.  Null or
    wordless texts have fingerprint zero and link like any other.  A row with a null id belongs to
    the component of its text (null if no id of it is known).  No rows give no rows.  Other
    columns are ignored.
    """
    own = checkpoint(fingerprints(docs, id_col, text_col, width))
    fps = own.groupBy("fp").agg(F.min("id").alias("id"))
    comp = components(links(fps.select("fp")), "a", "b").select(F.col("id").alias("fp"), "comp")
    label = checkpoint(fps.join(comp, "fp"))
    lowest = label.groupBy("comp").agg(F.min("id").alias("component_id"))
    linked = label.join(lowest, "comp").select("fp", "component_id")
    # written, so that the join below shuffles both sides itself and can split a fingerprint with very many copies
    named = checkpoint(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")))
    return own.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row of each near-duplicate component, all columns: a row with the lowest id.

    Of rows that repeat this id one stays.  Rows with a null id go if an id of their component is
    known; of the others, one of each fingerprint stays.
    """
    label = checkpoint(near_duplicates(docs, id_col, text_col, width))
    first = label.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("n"))
    first = checkpoint(first)
    kept = docs.join(first.select(id_col), id_col, "left_semi")
    if not first.where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col])
    lone = label.where("component_id is null").select("fingerprint").distinct()
    if lone.isEmpty():
        return kept
    h, fp = unused(docs, "_h"), unused(docs, "_fp")
    unnamed = docs.where(F.col(id_col).isNull()).withColumn(h, F.coalesce(F.xxhash64(text_col), F.lit(0)))
    prints = fingerprints(unnamed, h, text_col, width).distinct()
    prints = prints.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0"))).join(lone, "fingerprint", "left_semi")
    extra = unnamed.join(prints.select(F.col("id").alias(h), F.col("fp").alias(fp)), h).dropDuplicates([fp]).select(docs.columns)
    return kept.unionByName(extra)
