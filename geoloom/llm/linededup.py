"""Lines that stand in several documents, kept in one of them only.

An index of line hashes is a set of sorted runs in levels.  A run holds, for each line hash, the
greatest ids of documents with that line, as many as make a line repeated.  A batch of documents is
first reduced to such entries, then joined with the runs by merging: entries that the runs already
settle (enough greater ids are known) leave it, the rest is written as a run of level 0.  When a
level has ``FANOUT`` runs they are merged into one of the next.  Entries of one line merge in any
order and any number of times with the same result, so a batch that is added again after a failure
changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.arrow_text import slices, tidy
from geoloom.session import checkpoint_root, planned_bytes, stored

WHITE = b" \t\n\x0b\x0c\r"
#: Code points of a line's key, and documents with it, from which on it counts as repeated.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches that a table is read in, and runs of a level that are merged into one.
BATCHES, FANOUT = 6, 3
#: Entries that a bucket of a run should hold, in bytes.
BUCKET_BYTES = 64 << 20
#: A line hash with a greater share of all (document, line) pairs than one in so many is a hot one.
HOT = 2048
#: Stands for a null id: a document below all others.
NO_ID = -(1 << 63)


def line_hash(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """Hash of a line's key, or None if the key is short.

    The key is the line without white space at both ends, A-Z in lower case.
    """
    key = line.strip(WHITE)
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(key.lower())  # of bytes, this changes A-Z alone


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(h, did, tid): the different line hashes of every row; ``tid`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                found, row = [], []
                for k, text in enumerate(part.column("t").to_pylist()):
                    own = {line_hash(line, least) for line in text.encode().split(b"\n")}
                    own.discard(None)
                    found += own
                    row += [k] * len(own)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column("did").take(at), part.column("tid").take(at)], ["h", "did", "tid"])

    rows = _named(docs, id_col, text_col).where(F.length("t") >= least)
    return rows.mapInArrow(tidy(run), "h binary, did long, tid long")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(did.alias("did"), F.xxhash64(F.col(text_col)).alias("tid"), F.col(text_col).alias("t"))


class LineRuns:
    """Runs of (h, ids): the greatest different ids, at most ``docs``, of documents with a line."""

    def __init__(self, spark: SparkSession, buckets: int, docs: int = LEAST_DOCS, fanout: int = FANOUT):
        self.spark, self.buckets, self.docs, self.fanout = spark, buckets, docs, fanout
        self.levels: list[list[str]] = [[]]
        self.root = f"{checkpoint_root(spark)}/lines-{uuid.uuid4().hex}"

    def entries(self, pairs: DataFrame) -> DataFrame:
        """(h, ids) of (h, did) rows.

        Pairs are made different first, which spreads a frequent line by its documents, and each task
        sends only the greatest ids of a line on.
        """
        top = Window.partitionBy("h").orderBy(F.desc("did"))
        best = pairs.select("h", "did").distinct().withColumn("place", F.row_number().over(top)).where(F.col("place") <= self.docs)
        return best.groupBy("h").agg(F.sort_array(F.collect_list("did"), asc=False).alias("ids"))

    def _written(self, entries: DataFrame) -> str:
        """A run of ``entries``: a table in buckets of hashes, each sorted."""
        name = f"lines_{uuid.uuid4().hex}"
        entries.repartition(self.buckets, "h").sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.path(name)).saveAsTable(name)
        return name

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def new(self, entries: DataFrame) -> DataFrame:
        """Entries that no run settles."""
        for name in self.runs():
            run = self.spark.table(name).select(F.col("h").alias("rh"), F.col("ids").alias("rids"))
            settled = (F.size("rids") >= self.docs) & (F.col("rids")[0] >= F.col("ids")[0])
            entries = entries.join(run.hint("merge"), (F.col("h") == F.col("rh")) & settled, "left_anti")
        return entries

    def add(self, pairs: DataFrame) -> None:
        """Add the (h, did) rows of a batch of documents."""
        self.levels[0].append(self._written(self.new(self.entries(pairs))))
        for level in range(len(self.levels)):
            if len(self.levels[level]) < self.fanout:
                break
            merged = self._written(self._merged(self.levels[level]))
            for name in self.levels[level]:
                self.spark.sql(f"DROP TABLE {name}")  # its files stay until the folder is cleared
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)

    def _merged(self, names: list[str]) -> DataFrame:
        """Entries of several runs as one; a line has at most one entry in each.

        Their files are read without regard to buckets: in Spark 4.1 a union of tables in buckets counts as
        dealt by them, but is not read bucket by bucket, so groups would come out in parts.
        """
        table = self.spark.read.schema("h binary, ids array<bigint>").parquet(*[self.path(name) for name in names])
        ids = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids"))), asc=False), 1, self.docs)
        return table.groupBy("h").agg(ids.alias("ids"))

    def repeated(self) -> DataFrame:
        """(h, holder): lines of enough documents, and the greatest id among these."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "h binary, holder long")
        return self._merged(names).where(F.size("ids") >= self.docs).select("h", F.col("ids")[0].alias("holder"))

    def close(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = [[]]


def _batches(pairs: DataFrame, count: int) -> list[DataFrame]:
    """``pairs`` by ranges of ids, the greatest ids first, so that later batches are mostly settled."""
    shares = [k / count for k in range(1, count)]
    edges = pairs.agg(F.percentile_approx("did", shares, 1000).alias("e")).first().e if shares else []
    cuts = sorted(set(edges or []), reverse=True)
    upper, out = None, []
    for cut in [*cuts, None]:
        batch = pairs if cut is None else pairs.where(F.col("did") > cut)
        out.append(batch if upper is None else batch.where(F.col("did") <= upper))
        upper = cut
    return out


def _dropped(pairs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(did, tid, gone): hashes that the row loses.

    A line that makes up more than one in ``HOT`` of all pairs is looked up in a table of less than
    ``HOT`` rows in every task; the others meet their holder by hash.
    """
    many = pairs.count() // HOT
    hot = pairs.groupBy("h").count().where(F.col("count") > many).select("h")
    hot = stored(hot.join(repeated, "h"), "hot-lines")
    cold = pairs.join(F.broadcast(hot.select("h")), "h", "left_anti").join(repeated, "h")
    lost = pairs.join(F.broadcast(hot), "h").unionByName(cold).where(F.col("did") < F.col("holder"))
    return lost.groupBy("did", "tid").agg(F.collect_set("h").alias("gone"))


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES
) -> DataFrame:
    """Texts without lines that at least ``least_docs`` documents hold, but for the one with the greatest id.

    Returns id_col, n_lines (before), n_dropped, kept_sha256 and kept (the text).  A text is split at
    newlines; a null or empty one is one empty line.  Lines are the same if they are so without white
    space at both ends and with A-Z in lower case; those of less than ``least_chars`` code points stay.
    A document is an id: rows that repeat an id are one document, null ids are one below all others.
    The holder keeps all its lines, repeats within it included.  Other columns are ignored; no rows give
    no rows.
    """
    spark = docs.sparkSession
    pairs = stored(lines(docs, id_col, text_col, least_chars), "line-pairs")
    buckets = max(1, min(planned_bytes(pairs) // BUCKET_BYTES + spark.sparkContext.defaultParallelism, 100_000))
    index = LineRuns(spark, buckets, least_docs)
    for batch in _batches(pairs, batches):
        index.add(batch)
    repeated = stored(index.repeated(), "repeated-lines")
    index.close()
    gone = _dropped(pairs, repeated)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    named = named.select("*", F.coalesce("id", F.lit(NO_ID)).alias("did"), F.xxhash64("t").alias("tid"))
    rows = named.join(gone, ["did", "tid"], "left").select("id", "t", "gone")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in slices(batch, "t"):
                out = []
                for text, lost in zip(part.column("t").to_pylist(), part.column("gone").to_pylist()):
                    own = (text or "").split("\n")
                    kept = own
                    if lost:
                        lost = set(lost)
                        kept = [x for x in own if line_hash(x.encode(), least_chars) not in lost]
                    whole = "\n".join(kept)
                    out.append((len(own), len(own) - len(kept), hashlib.sha256(whole.encode()).hexdigest(), whole))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    schema = "id long, n_lines long, n_dropped long, kept_sha256 string, kept string"
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
