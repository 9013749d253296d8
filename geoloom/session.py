"""Session helpers: reliable checkpoints and partition sizing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
#: Estimates from here on are products of unknown sizes.
UNKNOWN_BYTES = 1 << 60
#: Rows are wider than the compressed files they come from, by about this factor.
WIDER = 8


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Taken from ``spark.checkpoint.dir``; only a local master may fall back to
    a temporary folder, because executors on other machines could not read it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts the lineage as ``checkpoint`` does, and the planner knows the size of the result.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` written as by ``stored``, in a bucket per shuffle partition by ``keys``.

    Joins and aggregates on these keys read it without a shuffle, so rounds that join it again and again move
    only what meets it.  The table's name is dropped at once; its files stay in the shared folder.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys)
    out.option("path", f"{checkpoint_root(spark)}/{table}").saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def range_partitions(df: DataFrame) -> int:
    """Partition count for an explicit range shuffle of ``df``, by bytes alone.

    128 MB each by the planner's size estimate, and at least one per core.  The planner takes a join for a
    product, so the estimate is held against the tables that are read.  Where it has none (it then
    assumes far more than any cluster holds), the session's shuffle partitions.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = min(planned_bytes(df), WIDER * read_bytes(df))
    if size >= UNKNOWN_BYTES:
        return max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(cores, size // TARGET_BYTES + 1)


def planned_bytes(df: DataFrame) -> int:
    """The planner's size estimate of a DataFrame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_bytes(df: DataFrame) -> int:
    """The planner's sizes of all tables that a DataFrame reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input out to all cores before it is blown up into many rows.

    An input below 128 MB per core has fewer file splits than cores and would run in a
    few tasks; larger inputs bring enough splits and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if planned_bytes(df) < cores * TARGET_BYTES else df


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as constants.

    Constants keep the plan free of joins without a key and can reach the scan.
    """
    row = one_row.first()
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema])
