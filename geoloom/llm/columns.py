"""Names for helper columns, and samples of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lowest_hashes(df: DataFrame, key: str, ties: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df``, picked by a hash of ``key``, the same ones however it is split.

    Rows that are not among about twice as many lowest hashes go where they are read, so what the tasks
    send does not grow with their number.
    """
    share = min(1.0, 2 * rows / max(1, df.count()))
    if share < 1:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int(share * (1 << 31)))
    return df.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 31)), key, *ties).limit(rows)
