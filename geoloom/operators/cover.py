"""Greedy set cover in few distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.ordering import row_numbers
from geoloom.session import checkpoint


def greedy_cover(pairs: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """Sets in greedy pick order: (pick, set, gain); ties go to the lowest set id.

    A set that beats every set it shares an open item with keeps its gain until the greedy
    method takes it, so all such sets can be taken in one round.  Gains never grow, hence
    the greedy order is (gain descending, set ascending) over all rounds.
    """
    open_ = checkpoint(pairs.select(F.col(set_col).alias("s"), F.col(item_col).alias("i")).dropna().distinct())
    taken: DataFrame | None = None
    while not open_.isEmpty():
        gain = open_.groupBy("s").agg(F.count("*").alias("gain"))
        top = open_.join(gain, "s").groupBy("i").agg(F.max(F.struct("gain", (-F.col("s")).alias("neg"))).alias("b"))
        best = checkpoint(top.select("i", (-F.col("b.neg")).alias("s"), F.col("b.gain").alias("gain")))
        won = best.groupBy("s", "gain").agg(F.count("*").alias("won"))
        pick = checkpoint(won.where("won = gain").select("s", "gain"))
        taken = pick if taken is None else taken.unionByName(pick)
        # a picked set is the best one of all its open items, so they are found without the pairs
        covered = best.join(pick.select("s"), "s", "left_semi").select("i")
        open_ = checkpoint(open_.join(covered, "i", "left_anti"))
    if taken is None:
        return open_.select(F.lit(0).cast("bigint").alias("pick"), F.col("s").alias(set_col), F.lit(0).cast("bigint").alias("gain"))
    return row_numbers(taken, [F.desc("gain"), "s"], "pick").select("pick", F.col("s").alias(set_col), "gain")
