"""Greedy choices in order of preference, in rounds over a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.plans.session import cut_lineage


def refused(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """(node): what a greedy pass in order of preference refuses.

    A row says that ``before`` goes first and, if it is taken, rules ``after`` out. A node is taken when nothing taken rules it out; nodes in no row are. In each
    round whatever waits for nobody is taken, what it rules out is refused, and both leave the table. The rounds are as many as the longest chain of such decisions; the table of a
    round is written, and only whether it is empty comes to the driver. The order must not be circular.
    """
    open_ = cut_lineage(pairs.select(F.col(before).alias("a"), F.col(after).alias("b")).distinct())
    lost = open_.select(F.col("b").alias("node")).limit(0)
    while not open_.isEmpty():
        taken = open_.select("a").join(open_.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        out = cut_lineage(open_.join(taken, "a", "left_semi").select(F.col("b").alias("node")).distinct())
        lost = lost.unionByName(out)
        rest = open_.join(taken, "a", "left_anti")
        rest = rest.join(out.select(F.col("node").alias("a")), "a", "left_anti").join(out.select(F.col("node").alias("b")), "b", "left_anti")
        open_ = cut_lineage(rest)
    return lost
