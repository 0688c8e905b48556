"""Exact global ranks without a single-task window.

The rank of a row over the whole table is (rows in lower buckets) + (rank inside its
bucket). Buckets come from approximate quantiles of the order column, so they only decide
how the work is split; the ranks are exact whatever the boundaries are. Equal values land
in one bucket, so a value shared by many rows is split further by its tie-break column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapspan.plans.session import cut_lineage


def _bucket(value: Column, cuts: list) -> Column:
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.lit(c) for c in cuts])
    return F.coalesce(F.aggregate(edges, F.lit(0), lambda n, c: n + F.when(value >= c, 1).otherwise(0)), F.lit(-1))


def global_rank(df: DataFrame, value: str, tie: str, out: str = "rank", total: str | None = None,
                parts: int = 64) -> DataFrame:
    """1-based rank of every row by (value, tie), both numeric, nulls first.

    The rows are read three times, so the narrow input is written once first.
    """
    df = cut_lineage(df)
    probs = [i / parts for i in range(1, parts)]
    cut = df.agg(F.percentile_approx(value, F.array(*[F.lit(p) for p in probs]), 1000).alias("v"),
                 F.percentile_approx(tie, F.array(*[F.lit(p) for p in probs]), 1000).alias("t")).first()
    vcuts = sorted(set(cut["v"] or []))
    tcuts = sorted(set(cut["t"] or []))
    marked = df.withColumn("_vb", _bucket(F.col(value), vcuts))
    # Where a cut value repeats it may be one hot value: the tie column splits that bucket again,
    # but only rows equal to the cut, which sort before the rest of the bucket.
    on_cut = F.col(value).isin(*vcuts) if vcuts else F.lit(False)
    marked = marked.withColumn("_hot", F.when(on_cut, 0).otherwise(1))
    marked = marked.withColumn("_tb", F.when(on_cut, _bucket(F.col(tie), tcuts)).otherwise(F.lit(0)))
    keys = ["_vb", "_hot", "_tb"]
    sizes = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Bucket rows are bounded by 2 * parts * parts whatever the table holds.
    order = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    sizes = sizes.withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    small = F.broadcast(sizes.drop("_n"))
    inner = Window.partitionBy(*keys).orderBy(value, tie)
    ranked = marked.join(small, keys).withColumn(out, F.row_number().over(inner) + F.col("_before"))
    if total is not None:
        ranked = ranked.withColumn(total, F.col("_all"))
    return ranked.drop("_vb", "_hot", "_tb", "_before", "_all")


def ntile(rank: Column, total: Column, tiles: int) -> Column:
    """The tile of a 1-based rank: the first (total % tiles) tiles hold one row more."""
    small = F.floor(total / tiles)
    big = total - small * tiles
    edge = big * (small + 1)
    return (F.when(rank <= edge, F.floor((rank - 1) / (small + 1)) + 1)
            .otherwise(big + F.floor((rank - 1 - edge) / F.greatest(small, F.lit(1))) + 1)).cast("int")
