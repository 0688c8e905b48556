"""Tolerance and interval joins that stay equi-keyed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], t_left: str, t_right: str,
                    tol: float, carry: list[str], prefix: str = "r_", inclusive: bool = True) -> DataFrame:
    """Each left row with the right row of the same keys nearest in time within ``tol``, or nulls.

    Every left row comes back once, repeated rows too. Equal distances go to the earlier right row. The right side is put on
    buckets one tolerance wide and repeated into the two neighbouring buckets, so the join is
    an equi join on (keys, bucket) and no row meets the whole sequence of its key.
    """
    width = tol if tol > 0 else 1.0
    a = left.withColumn("_b", F.floor(F.col(t_left) / width)).withColumn("_lid", F.monotonically_increasing_id())
    b = right.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(t_right).alias("_t"),
        F.struct(*[F.col(c) for c in carry]).alias("_carry"),
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                              lambda d: F.floor(F.col(t_right) / width) + d)).alias("_rb"))
    gap = F.abs(F.col("_t") - F.col(t_left))
    cond = (F.col("_b") == F.col("_rb")) & ((gap <= tol) if inclusive else (gap < tol))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = a.join(b, cond, "left")
    best = joined.groupBy("_lid", *left.columns).agg(F.min_by("_carry", F.struct(gap, F.col("_t"))).alias("_best"))
    return best.select(*left.columns, *[F.col(f"_best.{c}").alias(f"{prefix}{c}") for c in carry])


def in_interval(rows: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str,
                carry: list[str], width: int, how_first: str) -> DataFrame:
    """Interval lookup closed at both ends, first interval (by ``how_first``) wins; every row comes back once.

    Intervals are laid on buckets ``width`` wide, so the join is equi-keyed on
    (keys, bucket). An interval is repeated once per bucket it covers.
    """
    b = spans.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col(start).alias("_s"), F.col(end).alias("_e"),
        F.struct(F.col(how_first).alias("_first"), *[F.col(c) for c in carry]).alias("_carry"),
        F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_rb"))
    a = rows.withColumn("_b", F.floor(F.col(at) / width)).withColumn("_lid", F.monotonically_increasing_id())
    cond = (F.col("_b") == F.col("_rb")) & F.col(at).between(F.col("_s"), F.col("_e"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    best = a.join(b, cond, "left").groupBy("_lid", *rows.columns).agg(F.min("_carry").alias("_best"))
    return best.select(*rows.columns, *[F.col(f"_best.{c}").alias(c) for c in carry])


def band(value: Column, width: float) -> Column:
    return F.floor(value / width)
