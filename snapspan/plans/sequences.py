"""Windows that survive a hot key.

A ``Span`` names the keys and the order of a sequence. With ``block`` unset it is one
ordinary window partition per key. With ``block`` set (any column that never decreases
along the order, such as ``floor(frame_id / 4096)``) every operation runs in two levels:
inside (keys, block) in parallel, then over one small edge row per block, and the edge
value is joined back. A key that holds a third of all rows is then spread over as many
tasks as it has blocks, and the result is the same row for row.

Which form is used is the caller's statement about the key, never a count: the frames of one player in
one play are few by nature, the rows of a user or a game are not and get a block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


@dataclass(frozen=True)
class Span:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: str | None = None

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def on(self, *keys: str) -> "Span":
        return replace(self, keys=tuple(keys))


def span(keys, order, block: str | None = None) -> Span:
    order = (order,) if isinstance(order, str) else tuple(order)
    return Span(tuple(keys), order, block)


def _same(left: DataFrame, right: DataFrame, keys) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _attach(df: DataFrame, edges: DataFrame, keys, cols) -> DataFrame:
    renamed = edges.select(*[F.col(k).alias(f"_e_{k}") for k in keys], *cols)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys])
    return df.join(renamed, cond, "left").drop(*[f"_e_{k}" for k in keys])


def _order_key(sp: Span) -> Column:
    return F.struct(*[F.col(c) for c in sp.order])


def shift(df: DataFrame, sp: Span, cols: dict[str, str], step: int) -> DataFrame:
    """``cols`` maps new column to source; step -1 is the previous row, +1 the next."""
    if sp.block is None:
        w = sp.window()
        fn = F.lag if step < 0 else F.lead
        return df.withColumns({new: fn(old, abs(step)).over(w) for new, old in cols.items()})
    if abs(step) > 1:
        pack = F.struct(*[F.col(o).alias(n) for n, o in cols.items()])
        df = around(df, sp, pack, abs(step), "_back", "_fore")
        side, n = ("_back", abs(step)) if step < 0 else ("_fore", abs(step))
        at = F.when(F.size(side) >= n, F.element_at(side, F.lit(-n if step < 0 else n)))
        return df.withColumns({c: at[c] for c in cols}).drop("_back", "_fore")
    pack = F.struct(*[F.col(o).alias(n) for n, o in cols.items()])
    df = df.withColumn(BLOCK, F.expr(sp.block)).withColumn("_pack", pack)
    keys = [*sp.keys, BLOCK]
    pick = F.max_by if step < 0 else F.min_by
    edges = df.groupBy(*keys).agg(pick("_pack", _order_key(sp)).alias("_edge"))
    across = Window.partitionBy(*sp.keys).orderBy(BLOCK)
    fn = F.lag if step < 0 else F.lead
    edges = edges.withColumn("_edge", fn("_edge").over(across))
    inner = Window.partitionBy(*keys).orderBy(*sp.order)
    df = df.withColumn("_in", fn("_pack").over(inner))
    df = _attach(df, edges, keys, ["_edge"])
    near = F.coalesce("_in", "_edge")
    return df.withColumns({n: near[n] for n in cols}).drop(BLOCK, "_pack", "_in", "_edge")


def around(df: DataFrame, sp: Span, value: Column, n: int, back: str, fore: str) -> DataFrame:
    """The up to ``n`` values before and after each row, nearest last and nearest first.

    Across blocks only the ``n`` outermost rows of a block travel, and ``n`` neighbouring blocks
    are enough because every block has a row.
    """
    df = df.withColumn("_w", value)
    keys = [*sp.keys] if sp.block is None else [*sp.keys, BLOCK]
    if sp.block is not None:
        df = df.withColumn(BLOCK, F.expr(sp.block))
    inner = Window.partitionBy(*keys).orderBy(*sp.order)
    df = df.withColumns({back: F.collect_list("_w").over(inner.rowsBetween(-n, -1)), fore: F.collect_list("_w").over(inner.rowsBetween(1, n))})
    if sp.block is None:
        return df.drop("_w")
    across = Window.partitionBy(*sp.keys).orderBy(BLOCK)
    slim = df.select(*keys, *[c for c in sp.order if c not in keys], "_w")

    def rim(order, name: str, frame) -> DataFrame:
        r = slim.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n)
        own = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in sp.order], "_w"))).alias("_own"))
        return own.select(*keys, F.transform(F.flatten(F.collect_list("_own").over(across.rowsBetween(*frame))), lambda e: e["_w"]).alias(name))

    df = _attach(df, rim([F.desc(c) for c in sp.order], "_pre", (-n, -1)), keys, ["_pre"])
    df = _attach(df, rim(list(sp.order), "_post", (1, n)), keys, ["_post"])
    lead, tail = F.concat("_pre", back), F.concat(fore, "_post")
    return df.withColumns({back: F.slice(lead, F.greatest(F.size(lead) - n + 1, F.lit(1)), n), fore: F.slice(tail, 1, n)}).drop("_w", "_pre", "_post", BLOCK)


def running(df: DataFrame, sp: Span, value: Column, out: str, how: str = "sum") -> DataFrame:
    """Sum or maximum of ``value`` from the first row of the key up to and including this one."""
    fold = {"sum": F.sum, "max": F.max}[how]
    df = df.withColumn("_v", value)
    if sp.block is None:
        w = sp.window().rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, fold("_v").over(w)).drop("_v")
    df = df.withColumn(BLOCK, F.expr(sp.block))
    keys = [*sp.keys, BLOCK]
    before = Window.partitionBy(*sp.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*keys).agg(fold("_v").alias("_edge"))
    edges = edges.withColumn("_edge", fold("_edge").over(before))
    inner = Window.partitionBy(*keys).orderBy(*sp.order).rowsBetween(Window.unboundedPreceding, 0)
    df = _attach(df.withColumn("_in", fold("_v").over(inner)), edges, keys, ["_edge"])
    both = F.col("_in") + F.coalesce("_edge", F.lit(0)) if how == "sum" else F.greatest("_in", "_edge")
    return df.withColumn(out, both).drop("_v", "_in", "_edge", BLOCK)


def running_sum(df: DataFrame, sp: Span, value: Column, out: str) -> DataFrame:
    return running(df, sp, value, out, "sum")


def last_known(df: DataFrame, sp: Span, value: Column, out: str, include_self: bool = True) -> DataFrame:
    """The latest non-null ``value`` at or before this row (before it when not include_self)."""
    end = 0 if include_self else -1
    df = df.withColumn("_v", value)
    if sp.block is None:
        w = sp.window().rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(out, F.last("_v", ignorenulls=True).over(w)).drop("_v")
    df = df.withColumn(BLOCK, F.expr(sp.block))
    keys = [*sp.keys, BLOCK]
    before = Window.partitionBy(*sp.keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*keys).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), _order_key(sp))).alias("_edge"))
    edges = edges.withColumn("_edge", F.last("_edge", ignorenulls=True).over(before))
    inner = Window.partitionBy(*keys).orderBy(*sp.order).rowsBetween(Window.unboundedPreceding, end)
    df = _attach(df.withColumn("_in", F.last("_v", ignorenulls=True).over(inner)), edges, keys, ["_edge"])
    return df.withColumn(out, F.coalesce("_in", "_edge")).drop("_v", "_in", "_edge", BLOCK)


def position(df: DataFrame, sp: Span, out: str) -> DataFrame:
    """1-based row number along the sequence."""
    return running_sum(df, sp, F.lit(1), out)


def islands(df: DataFrame, sp: Span, starts: Column, out: str) -> DataFrame:
    """Number the runs of a sequence; ``starts`` is true on the first row of a run."""
    return running_sum(df, sp, F.when(starts, 1).otherwise(0), out)
