"""Rules that feed on their own output, as scans over blocks inside the JVM.

A rule with finitely many states per block (who is held, and a small counter) is a function from entry to exit state. ``automaton`` works
that function out for every block by itself, composes the functions along the sequence, and replays each block from its entry state; a sequence of any
length is spread over as many tasks as it has blocks. ``chained`` is for a continuous state whose functions do not compose in closed form: the narrow
rows of a sequence are folded once for the states between blocks, and blocks are then replayed side by side.

No row goes through Python. Rows of one block are an array, so a block should be some tens to hundreds of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a name that a block does not mention.
OTHER = -(1 << 62)


def _blocks(df: DataFrame, keys: list[str], order: str, size: int, row: list[str]) -> DataFrame:
    block = F.floor(F.col(order) / size).cast("bigint")
    return df.groupBy(*keys, block.alias("_block")).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in row if c != order]))).alias("_rows"))


def _replayed(blocks: DataFrame, keys: list[str], order: str, step: Callable[[Column, Column], Column], out: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """One row a row of each block, with what ``out`` makes of the state after it; ``_entry`` is the state before the block."""
    shown = lambda r, s: F.struct(r[order].alias(order), *[c.alias(n) for n, c in out(s).items()])
    kind = blocks.select(F.transform("_rows", lambda r: shown(r, step(F.col("_entry"), r))).alias("k")).schema["k"].dataType.simpleString()

    def add(a: Column, r: Column) -> Column:
        s = step(a["s"], r)
        return F.struct(s.alias("s"), F.concat(a["o"], F.array(shown(r, s))).alias("o"))

    start = F.struct(F.col("_entry").alias("s"), F.array().cast(kind).alias("o"))
    done = blocks.select(*keys, F.inline(F.aggregate("_rows", start, add, lambda a: a["o"])))
    return done


def automaton(df: DataFrame, keys: list[str], order: str, row: list[str], names: Callable[[Column], Column], levels: int,
              start: tuple[int, int], step: Callable[[Column, Column], Column], size: int = 64) -> DataFrame:
    """(keys, order, who, n): the state after each row.

    A state is struct(who bigint, n int) with n below ``levels``. ``names`` gives the array of all ``who`` that the rows of a block mention; ``step(state, row)`` may compare ``who``
    with those only, so all others behave alike and one stand-in answers for them.
    """
    state = lambda w, n: F.struct(w.cast("bigint").alias("who"), n.cast("int").alias("n"))
    blocks = _blocks(df, keys, order, size, row)
    known = F.array_distinct(F.concat(F.coalesce(names(F.col("_rows")), F.array().cast("array<bigint>")), F.array(F.lit(start[0]).cast("bigint"), F.lit(OTHER))))
    entries = F.flatten(F.transform(known, lambda w: F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda n: state(w, n))))
    ways = F.transform(entries, lambda e: F.struct(e.alias("e"), F.aggregate(F.col("_rows"), e, step).alias("x")))

    def through(ways: Column, s: Column) -> Column:
        """The exit state of a block for an entry state."""
        met = F.exists(ways, lambda w: w["e"]["who"] == s["who"])
        at = state(F.when(met, s["who"]).otherwise(F.lit(OTHER)), s["n"])
        x = F.element_at(F.filter(ways, lambda w: w["e"] == at), 1)["x"]
        return state(F.when(x["who"] == OTHER, s["who"]).otherwise(x["who"]), x["n"])

    first = state(F.lit(start[0]), F.lit(start[1]))
    chain = blocks.select(*keys, "_block", ways.alias("_ways")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_ways"))).alias("_chain"))
    kind = "array<struct<_block:bigint,_entry:struct<who:bigint,n:int>>>"
    begun = F.struct(first.alias("s"), F.array().cast(kind).alias("o"))
    passed = F.aggregate("_chain", begun, lambda a, b: F.struct(
        through(b["_ways"], a["s"]).alias("s"), F.concat(a["o"], F.array(F.struct(b["_block"].alias("_block"), a["s"].alias("_entry")))).alias("o")), lambda a: a["o"])
    entry = chain.select(*keys, F.inline(passed))
    return _replayed(blocks.join(entry, [*keys, "_block"]), keys, order, step, lambda s: {"who": s["who"], "n": s["n"]})


def chained(df: DataFrame, keys: list[str], order: str, row: list[str], start: Column, step: Callable[[Column, Column], Column],
            out: Callable[[Column], dict[str, Column]], size: int = 256) -> DataFrame:
    """(keys, order, and what ``out`` makes of the state) after each row, for a state of any kind."""
    blocks = _blocks(df, keys, order, size, row)
    chain = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_rows"))).alias("_chain"))
    kind = chain.select(F.array(F.struct(F.lit(0).cast("bigint").alias("_block"), start.alias("_entry"))).alias("k")).schema["k"].dataType.simpleString()
    begun = F.struct(start.alias("s"), F.array().cast(kind).alias("o"))
    passed = F.aggregate("_chain", begun, lambda a, b: F.struct(
        F.aggregate(b["_rows"], a["s"], step).alias("s"), F.concat(a["o"], F.array(F.struct(b["_block"].alias("_block"), a["s"].alias("_entry")))).alias("o")), lambda a: a["o"])
    entry = chain.select(*keys, F.inline(passed))
    return _replayed(blocks.join(entry, [*keys, "_block"]), keys, order, step, out)
