"""Where queries and their oracle statements are kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapspan.catalog import fixture
from snapspan.functions.geometry import face_right
from snapspan.functions.angles import wrap_deg
from snapspan.plans.sequences import Span, span
from snapspan.plans.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return fixture.tables(self.spark, self.sf_dir, name)

    @cached_property
    def trk(self) -> DataFrame:
        return fixture.tracking(self.spark, self.sf_dir)

    @cached_property
    def plays(self) -> DataFrame:
        return fixture.plays(self.spark, self.sf_dir)

    @cached_property
    def norm(self) -> DataFrame:
        return face_right(self.trk)

    @cached_property
    def men(self) -> DataFrame:
        """Players only, with contract angles ``cdir`` and ``co``."""
        return self.norm.filter(F.col("nfl_id").isNotNull()).withColumns({
            "cdir": wrap_deg(90.0 - F.col("dir")),
            "co": wrap_deg(90.0 - F.coalesce("o", "dir"))})

    @cached_property
    def ball(self) -> DataFrame:
        return self.norm.filter(F.col("nfl_id").isNull()).select(
            "game_id", "play_id", "frame_id", "t", "x", "y", "s")

    @cached_property
    def win(self) -> DataFrame:
        from snapspan.operators.events import pass_windows
        return pass_windows(self.trk)

    def player_span(self) -> Span:
        """A player's frames of one play: few by nature."""
        return span(["game_id", "play_id", "nfl_id"], "frame_id")

    def play_span(self) -> Span:
        """The frames of one play: few by nature."""
        return span(["game_id", "play_id"], "frame_id")

    def game_span(self) -> Span:
        """The plays of a game, in blocks."""
        return span(["game_id"], "play_id", "floor(play_id / 64)")


def query(name: str, sql: str | None = None, *bases: str):
    """Register ``fn(tables) -> DataFrame`` with the DuckDB statement that must agree."""

    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settle(spark)
            return fn(Tables(spark, sf_dir))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fixture.oracle(sql, *bases)
        return fn
    return keep


def r6(name, *cols):
    """Round the named columns to 6 digits, for comparison across engines."""
    return [F.round(c, 6).alias(c) if c in cols else F.col(c) for c in name]
