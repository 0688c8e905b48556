"""Lookups over a library of plays: summaries, links between versions, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.plans.sequences import Span, islands, last_known, running, shift
from snapspan.schema import PLAY


def play_key(df: DataFrame) -> DataFrame:
    return df.withColumn("play_key", F.concat_ws("_", "game_id", "play_id"))


def point_lookup(df: DataFrame, asked: str) -> DataFrame:
    """One play by its key, with or without a file suffix. The keys reach the scan as filters."""
    game, _, play = asked.removesuffix(".json").partition("_")
    return df.filter((F.col("game_id") == int(game)) & (F.col("play_id") == int(play)))


def compare_versions(real: DataFrame, suggested: DataFrame, simulated: DataFrame, reports: DataFrame) -> DataFrame:
    """Real, suggested and simulated version and the report of a play in one row.

    Each input has the play keys and one value column. A play only known by its simulation or
    report is left out.
    """
    j = real.join(suggested, PLAY, "full_outer").join(simulated, PLAY, "left").join(reports, PLAY, "left")
    names = {"has_current": real, "has_suggested": suggested, "has_optimal": simulated, "has_report": reports}
    for flag, df in names.items():
        value = next(c for c in df.columns if c not in PLAY)
        j = j.withColumn(flag, F.col(value).isNotNull())
    return j


def latest_simulation(plays: DataFrame) -> DataFrame:
    """source play -> its last simulation in path order."""
    sim = plays.filter(F.col("simulated") & F.col("simulated_from").isNotNull())
    return sim.groupBy("game_id", F.col("simulated_from").alias("play_id")).agg(F.max_by(F.col("play_id"), "path").alias("simulation_id"))


def link_simulations(plays: DataFrame) -> DataFrame:
    return plays.filter(~F.col("simulated")).join(latest_simulation(plays), PLAY, "left")


def simulation_ids(sources: DataFrame, taken: DataFrame, existing: DataFrame, block: str | None = None) -> DataFrame:
    """Id of each simulation: the one it already has, else the next free id after its source.

    Sources of a game are served lowest first and each takes the smallest id still free. With
    free ids numbered in order, source i gets number i + max over j <= i of (free ids up to
    source j + 1 - j), which is a running maximum; numbers turn back into ids by the count of
    taken ids before the gap they fall in. ``block`` splits games too large for one task.
    """
    ids = Span(("game_id",), ("id",), block and block.format("id"))
    t = taken.select("game_id", F.col("play_id").alias("id")).distinct()
    t = running(t, ids, F.lit(1), "upto")
    t = shift(t, ids, {"next_id": "id"}, 1)
    known = sources.join(existing.select(*PLAY, "simulation_id"), PLAY, "left")
    new = known.filter(F.col("simulation_id").isNull()).select(*PLAY)
    new = new.join(t.select("game_id", F.col("id").alias("play_id"), "upto"), PLAY)
    plays = Span(("game_id",), ("play_id",), block and block.format("play_id"))
    new = running(new, plays, F.lit(1), "i")
    new = running(new, plays, F.col("play_id") - F.col("upto") + 1 - F.col("i"), "lead", "max")
    asked = new.select("game_id", "play_id", (F.col("i") + F.col("lead")).alias("number"), F.lit(None).cast("bigint").alias("gap_upto"), F.lit(1).alias("what"))
    open_gap = F.col("next_id").isNull() | (F.col("next_id") > F.col("id") + 1)
    gaps = t.filter(open_gap).select("game_id", F.lit(None).cast("bigint").alias("play_id"), (F.col("id") + 1 - F.col("upto")).alias("number"),
                                     F.col("upto").cast("bigint").alias("gap_upto"), F.lit(0).alias("what"))
    both = asked.unionByName(gaps)
    both = last_known(both, Span(("game_id",), ("number", "what"), block and block.format("number")), F.col("gap_upto"), "before")
    fresh = both.filter("what = 1").select("game_id", "play_id", (F.col("number") + F.col("before")).alias("simulation_id"))
    return known.filter(F.col("simulation_id").isNotNull()).select(*PLAY, "simulation_id").unionByName(fresh)


def game_summaries(plays: DataFrame, reports: DataFrame) -> DataFrame:
    """Plays and reports per game."""
    p = plays.groupBy("game_id").agg(F.count(F.lit(1)).alias("plays"), F.count_if("simulated").alias("simulated"))
    r = reports.groupBy("game_id").agg(F.count(F.lit(1)).alias("reports"))
    return p.join(r, "game_id", "left").withColumn("reports", F.coalesce("reports", F.lit(0)))


def health(plays: DataFrame, reports: DataFrame) -> DataFrame:
    """Games, plays and reports in one row."""
    p = plays.groupBy("game_id").agg(F.count(F.lit(1)).alias("plays")).withColumns({"games": F.lit(1), "reports": F.lit(0)})
    r = reports.agg(F.count(F.lit(1)).alias("reports")).withColumns({"games": F.lit(0), "plays": F.lit(0)})
    both = p.select("games", "plays", "reports").unionByName(r)
    return both.agg(*[F.sum(c).alias(c) for c in ("games", "plays", "reports")])


def majority_game(rows: DataFrame) -> DataFrame:
    """The game most rows belong to; lowest id on a tie."""
    g = rows.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "game_id").limit(1).select("game_id")


def hierarchy(plays: DataFrame, sp: Span) -> DataFrame:
    """Contiguous quarter and drive groups of a game with counts and first and last clock."""
    p = shift(plays.withColumn("_one", F.lit(1)), sp, {"_q": "quarter", "_d": "drive", "_had": "_one"}, -1)
    new = F.col("_had").isNull() | ~F.col("quarter").eqNullSafe(F.col("_q")) | ~F.col("drive").eqNullSafe(F.col("_d"))
    p = islands(p, sp, new, "grp")
    at = F.struct(*sp.order)
    return p.groupBy(*sp.keys, "grp", "quarter", "drive").agg(
        F.count(F.lit(1)).alias("plays"), F.min("play_id").alias("first_play"), F.min_by("clock", at).alias("first_clock"), F.max_by("clock", at).alias("last_clock"))


def quarter_rollup(groups: DataFrame) -> DataFrame:
    """Plays and drives per game and quarter, with game totals (quarter null)."""
    per = groups.groupBy("game_id", "quarter", "drive").agg(F.sum("plays").alias("plays"))
    return per.rollup("game_id", "quarter").agg(F.sum("plays").alias("plays"), F.count(F.lit(1)).alias("drives")).filter("game_id IS NOT NULL")


def play_context(plays: DataFrame, columns: list[str]) -> DataFrame:
    """Situation of a play as JSON; fields that are null are left out."""
    return plays.select(*PLAY, F.to_json(F.struct(*columns)).alias("context"))


def incomplete_forecasts(steps: DataFrame, pid: str = "nfl_id") -> DataFrame:
    """Players whose forecast steps are not exactly 1..n."""
    s = steps.select(*PLAY, pid, "step").distinct().groupBy(*PLAY, pid).agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("last"), F.min("step").alias("first"))
    return s.filter((F.col("n") != F.col("last")) | (F.col("first") != 1))


def worst(rows: DataFrame, measure: str, ties: list[str], n: int) -> DataFrame:
    return rows.orderBy(measure, *ties).limit(n)
