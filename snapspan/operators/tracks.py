"""Whole-call compositions: release rows to a track, and a play to its review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.functions.angles import wrap_deg
from snapspan.functions.coding import facing
from snapspan.functions.geometry import face_right, unmirror
from snapspan.operators import events as ev, review as rv
from snapspan.operators.roster import roster_of
from snapspan.operators.timeseries import acceleration, facing_from_motion, held_direction, kinematics, resting_angle
from snapspan.plans.sequences import Span
from snapspan.plans.session import cut_lineage
from snapspan.schema import ARRIVAL_PRIORITY, CONTRACT_WIDTH, FRAME, PLAY, RATE, THROW_NAMES, ReviewRules


def release_to_track(rows: DataFrame, sp: Span, directions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Release rows (stadium coordinates, compass angles, null id for the ball) as the tables of a track.

    ``directions`` (play, direction) overrides the column and is recorded as such. What a play lacks is said and not
    invented: without body angles the travel angle stands in (``from_dir``), without accelerations they
    are differenced from speed. Clocks start at the snap, or the first frame where there is none. ``problems`` lists
    plays without player rows or without a known direction; they have no other rows.
    """
    if directions is not None:
        told = directions.select(*PLAY, F.col("direction").alias("_told"))
        rows = rows.join(told, PLAY, "left").withColumn("play_direction", F.coalesce("_told", "play_direction"))
    else:
        rows = rows.withColumn("_told", F.lit(None).cast("string"))
    player = F.col("nfl_id").isNotNull()
    side = F.lower("play_direction")
    facts = rows.groupBy(*PLAY).agg(
        F.count_if(player).alias("_men"), F.max(F.when(side.isin("left", "right"), side)).alias("play_direction"), F.max("_told").alias("_told"),
        F.coalesce(F.max(player & F.col("o").isNotNull()), F.lit(False)).alias("orientation_measured"),
        F.coalesce(F.max(player & F.col("a").isNotNull()), F.lit(False)).alias("acceleration_measured"),
        F.coalesce(F.min(F.when(F.col("event").isin("ball_snap", "autoevent_ballsnap", "snap_direct"), F.col("frame_id"))), F.min("frame_id")).alias("snap"))
    facts = facts.withColumn("problem", F.when(F.col("_men") == 0, "no player rows").when(F.col("play_direction").isNull(), "no play direction"))
    good = facts.filter(F.col("problem").isNull())
    meta = good.select(*PLAY, F.lit("release").alias("source"), F.lit(RATE).alias("rate"), "play_direction", (F.col("play_direction") == "left").alias("mirrored"),
                       F.when(F.col("_told").isNotNull(), "caller").otherwise("column").alias("play_direction_source"), "orientation_measured", "acceleration_measured", "snap")
    known = rows.drop("play_direction", "_told").join(good.select(*PLAY, "play_direction", "orientation_measured", "acceleration_measured", "snap"), PLAY)
    turned = face_right(known).withColumn("t", F.round((F.col("frame_id") - F.col("snap")) / RATE, 3))
    men = turned.filter(player).withColumn("s", F.coalesce("s", F.lit(0.0)))
    angle, source = facing(F.col("o"), F.col("dir"))
    men = acceleration(men, sp).withColumns({
        "a": F.when(F.col("acceleration_measured"), F.coalesce("a", F.lit(0.0))).otherwise(F.col("accel")),
        "o": wrap_deg(90.0 - angle), "o_source": source, "dir": F.coalesce(wrap_deg(90.0 - F.col("dir")), F.lit(0.0))})
    people = roster_of(rows.filter(player).join(good.select(*PLAY), PLAY, "left_semi"))
    return {"samples": men.select(*FRAME, "nfl_id", "t", "x", "y", "s", "a", "dir", "o", "o_source"),
            "ball": turned.filter(~player).select(*FRAME, "t", "x", "y"), "roster": people, "events": ev.frame_events(known),
            "meta": meta, "problems": facts.filter(F.col("problem").isNotNull()).select(*PLAY, "problem")}


MEASURED, FORECAST = "measured", "forecast"


def forecast_to_track(predicted: DataFrame, track: dict[str, DataFrame], cuts: DataFrame | None = None, model: str = "forecast", width: float = CONTRACT_WIDTH) -> dict[str, DataFrame]:
    """Forecast rows and the plays they continue, as the tables of simulated tracks.

    ``predicted`` has (play, nfl_id, step, x, y) in the release's own frame of reference; ``track`` is what :func:`release_to_track` gave for the plays. Rows are turned with the source play, their
    clock goes on from ``cuts`` (play, t0), or the last sample of the play where there is none. Speed, acceleration and direction are differenced from the path; facing follows the travel and is never
    called measured. A player unknown to the source has team ``?`` and is listed in ``meta``. Plays without a source, and those whose steps are not 1 to N, have a ``problem`` and no rows. Each sample
    has ``lineage``: what it is, by which model, and since when.
    """
    p = predicted.select(*PLAY, "nfl_id", F.col("step").cast("int").alias("tick"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    source = track["meta"].select(*PLAY, "play_direction", "mirrored", F.col("source").alias("simulated_from"))
    steps = p.groupBy(*PLAY).agg(F.count_distinct("tick").alias("_n"), F.min("tick").alias("_low"), F.max("tick").alias("_high")).join(source, PLAY, "left")
    steps = steps.withColumn("problem", F.when(F.col("mirrored").isNull(), "no source play").when((F.col("_low") != 1) | (F.col("_high") != F.col("_n")), "steps are not 1 to N"))
    last = track["samples"].groupBy(*PLAY).agg(F.max("t").alias("_end"))
    good = steps.filter("problem is null").join(last, PLAY, "left")
    if cuts is not None:
        good = good.join(cuts.select(*PLAY, "t0"), PLAY, "left").withColumn("t0", F.coalesce("t0", "_end", F.lit(0.0)))
    else:
        good = good.withColumn("t0", F.coalesce("_end", F.lit(0.0)))
    good = cut_lineage(good.select(*PLAY, "play_direction", "mirrored", "simulated_from", "t0", F.col("_n").alias("steps")))
    x, y = unmirror(F.col("x"), F.col("y"), F.col("mirrored"), width)
    rows = p.join(good, PLAY).select(*PLAY, "nfl_id", "tick", F.round(F.col("t0") + F.col("tick") / RATE, 3).alias("t"), x.alias("x"), y.alias("y"), "t0")
    people = rows.select(*PLAY, "nfl_id").distinct().join(track["roster"], [*PLAY, "nfl_id"], "left").withColumn("known", F.col("club").isNotNull())
    people = cut_lineage(people.withColumn("club", F.coalesce("club", F.lit("?"))))
    sp = Span((*PLAY, "nfl_id"), ("tick",))
    moved = held_direction(kinematics(rows, sp), sp).join(people.select(*PLAY, "nfl_id", "club"), [*PLAY, "nfl_id"])
    moved = cut_lineage(moved.withColumn("rest", resting_angle(F.col("club"))))
    faced = facing_from_motion(moved, [*PLAY, "nfl_id"], "tick", "rest")
    lineage = F.struct(F.lit(FORECAST).alias("kind"), F.lit(model).alias("model"), F.col("t0").alias("since"))
    samples = moved.join(faced, [*PLAY, "nfl_id", "tick"]).select(
        *PLAY, F.col("tick").alias("step"), "nfl_id", "t", "x", "y", F.col("speed").alias("s"), F.col("accel").alias("a"), wrap_deg(F.col("travel")).alias("dir"), F.col("facing").alias("o"), F.col("facing_source").alias("o_source"), lineage.alias("lineage"))
    strangers = people.groupBy(*PLAY).agg(F.array_sort(F.collect_list(F.when(~F.col("known"), F.col("nfl_id")))).alias("players_not_in_source_roster"), F.count(F.lit(1)).alias("players"))
    meta = good.join(strangers, PLAY).select(
        *PLAY, F.lit("simulated").alias("source"), "simulated_from", F.lit(model).alias("predicted_by"), F.lit(RATE).alias("rate"), "play_direction", "t0", "steps", "players", "players_not_in_source_roster",
        F.lit(False).alias("orientation_measured"), F.lit(False).alias("acceleration_measured"), F.lit("SIMULATED: these positions are forecast, speed and direction are derived from them, facing is inferred").alias("note"))
    return {"samples": samples, "roster": people.drop("known"), "meta": meta, "problems": steps.filter("problem is not null").select(*PLAY, "problem")}


def joined_track(track: dict[str, DataFrame], simulated: dict[str, DataFrame]) -> DataFrame:
    """Samples of the real plays before the forecast begins and of the forecast from there on, each with its lineage."""
    cut = simulated["meta"].select(*PLAY, F.round(F.col("t0") + 1 / RATE, 3).alias("_cut"))
    cols = [*PLAY, "nfl_id", "t", "x", "y", "s", "a", "dir", "o", "o_source"]
    none = F.struct(F.lit(MEASURED).alias("kind"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("double").alias("since"))
    real = track["samples"].join(cut, PLAY).filter(F.col("t") < F.col("_cut")).select(*cols, none.alias("lineage"))
    return real.unionByName(simulated["samples"].select(*cols, "lineage"))


def play_review(rows: DataFrame, ball: DataFrame, plays: DataFrame, routes: DataFrame, forecast: Callable[[DataFrame], DataFrame] = rv.keep_speed,
                rules: ReviewRules = ReviewRules()) -> DataFrame:
    """One row a play: when and where the ball came down, how far ahead was forecast, the decision, and notes.

    ``rows`` are release rows, ``ball`` the ball facing right, ``routes`` (play, nfl_id, route, target). A play without a pass
    arrival has nothing to forecast to: it is refused with a ``problem`` and no decision. One without a target gets no decision, and a note.
    """
    throw = ev.first_by_priority(rows, THROW_NAMES).select(*PLAY, F.col("at").alias("throw"))
    arrival = ev.first_by_priority(rows, ARRIVAL_PRIORITY).select(*PLAY, F.col("at").alias("arrival"), F.col("event").alias("arrival_event"))
    w = plays.select(*PLAY).join(throw, PLAY, "left").join(arrival, PLAY, "left")
    w = w.withColumn("horizon", F.when(F.col("arrival") > F.col("throw"), F.greatest(F.lit(1), F.col("arrival") - F.col("throw"))))
    landing = ball.select(*PLAY, F.col("frame_id").alias("arrival"), F.col("x").alias("land_x"), F.col("y").alias("land_y"))
    w = w.join(landing, [*PLAY, "arrival"], "left")
    problem = (F.when(F.col("arrival").isNull(), "no pass arrival").when(F.col("throw").isNull(), "no throw")
               .when(F.col("horizon").isNull(), "arrival before throw").when(F.col("land_x").isNull(), "ball unseen at arrival"))
    w = w.withColumn("problem", problem)
    windows = w.filter(F.col("problem").isNull()).select(*PLAY, "throw", "arrival", F.col("horizon").alias("h"))
    reports = rv.review_passes(forecast(rv.forecast_samples(rows, windows, plays, routes)), plays, rules)
    out = w.join(reports.select(*PLAY, "decision", "status", "reason", F.col("evidence.target_id").alias("target_id"), F.col("evidence.alternative_id").alias("alternative_id")), PLAY, "left")
    ok = F.col("problem").isNull()
    notes = F.array_compact(F.array(
        F.when(ok, F.format_string("landing point read from the ball at frame %d", "arrival")),
        F.when(ok, F.format_string("forecast runs %d frames from the throw", "horizon")),
        F.when(ok & F.col("decision").isNull(), F.lit("no targeted receiver, so no throw to judge"))))
    return out.select(*PLAY, "throw", "arrival", "arrival_event", "horizon", "land_x", "land_y", "target_id", "alternative_id", "decision", "status", "reason", notes.alias("notes"), "problem")
