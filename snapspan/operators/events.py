"""Event instants, pass windows and ball flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapspan.plans.sequences import Span, islands, shift
from snapspan.schema import (ARRIVAL_PRIORITY, CONTRACT_EVENTS, PLAY, SNAP_NAMES, THROW_NAMES, FlightRules)


def first_time(df: DataFrame, names, at: str = "frame_id", keys=PLAY) -> DataFrame:
    """First instant of any of the named events, one row per play that has one."""
    return (df.filter(F.col("event").isin(*names)).groupBy(*keys).agg(F.min(at).alias("at")))


def first_by_priority(df: DataFrame, names, at: str = "frame_id", keys=PLAY) -> DataFrame:
    """First instant of the best-ranked event a play has, in one pass."""
    mins = [F.min(F.when(F.col("event") == n, F.col(at))) for n in names]
    which = F.coalesce(*[F.when(m.isNotNull(), F.lit(n)) for m, n in zip(mins, names)])
    return df.filter(F.col("event").isin(*names)).groupBy(*keys).agg(
        F.coalesce(*mins).alias("at"), which.alias("event"))


def pass_windows(df: DataFrame) -> DataFrame:
    """Snap, throw and arrival frame of every completed throw window."""
    event = F.lower(F.col("event"))

    def first(names) -> Column:
        return F.min(F.when(event.isin(*names), F.col("frame_id")))

    known = df.filter(event.isin("ball_snap", "pass_arrived", *THROW_NAMES))
    w = known.groupBy(*PLAY).agg(first(["ball_snap"]).alias("snap"), first(THROW_NAMES).alias("throw"),
                                 first(["pass_arrived"]).alias("arrival"))
    w = w.withColumn("h", F.col("arrival") - F.col("throw"))
    return w.filter(F.col("h") > 0)


def snap_frames(df: DataFrame) -> DataFrame:
    """The snap frame, or the first frame of a play without one."""
    snap = F.min(F.when(F.col("event").isin(*SNAP_NAMES), F.col("frame_id")))
    return df.groupBy(*PLAY).agg(F.coalesce(snap, F.min("frame_id")).alias("snap"))


def snap_clock(df: DataFrame, rate: int = 10) -> DataFrame:
    """Seconds from the snap on every row."""
    return (df.join(snap_frames(df), PLAY)
            .withColumn("clock", F.round((F.col("frame_id") - F.col("snap")) / rate, 3)))


def frame_events(df: DataFrame) -> DataFrame:
    """Known events of each frame over player and ball rows, each once."""
    return (df.filter(F.col("event").isin(*CONTRACT_EVENTS))
            .groupBy(*PLAY, "frame_id").agg(F.array_sort(F.collect_set("event")).alias("events")))


def with_snap(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Plays that have a snap; ``limit`` keeps the first n by key."""
    has = df.filter(F.col("event").isin(*SNAP_NAMES)).select(*PLAY).distinct()
    return has.orderBy(*PLAY).limit(limit) if limit is not None else has


def drives(plays: DataFrame, sp: Span) -> DataFrame:
    """Drive number inside a game: a new one on a change of possession or at quarter 3 and 5."""
    df = shift(plays, sp, {"_team": "possession_team", "_q": "quarter"}, -1)
    new = (F.col("_team").isNull() | ~F.col("possession_team").eqNullSafe(F.col("_team"))
           | ((F.col("quarter") != F.col("_q")) & F.col("quarter").isin(3, 5)))
    return islands(df, sp, new, "drive").drop("_team", "_q")


def ball_flights(ball: DataFrame, sp: Span, rules: FlightRules = FlightRules(),
                 measured: DataFrame | None = None) -> DataFrame:
    """The longest stretch the ball moved faster than a runner, judged as a pass or not.

    ``measured`` gives each play its measured share; below the rule the play is refused.
    """
    b = shift(ball, sp, {"pt": "t", "px": "x", "py": "y"}, -1)
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    speed = F.sqrt(dx * dx + dy * dy) / F.greatest(F.col("t") - F.col("pt"), F.lit(1e-6))
    b = b.withColumn("speed", F.round(speed, 9)).withColumn("fast", F.coalesce(F.col("speed") > rules.speed, F.lit(False)))
    b = shift(b, sp, {"was": "fast"}, -1)
    b = islands(b, sp, ~F.col("fast").eqNullSafe(F.col("was")), "run")
    runs = b.filter("fast").groupBy(*PLAY, "run").agg(
        F.min("pt").alias("thrown_at"), F.max("t").alias("arrived_at"),
        F.min_by(F.struct("px", "py"), "t").alias("p0"), F.max_by(F.struct("x", "y"), "t").alias("p1"))
    runs = runs.withColumn("seconds", F.round(F.col("arrived_at") - F.col("thrown_at"), 6))
    best = runs.groupBy(*PLAY).agg(F.min_by(
        F.struct("thrown_at", "arrived_at", "p0", "p1", "seconds"), F.struct(-F.col("seconds"), "run")).alias("f"))
    best = best.select(*PLAY, "f.*")
    flown = F.sqrt(F.pow(F.col("p1.x") - F.col("p0.px"), 2) + F.pow(F.col("p1.y") - F.col("p0.py"), 2))
    best = best.withColumn("flight_yards", flown).drop("p0", "p1")
    seen = ball.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("samples"))
    out = seen.join(best, PLAY, "left")
    if measured is not None:
        out = out.join(measured.select(*PLAY, "measured_share"), PLAY, "left")
    else:
        out = out.withColumn("measured_share", F.lit(None).cast("double"))
    share = F.coalesce(F.col("measured_share"), F.lit(0.0))
    verdict = (F.when((share > 0) & (share < rules.measured_share), "too_little_measured")
               .when(F.col("samples") < 4, "too_few_samples")
               .when(F.col("seconds").isNull(), "never_fast")
               .when((F.col("seconds") < rules.min_seconds) | (F.col("flight_yards") < rules.min_yards), "not_a_throw")
               .otherwise("pass"))
    out = out.withColumn("verdict", verdict)
    is_pass = F.col("verdict") == "pass"
    return out.withColumns({
        "thrown_at": F.when(is_pass, F.col("thrown_at")), "arrived_at": F.when(is_pass, F.col("arrived_at")),
        "confidence": F.when(~is_pass, 0.0).when(share > 0, F.round(F.least(F.lit(0.9), 0.4 + share), 2)).otherwise(0.5)})


def write_events(frames: DataFrame, flights: DataFrame, rate: int = 10) -> DataFrame:
    """Put derived throw and arrival on the frame within half a tick; safe to repeat.

    ``frames`` has one row per frame with an ``events`` array.
    """
    half = 0.5 / rate
    f = frames.join(flights.select(*PLAY, "thrown_at", "arrived_at"), PLAY, "left")

    def near(at: str, name: str) -> Column:
        hit = F.abs(F.col("t") - F.col(at)) < half
        return F.when(F.coalesce(hit, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    have = F.coalesce(F.col("events"), F.array().cast("array<string>"))
    return f.withColumn("events", F.array_union(F.array_union(have, near("thrown_at", "pass_forward")),
                                                near("arrived_at", "pass_arrived"))).drop("thrown_at", "arrived_at")


def throw_arc(df: DataFrame, ball: DataFrame) -> DataFrame:
    """First release, first arrival after it, and the height of the arc at its middle."""
    rel = first_time(df, ["pass_forward", "pass_shovel"]).withColumnRenamed("at", "release")
    later = df.join(rel, PLAY).filter(F.col("frame_id") > F.col("release"))
    arr = first_time(later, ARRIVAL_PRIORITY).withColumnRenamed("at", "arrival")
    w = rel.join(arr, PLAY)
    b = ball.select(*PLAY, "frame_id", "x", "y")
    p0 = b.select(*PLAY, F.col("frame_id").alias("release"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    p1 = b.select(*PLAY, F.col("frame_id").alias("arrival"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    w = w.join(p0, [*PLAY, "release"]).join(p1, [*PLAY, "arrival"])
    d = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    return w.withColumn("distance", d).withColumn("peak", F.greatest(F.least(0.15 * d, F.lit(12.0)), F.lit(1.0)))


def arc_height(u: Column, peak: Column) -> Column:
    return 4.0 * peak * u * (1.0 - u)
