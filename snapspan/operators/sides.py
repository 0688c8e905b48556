"""Which team has the ball, which way it goes, and who plays which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapspan.operators.events import first_by_priority, snap_frames
from snapspan.operators.pairs import nearest_to_ball
from snapspan.schema import ARRIVAL_PRIORITY, ELIGIBLE_POSITIONS, FRAME, LINE_POSITIONS, PLAY, THROW_NAMES


def play_direction(rows: DataFrame) -> DataFrame:
    """Direction from the column where it is filled, else from how far the ball went.

    The evidence is the mean x of the first and last frame, of the ball when it has more than
    two rows and of everybody otherwise; confidence is a tenth of the yards, 1 at most.
    """
    said = F.lower(F.min_by("play_direction", F.when(F.col("play_direction").isNotNull(), F.col("frame_id"))))
    is_ball = F.lower("club") == "ball"
    n = rows.groupBy(*PLAY).agg(said.alias("said"), F.count_if(is_ball).alias("balls"), F.count(F.lit(1)).alias("n"))
    # One row per frame before the play is reduced, so no play is gathered.
    per = rows.groupBy(*PLAY, "frame_id").agg(F.avg(F.when(is_ball, F.col("x"))).alias("bx"), F.avg("x").alias("mx"))
    ends = per.groupBy(*PLAY).agg(
        F.max_by("bx", F.when(F.col("bx").isNotNull(), F.col("frame_id"))).alias("b1"),
        F.min_by("bx", F.when(F.col("bx").isNotNull(), F.col("frame_id"))).alias("b0"),
        F.max_by("mx", "frame_id").alias("m1"), F.min_by("mx", "frame_id").alias("m0"))
    j = n.join(ends, PLAY)
    d = F.when(F.col("balls") > 2, F.col("b1") - F.col("b0")).otherwise(F.col("m1") - F.col("m0"))
    j = j.withColumn("moved", d)
    by_column = F.col("said").isNotNull()
    few = F.col("n") < 2
    return j.select(
        *PLAY,
        F.when(by_column, F.when(F.col("said").startswith("r"), "right").otherwise("left"))
        .when(few | (F.col("moved") >= 0), "right").otherwise("left").alias("direction"),
        F.when(by_column, 1.0).when(few, 0.0).otherwise(F.least(F.abs("moved") / 10.0, F.lit(1.0))).alias("confidence"),
        F.when(by_column, "column").when(few, "assumed").otherwise("ball_displacement").alias("source"))


def offense_by_line(snap_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The team behind the line at the snap; ``lines`` has (play, los, attacks)."""
    j = snap_rows.join(lines, PLAY)
    off = F.when(F.col("attacks") == "right", F.col("x") - F.col("los")).otherwise(F.col("los") - F.col("x"))
    means = j.groupBy(*PLAY, "club").agg(F.avg(off).alias("m"))
    g = means.groupBy(*PLAY).agg(F.min_by("club", F.struct("m", "club")).alias("offense"), F.min("m").alias("low"),
                                 F.max("m").alias("high"), F.count(F.lit(1)).alias("teams"))
    apart = (F.col("low") < 0) & (F.col("high") > 0)
    return g.filter("teams = 2").select(*PLAY, "offense", F.when(apart, "behind_the_los").otherwise("behind_the_los_unseparated").alias("method"),
                                        F.when(apart, 0.95).otherwise(0.5).alias("confidence"))


def offense_by_centre(snap_rows: DataFrame, ball: DataFrame, reach: float = 2.0) -> DataFrame:
    """The team of the player over the ball at the snap."""
    near = nearest_to_ball(snap_rows, ball).filter(F.col("near_dist") <= reach)
    who = snap_rows.select(*FRAME, F.col("nfl_id").alias("near_id"), F.col("club").alias("offense"))
    return near.join(who, [*FRAME, "near_id"]).select(*PLAY, "offense", F.lit("ball_at_snap").alias("method"), F.lit(0.987).alias("confidence"))


def offense_by_stillness(men: DataFrame, snaps: DataFrame, last: int = 10) -> DataFrame:
    """The team that stood stiller over the last frames before the snap."""
    pre = men.join(snaps, PLAY).filter(F.col("frame_id") < F.col("snap"))
    frames = pre.select(*PLAY, "frame_id").distinct()
    # The n-th latest of the distinct frames; an aggregate keeps only n values per play.
    low = frames.groupBy(*PLAY).agg(F.try_element_at(F.slice(F.sort_array(F.collect_set("frame_id"), False), 1, last), F.lit(-1)).alias("from"))
    m = pre.join(low, PLAY).filter(F.col("frame_id") >= F.col("from")).groupBy(*PLAY, "club").agg(F.avg("s").alias("m"))
    g = m.groupBy(*PLAY).agg(F.min_by("club", F.struct("m", "club")).alias("offense"), F.count(F.lit(1)).alias("teams"))
    return g.filter("teams = 2").select(*PLAY, "offense", F.lit("presnap_stillness").alias("method"), F.lit(0.812).alias("confidence"))


def resolve_sides(men: DataFrame, ball: DataFrame, snaps: DataFrame, told: DataFrame | None = None,
                  lines: DataFrame | None = None) -> DataFrame:
    """Offense, defense, method and confidence per play: told, line, centre, stillness, unknown."""
    teams = men.groupBy(*PLAY).agg(F.min("club").alias("team1"), F.max("club").alias("team2"),
                                   F.array_sort(F.collect_set("club")).alias("clubs"))
    at_snap = men.join(snaps.select(*PLAY, F.col("snap").alias("frame_id")), FRAME)
    ways = []
    if told is not None:
        ways.append(told.select(*PLAY, "offense", F.lit("caller").alias("method"), F.lit(1.0).alias("confidence")))
    found = []
    if lines is not None:
        found.append(offense_by_line(at_snap, lines))
    found += [offense_by_centre(at_snap, ball), offense_by_stillness(men, snaps)]
    two = teams.filter(F.size("clubs") == 2).select(*PLAY)
    ways += [w.join(two, PLAY, "left_semi") for w in found]
    out = teams
    for i, w in enumerate(ways):
        out = out.join(w.select(*PLAY, F.struct("offense", "method", "confidence").alias(f"_w{i}")), PLAY, "left")
    none = F.struct(F.col("team1").alias("offense"), F.lit("unknown").alias("method"), F.lit(0.0).alias("confidence"))
    pick = F.coalesce(*[F.col(f"_w{i}") for i in range(len(ways))], none)
    out = out.withColumn("_p", pick)
    other = F.try_element_at(F.filter("clubs", lambda c: c != F.col("_p.offense")), F.lit(1))
    return out.select(*PLAY, "_p.offense", F.coalesce(other, F.lit("unknown")).alias("defense"), "_p.method", "_p.confidence")


def formation_line(snap_rows: DataFrame) -> DataFrame:
    """Line of scrimmage between the two front ranks at the snap; rows carry ``side``."""
    off, de = F.col("side") == "offense", F.col("side") == "defense"
    x = lambda c: F.when(c, F.col("x"))
    p = lambda c, q: F.percentile(x(c), F.lit(q))
    g = snap_rows.groupBy(*PLAY).agg(
        F.count_if(off).alias("n_off"), F.count_if(de).alias("n_def"), p(off, 0.5).alias("mid_off"), p(de, 0.5).alias("mid_def"),
        p(off, 0.9).alias("off90"), p(off, 0.1).alias("off10"), p(de, 0.9).alias("def90"), p(de, 0.1).alias("def10"))
    g = g.filter((F.col("n_off") >= 4) & (F.col("n_def") >= 4))
    right = F.col("mid_def") > F.col("mid_off")
    g = g.withColumns({"attacks": F.when(right, "right").otherwise("left"), "fo": F.when(right, F.col("off90")).otherwise(F.col("off10")),
                       "fd": F.when(right, F.col("def10")).otherwise(F.col("def90"))})
    gap = F.abs(F.col("fd") - F.col("fo"))
    crossed = (right & (F.col("fd") < F.col("fo"))) | (~right & (F.col("fd") > F.col("fo")))
    return g.select(*PLAY, ((F.col("fo") + F.col("fd")) / 2).alias("los"), "attacks", gap.alias("gap"),
                    F.when((gap > 8.0) | crossed, 0.3).when(gap <= 4.0, 0.8).otherwise(0.6).alias("confidence"))


def infer_roles(men: DataFrame, ball: DataFrame, events: DataFrame, sides: DataFrame) -> DataFrame:
    """Passer, target, route runners and coverage for every player of a play.

    A play whose offense does not split its roster in two keeps a problem text.
    """
    roster = men.groupBy(*PLAY, "nfl_id").agg(F.min_by("club", "frame_id").alias("club"), F.min_by("position", "frame_id").alias("position"))
    r = roster.join(sides.select(*PLAY, "offense"), PLAY, "left")
    r = r.withColumn("is_off", F.coalesce(F.lower("club") == F.lower("offense"), F.lit(False)))
    facts = r.groupBy(*PLAY).agg(F.count_if("is_off").alias("n_off"), F.count_if(~F.col("is_off")).alias("n_def"),
                                 F.max(F.when(F.col("is_off"), F.coalesce(F.nullif("position", F.lit("")).isNotNull(), F.lit(False)))).alias("known"))
    r = r.join(facts, PLAY)
    pos = F.coalesce("position", F.lit(""))
    r = r.withColumns({"routes": F.col("is_off") & (~F.col("known") | pos.isin(*ELIGIBLE_POSITIONS)),
                       "throws": F.col("is_off") & (~F.col("known") | ~pos.isin(*LINE_POSITIONS))})
    throw = first_by_priority(events, THROW_NAMES).select(*PLAY, F.col("at").alias("frame_id"))
    arrive = first_by_priority(events, ARRIVAL_PRIORITY).select(*PLAY, F.col("at").alias("frame_id"))
    flags = r.select(*PLAY, "nfl_id", "routes", "throws")
    thrown = men.join(throw, FRAME).join(flags.filter("throws"), [*PLAY, "nfl_id"])
    passer = nearest_to_ball(thrown, ball).select(*PLAY, F.col("near_id").alias("passer"))
    arrived = men.join(arrive, FRAME).join(flags.filter("routes"), [*PLAY, "nfl_id"]).join(passer, PLAY, "left")
    arrived = arrived.filter(~F.coalesce(F.col("nfl_id") == F.col("passer"), F.lit(False)))
    target = nearest_to_ball(arrived, ball).select(*PLAY, F.col("near_id").alias("target"))
    r = r.join(passer, PLAY, "left").join(target, PLAY, "left")
    role = (F.when(F.col("nfl_id") == F.col("passer"), "Passer").when(F.col("nfl_id") == F.col("target"), "Targeted Receiver")
            .when(F.col("routes"), "Other Route Runner").when(~F.col("is_off"), "Defensive Coverage"))
    bad = (F.col("n_off") == 0) | (F.col("n_def") == 0)
    return r.select(*PLAY, "nfl_id", F.when(~bad, role).alias("role"), (F.when(~bad, role) == "Targeted Receiver").alias("star"),
                    F.when(F.col("known"), "eligible positions").otherwise("all remaining offense").alias("roles_source"),
                    F.when(bad, "offense does not split the roster").alias("problem"))


def role_accuracy(roles: DataFrame, named: DataFrame, hit: Column) -> DataFrame:
    """How often the inferred target is the named one. ``named`` has (play, named, full_name by nfl_id)."""
    t = roles.filter("role = 'Targeted Receiver'").select(*PLAY, "nfl_id")
    j = named.select(*PLAY, "named").distinct().join(t, PLAY, "left")
    j = j.withColumn("hit", hit)
    g = j.agg(F.count(F.lit(1)).alias("plays"), F.count_if(F.col("nfl_id").isNull()).alias("no_target"),
              F.count_if(F.col("nfl_id").isNotNull() & F.col("named").isNull()).alias("unnamed"),
              F.count_if(F.col("nfl_id").isNotNull() & F.col("named").isNotNull() & F.col("hit")).alias("hits"),
              F.count_if(F.col("nfl_id").isNotNull() & F.col("named").isNotNull() & ~F.col("hit")).alias("misses"))
    checked = F.col("hits") + F.col("misses")
    return g.withColumn("hit_rate", F.when(checked > 0, F.round(F.col("hits") / checked, 3)))


__all__ = ["play_direction", "resolve_sides", "formation_line", "infer_roles", "role_accuracy", "snap_frames"]
