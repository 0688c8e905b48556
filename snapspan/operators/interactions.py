"""Possession, contact, evasion and view windows over all plays at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapspan.functions.angles import heading, turn_deg
from snapspan.functions.geometry import dist
from snapspan.operators.pairs import close_pairs, nearest_to_ball
from snapspan.plans.scan import automaton
from snapspan.plans.sequences import Span, islands, position, shift
from snapspan.schema import FRAME, PLAY, ContactRules, EvadeRules, PossessionRules, ViewRules

#: In place of an id while nobody carries the ball.
NOBODY = -1


def holders(men: DataFrame, ball: DataFrame, rules: PossessionRules = PossessionRules()) -> DataFrame:
    """Who has the ball on each frame; null while it is loose or unseen."""
    near = nearest_to_ball(men, ball)
    frames = men.select(*FRAME, "t").distinct()
    return frames.join(near, FRAME, "left").select(
        *FRAME, "t", F.when(F.col("near_dist") <= rules.reach, F.col("near_id")).alias("holder"))


def ball_usable(men: DataFrame, ball: DataFrame, rules: PossessionRules = PossessionRules()) -> DataFrame:
    """Does the ball column follow the ball: held often enough, and by the offense.

    ``men`` carries ``side`` (offense or defense).
    """
    near = nearest_to_ball(men, ball).join(ball.select(*FRAME, "t"), FRAME).filter("t >= 0")
    who = near.join(men.select(*FRAME, F.col("nfl_id").alias("near_id"), "side"), [*FRAME, "near_id"], "left")
    held = F.col("near_dist") <= rules.reach
    g = who.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("live"), F.count_if(held).alias("held"),
                               F.count_if(held & (F.col("side") == "offense")).alias("by_offense"))
    g = g.withColumn("held_share", F.col("held") / F.col("live"))
    g = g.withColumn("offense_share", F.when(F.col("held") > 0, F.col("by_offense") / F.col("held")))
    ok = (F.col("held_share") >= rules.held_share) & (F.coalesce("offense_share", F.lit(1.0)) >= rules.offense_share)
    return g.withColumn("usable", ok)


def possession_runs(frames: DataFrame, sp: Span) -> DataFrame:
    """Stretches with one holder, from first to last sample of the run."""
    f = shift(frames.withColumn("_one", F.lit(1)), sp, {"_was": "holder", "_had": "_one"}, -1)
    starts = F.col("_had").isNull() | ~F.col("holder").eqNullSafe(F.col("_was"))
    f = islands(f, sp, starts, "run")
    return f.groupBy(*PLAY, "run").agg(F.first("holder").alias("holder"), F.min("frame_id").alias("start_frame"),
                                       F.max("frame_id").alias("end_frame"), F.min("t").alias("t_start"), F.max("t").alias("t_end"))


def convergence(men: DataFrame, radius: float = 15.0) -> DataFrame:
    """Summed closing speed of nearby defenders on each offensive player, frame by frame.

    ``men`` carries ``side`` and the contract direction ``cdir``.
    """
    v = men.withColumns({"vx": F.col("s") * F.cos(F.radians("cdir")), "vy": F.col("s") * F.sin(F.radians("cdir"))})
    off = v.filter("side = 'offense'").select(*FRAME, "t", "nfl_id", "x", "y", "vx", "vy")
    de = v.filter("side = 'defense'").select(*FRAME, *[F.col(c).alias(f"d_{c}") for c in ("x", "y", "vx", "vy")])
    dx, dy = F.col("d_x") - F.col("x"), F.col("d_y") - F.col("y")
    d = F.sqrt(dx * dx + dy * dy)
    closing = -((F.col("d_vx") - F.col("vx")) * dx + (F.col("d_vy") - F.col("vy")) * dy) / d
    good = (d <= radius) & (d >= 1e-6) & (closing > 0)
    return off.join(de, FRAME, "left").groupBy(*FRAME, "t", "nfl_id").agg(
        F.coalesce(F.sum(F.when(good, closing)), F.lit(0.0)).alias("score"))


def inferred_holders(scores: DataFrame, frames: DataFrame, margin: float = 1.5, block: int = 64) -> DataFrame:
    """Carrier from convergence; a new man takes over only when ahead by ``margin``.

    Scores are reduced to one row per frame first; who is held is a finite state, so plays are cut in blocks whose state functions are composed.
    ``frames`` has (game, play, frame, t); frames before t = 0 have no carrier.
    """
    best = scores.groupBy(*FRAME).agg(F.collect_list(F.struct(F.col("nfl_id").cast("bigint").alias("id"), "score")).alias("scores"),
                                      F.min(F.struct((-F.col("score")).alias("less"), F.col("nfl_id").cast("bigint").alias("id"))).alias("top"))
    rows = frames.select(*FRAME, "t").join(best, FRAME, "left").withColumn("live", (F.col("t") >= 0) & F.col("top").isNotNull())

    def step(s, r):
        mine = F.get(F.filter(r["scores"], lambda c: c["id"] == s["who"]), F.lit(0))["score"]
        top, lead = r["top"]["id"], -r["top"]["less"] - F.coalesce(mine, F.lit(0.0))
        takes = r["live"] & ((s["who"] == NOBODY) | (lead > margin))
        return F.struct(F.when(takes, top).otherwise(s["who"]).alias("who"), F.lit(0).alias("n"))

    mentioned = lambda rows: F.flatten(F.transform(rows, lambda r: F.coalesce(F.transform(r["scores"], lambda c: c["id"]), F.array().cast("array<bigint>"))))
    held = automaton(rows, PLAY, "frame_id", ["live", "top", "scores"], mentioned, 1, (NOBODY, 0), step, block)
    out = frames.select(*FRAME, "t").join(held, FRAME)
    return out.select(*FRAME, "t", F.when((F.col("t") >= 0) & (F.col("who") != NOBODY), F.col("who")).alias("holder"))


def engagements(men: DataFrame, held: DataFrame, play_span: Span, rules: ContactRules = ContactRules()) -> DataFrame:
    """Contacts between opponents, as chains of near frames.

    A chain breaks where some frame of the play lies at least ``grace_frames`` after the last
    sighting with the pair unseen. A contact runs from the first row of a chain inside ``enter``
    to its end. ``held`` is one row per frame with its holder.
    """
    frames = shift(held.select(*FRAME, "holder"), play_span, {"prev_frame": "frame_id"}, -1)
    near = close_pairs(men, rules.stay).join(frames, FRAME)
    near = near.select(*FRAME, F.col("a_nfl_id").alias("a"), F.col("b_nfl_id").alias("b"), "a_s", "b_s", "d", "holder", "prev_frame")
    pair = Span((*PLAY, "a", "b"), ("frame_id",), play_span.block)
    near = shift(near, pair, {"seen": "frame_id"}, -1)
    cut = F.col("seen").isNull() | (F.col("prev_frame") >= F.col("seen") + rules.grace_frames)
    near = islands(near, pair, cut, "chain")
    chain = [*PLAY, "a", "b", "chain"]
    so_far = Window.partitionBy(*chain).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("open_at", F.min(F.when(F.col("d") <= rules.enter, F.col("frame_id"))).over(so_far))
    near = near.filter(F.col("open_at").isNotNull())
    with_ball = (F.col("holder") == F.col("a")) | (F.col("holder") == F.col("b"))
    near = near.withColumn("held_id", F.first(F.when(with_ball, F.col("holder")), ignorenulls=True).over(so_far))
    held_s = F.when(F.col("held_id") == F.col("a"), F.col("a_s")).otherwise(F.col("b_s"))
    down = F.col("held_id").isNotNull() & (held_s < rules.down_speed)
    g = near.groupBy(*chain).agg(
        F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.min("d").alias("closest"),
        (F.min_by("a_s", "frame_id") - F.min("a_s")).alias("a_drop"), (F.min_by("b_s", "frame_id") - F.min("b_s")).alias("b_drop"),
        F.max(F.coalesce(with_ball, F.lit(False))).alias("carrier"), F.min(F.when(down, F.col("frame_id"))).alias("down_frame"))
    long = F.col("end_frame") - F.col("start_frame")
    hard = F.greatest("a_drop", "b_drop") >= rules.tackle_drop
    kind = (F.when(F.col("carrier") & hard, "tackle").when(F.col("carrier"), "tackle_attempt")
            .when(long >= rules.block_frames, "block").otherwise("collision"))
    return g.filter(long >= rules.min_frames).withColumn("kind", kind).drop("chain")


def evades(men: DataFrame, held: DataFrame, contacts: DataFrame, play_span: Span,
           rules: EvadeRules = EvadeRules()) -> DataFrame:
    """Opponents the carrier went round without touching them; first time per pair.

    The look-ahead and look-back are ``reach_frames`` frame rows away, clamped to the play.
    """
    idx = position(held.select(*FRAME, "holder"), play_span, "k")
    size = idx.groupBy(*PLAY).agg(F.max("k").alias("n"))
    at = idx.join(size, PLAY)
    at = at.withColumns({"lo": F.greatest(F.col("k") - rules.reach_frames, F.lit(1)),
                         "hi": F.least(F.col("k") + rules.reach_frames, F.col("n"))})
    names = idx.select(*PLAY, "k", "frame_id")
    at = at.filter(F.col("holder").isNotNull())
    at = at.join(names.select(*PLAY, F.col("k").alias("lo"), F.col("frame_id").alias("lo_frame")), [*PLAY, "lo"])
    at = at.join(names.select(*PLAY, F.col("k").alias("hi"), F.col("frame_id").alias("hi_frame")), [*PLAY, "hi"])
    c = men.select(*FRAME, F.col("nfl_id").alias("holder"), F.col("club").alias("c_club"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = at.join(c, [*FRAME, "holder"])
    p = men.select(*FRAME, "nfl_id", "club", "x", "y")
    near = near.join(p, FRAME)
    d = dist(F.col("cx"), F.col("cy"), F.col("x"), F.col("y"))
    rival = (F.col("nfl_id") != F.col("holder")) & ~F.coalesce(F.col("club") == F.col("c_club"), F.lit(False))
    near = near.filter(rival & (d <= rules.radius)).withColumn("d", d)
    near = near.withColumns({"a": F.least("holder", "nfl_id"), "b": F.greatest("holder", "nfl_id")})
    near = near.join(contacts.select(*PLAY, "a", "b").distinct(), [*PLAY, "a", "b"], "left_anti")
    spot = men.select(*PLAY, "frame_id", "nfl_id", "x", "y", "cdir")

    def look(frame: str, who: str, prefix: str, cols) -> DataFrame:
        return spot.select(*PLAY, F.col("frame_id").alias(frame), F.col("nfl_id").alias(who),
                           *[F.col(k).alias(f"{prefix}{k}") for k in cols])

    near = near.drop("x", "y", "cx", "cy")
    near = near.join(look("lo_frame", "holder", "l_", ["cdir"]), [*PLAY, "lo_frame", "holder"])
    near = near.join(look("hi_frame", "holder", "h_", ["x", "y", "cdir"]), [*PLAY, "hi_frame", "holder"])
    near = near.join(look("hi_frame", "nfl_id", "o_", ["x", "y"]), [*PLAY, "hi_frame", "nfl_id"])
    swing = F.abs(turn_deg(F.col("l_cdir"), F.col("h_cdir")))
    h = F.radians("h_cdir")
    ahead = (F.col("o_x") - F.col("h_x")) * F.cos(h) + (F.col("o_y") - F.col("h_y")) * F.sin(h)
    near = near.withColumns({"swing": swing, "ahead": ahead})
    near = near.filter((F.col("swing") >= rules.turn_deg) & (F.col("ahead") <= -rules.behind))
    first = near.groupBy(*PLAY, "a", "b").agg(F.min_by(
        F.struct(F.col("holder").alias("carrier"), F.col("nfl_id").alias("beaten"), "frame_id", "d", "swing"), "frame_id").alias("e"))
    return first.select(*PLAY, "e.*")


# Trust order of facing sources (fixed values), worst last.
SOURCE_RANK = {"measured": 0, "from_dir": 1, "from_velocity": 2, "assumed": 3, "authored": 4}


def source_rank(src: Column) -> Column:
    out = F.lit(9)
    for name, rank in SOURCE_RANK.items():
        out = F.when(src == name, rank).otherwise(out)
    return out


def view_windows(men: DataFrame, ball: DataFrame, sp: Span, rules: ViewRules = ViewRules()) -> DataFrame:
    """When the ball lay in front of each player, with the weakest facing source used.

    ``men`` has contract facing ``co`` and ``o_source``. A window ends at the first sample out
    of view, or at the player's last sample; frames without a ball do not count as samples.
    """
    b = ball.select(*FRAME, F.col("x").alias("bx"), F.col("y").alias("by"))
    v = men.select(*FRAME, "nfl_id", "x", "y", "co", "o_source").join(b, FRAME)
    off = F.abs(turn_deg(F.col("co"), heading(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))))
    v = v.withColumn("offset", off).withColumn("seen", F.col("offset") <= rules.cone_deg)
    v = shift(v, sp, {"was": "seen"}, -1)
    v = shift(v, sp, {"next_frame": "frame_id"}, 1)
    v = islands(v, sp, ~F.col("seen").eqNullSafe(F.col("was")), "run")
    g = v.filter("seen").groupBy(*sp.keys, "run").agg(
        F.min("frame_id").alias("start_frame"), F.max_by(F.coalesce("next_frame", "frame_id"), "frame_id").alias("end_frame"),
        F.max_by("o_source", source_rank(F.col("o_source"))).alias("basis"), F.max("offset").alias("max_offset"))
    return g.filter(F.col("end_frame") - F.col("start_frame") >= rules.min_frames).drop("run")


def interval_timeline(runs: DataFrame, contacts: DataFrame, beaten: DataFrame, min_frames: int = 3) -> DataFrame:
    """One list of what happened: possession, contact (no collisions) and evasion."""
    p = runs.filter(F.col("holder").isNotNull() & (F.col("end_frame") - F.col("start_frame") >= min_frames)).select(
        *PLAY, F.lit("possession").alias("what"), F.col("holder").alias("who"), F.lit(None).cast("bigint").alias("other"),
        "start_frame", "end_frame")
    c = contacts.filter("kind <> 'collision'").select(*PLAY, F.col("kind").alias("what"), F.col("a").alias("who"),
                                                      F.col("b").alias("other"), "start_frame", "end_frame")
    e = beaten.select(*PLAY, F.lit("evade").alias("what"), F.col("carrier").alias("who"), F.col("beaten").alias("other"),
                      F.col("frame_id").alias("start_frame"), F.col("frame_id").alias("end_frame"))
    return p.unionByName(c).unionByName(e)
