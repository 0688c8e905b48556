"""Carrier chains and exchanges of the ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapspan.plans.scan import automaton
from snapspan.plans.sequences import Span, last_known, running_sum
from snapspan.schema import FRAME, PLAY

#: In place of an id while the ball is loose.
NOBODY = -1


def carrier_chain(frames: DataFrame, reach: float = 1.5, block: int = 64) -> DataFrame:
    """Carrier per frame with a two-frame debounce; a declared carrier takes over at once.

    ``frames`` is one row per frame: near_id, near_dist, declared. Who is held and whether the last frame spoke against him is a finite state, so plays are cut
    in blocks whose state functions are composed.
    """
    f = frames.select(*FRAME, F.coalesce("declared", F.when(F.col("near_dist") <= reach, F.col("near_id")), F.lit(NOBODY)).cast("bigint").alias("pick"),
                      F.col("declared").isNotNull().alias("sure"))

    def step(s, r):
        differs = s["who"] != r["pick"]
        takes = differs & (r["sure"] | (s["n"] >= 1))
        return F.struct(F.when(takes, r["pick"]).otherwise(s["who"]).alias("who"), F.when(differs & ~takes, s["n"] + 1).otherwise(F.lit(0)).cast("int").alias("n"))

    out = automaton(f, PLAY, "frame_id", ["pick", "sure"], lambda rows: F.transform(rows, lambda r: r["pick"]), 2, (NOBODY, 0), step, block)
    return out.select(*FRAME, F.when(F.col("who") != NOBODY, F.col("who")).alias("carrier"))


def exchanges(chain: DataFrame, events: DataFrame, nearest: DataFrame, sp: Span) -> DataFrame:
    """Each throw, hand-off or lateral with who gave it, who got it and when it arrived.

    An arrival closes the latest exchange before it; the receiver is the nearest player at the
    first arrival of an exchange, its time the last.
    """
    gives, gets = ["pass_forward", "lateral", "handoff"], ["pass_arrived", "pass_outcome_caught"]
    e = events.filter(F.col("event").isin(*gives, *gets)).select(*FRAME, "event").distinct()
    e = e.join(chain, FRAME, "left").join(nearest.select(*FRAME, "near_id"), FRAME, "left")
    e = running_sum(e, sp, F.col("event").isin(*gives).cast("int"), "n")
    give = e.filter(F.col("event").isin(*gives)).select(*PLAY, "n", F.col("event").alias("kind"), F.col("frame_id").alias("start_frame"), F.col("carrier").alias("giver"))
    get = e.filter(F.col("event").isin(*gets)).groupBy(*PLAY, "n").agg(F.min_by("near_id", "frame_id").alias("receiver"), F.max("frame_id").alias("arrive_frame"))
    return give.join(get, [*PLAY, "n"], "left").drop("n")


def keyframe_paths(keys: DataFrame, sp: Span, rate: int = 10) -> DataFrame:
    """Timed keyframes resampled on the grid with a cubic path, each key pair on its own.

    ``keys`` has t, x, y per entity; a grid time belongs to the pair (t, next t].
    """
    from snapspan.plans.sequences import shift
    k = shift(keys, sp, {"_t1": "t", "_x1": "x", "_y1": "y"}, 1)
    k = shift(k, sp, {"_x0": "x", "_y0": "y", "_t0": "t"}, -1)
    k = shift(k, sp, {"_x2": "x", "_y2": "y"}, 2)
    lo = F.when(F.col("_t0").isNull(), F.ceil(F.round(F.col("t") * rate, 6))).otherwise(F.floor(F.round(F.col("t") * rate, 6)) + 1)
    k = k.filter(F.col("_t1").isNotNull()).withColumns({"_lo": lo, "_hi": F.floor(F.round(F.col("_t1") * rate, 6))})
    k = k.filter("_hi >= _lo").withColumn("tick", F.explode(F.sequence("_lo", "_hi")))
    u = (F.col("tick") / rate - F.col("t")) / (F.col("_t1") - F.col("t"))

    def path(c: str):
        b, d = F.col(c), F.col(f"_{c}1")
        a, e = F.coalesce(f"_{c}0", c), F.coalesce(f"_{c}2", f"_{c}1")
        return 0.5 * (2 * b + (d - a) * u + (2 * a - 5 * b + 4 * d - e) * u * u + (3 * b - a - 3 * d + e) * u * u * u)

    return k.select(*sp.keys, "tick", path("x").alias("x"), path("y").alias("y"))


def held_ball(frames: DataFrame, segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Ball per grid frame from segments: carried, or straight between two players.

    ``segments`` has (play, t0, t1, kind, giver, receiver); the segment of a frame is the last
    one begun. ``frames`` is one row per (play, tick), ``paths`` the players' positions.
    """
    s = segments.select(*PLAY, F.round(F.col("t0") * 10).cast("bigint").alias("tick"), F.struct("t0", "t1", "kind", "giver", "receiver").alias("seg"))
    f = frames.join(s, [*PLAY, "tick"], "left")
    f = last_known(f, Span(tuple(PLAY), ("tick",)), F.col("seg"), "now")
    p = lambda who, pre: paths.select(*PLAY, "tick", F.col("nfl_id").alias(who), F.col("x").alias(f"{pre}x"), F.col("y").alias(f"{pre}y"))
    f = f.withColumns({"giver": F.col("now.giver"), "receiver": F.coalesce("now.receiver", "now.giver")})
    f = f.join(p("giver", "g"), [*PLAY, "tick", "giver"], "left").join(p("receiver", "r"), [*PLAY, "tick", "receiver"], "left")
    u = F.greatest(F.least((F.col("tick") / 10 - F.col("now.t0")) / (F.col("now.t1") - F.col("now.t0")), F.lit(1.0)), F.lit(0.0))
    u = F.when(F.col("now.kind") == "carry", 0.0).otherwise(u)
    return f.select(*PLAY, "tick", F.col("now.kind").alias("kind"), (F.col("gx") + (F.col("rx") - F.col("gx")) * u).alias("x"), (F.col("gy") + (F.col("ry") - F.col("gy")) * u).alias("y"))
