"""Joins between entities of one play or one frame. Every join is keyed on at least the play,
so candidates of one key are players of one instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapspan.functions.geometry import dist
from snapspan.schema import FRAME, PLAY


def _as(df: DataFrame, prefix: str, keys, cols) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def _strips(x: Column, reach: float) -> Column:
    """Strips of the field (five reaches wide) that a point can meet within ``reach``."""
    wide = 5.0 * reach
    pad = reach + 1e-6
    return F.sequence(F.floor((x - pad) / wide), F.floor((x + pad) / wide))


def _strip(x: Column, reach: float) -> Column:
    return F.floor(x / (5.0 * reach))


def nearest_opponent(df: DataFrame, keys, pid: str = "nfl_id", side: str = "offense") -> DataFrame:
    """Offset and distance to the nearest player of the other side; 0, 0, 50 without one."""
    a = _as(df, "a_", keys, [pid, side, "x", "y"])
    b = _as(df, "b_", keys, [pid, side, "x", "y"])
    j = a.join(b, keys).filter(F.col(f"a_{side}") != F.col(f"b_{side}"))
    d = dist(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    near = j.groupBy(*keys, F.col(f"a_{pid}").alias(pid)).agg(
        F.min_by(F.struct((F.col("b_x") - F.col("a_x")).alias("dx"), (F.col("b_y") - F.col("a_y")).alias("dy"), d.alias("d")),
                 F.struct(d, F.col(f"b_{pid}"))).alias("_o"))
    out = df.join(near, [*keys, pid], "left")
    return out.withColumns({"opp_dx": F.coalesce("_o.dx", F.lit(0.0)), "opp_dy": F.coalesce("_o.dy", F.lit(0.0)),
                            "opp_dist": F.coalesce("_o.d", F.lit(50.0))}).drop("_o")


def nearest_to_ball(men: DataFrame, ball: DataFrame, keys=FRAME, pid: str = "nfl_id") -> DataFrame:
    """Nearest player to the ball on each frame (ties: lowest id), with the distance."""
    b = _as(ball, "b_", keys, ["x", "y"])
    d = dist(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))
    j = men.join(b, keys).withColumn("_d", d)
    return j.groupBy(*keys).agg(F.min_by(pid, F.struct("_d", pid)).alias("near_id"), F.min("_d").alias("near_dist"))


def close_pairs(men: DataFrame, within: float, pid: str = "nfl_id", team: str = "club", carry=("s",),
                keys=FRAME) -> DataFrame:
    """Pairs a < b of different teams (or of unknown team) within a distance on a frame.

    Each frame is cut into strips five reaches wide and a player near an edge is copied into
    the next strip (about 1.4 copies), so the join is an equi join on (frame, strip).
    """
    cols = [pid, team, "x", "y", *carry]
    a = _as(men, "a_", keys, cols).withColumn("_strip", _strip(F.col("a_x"), within))
    b = _as(men, "b_", keys, cols).withColumn("_strip", F.explode(_strips(F.col("b_x"), within)))
    j = a.join(b, [*keys, "_strip"]).drop("_strip")
    other = F.col(f"a_{team}").isNull() | F.col(f"b_{team}").isNull() | (F.col(f"a_{team}") != F.col(f"b_{team}"))
    d = dist(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    return j.filter((F.col(f"a_{pid}") < F.col(f"b_{pid}")) & other).withColumn("d", d).filter(F.col("d") <= within)


def separation(runners: DataFrame, defenders: DataFrame, keys, x: str = "x", y: str = "y",
               out: str = "separation") -> DataFrame:
    """Distance from each runner to the nearest defender; infinite without one."""
    d = defenders.select(*keys, F.col(x).alias("_dx"), F.col(y).alias("_dy"))
    gap = dist(F.col(x), F.col(y), F.col("_dx"), F.col("_dy"))
    j = runners.join(d, keys, "left")
    inf = F.lit(float("inf"))
    best = j.groupBy(*runners.columns).agg(F.min(gap).alias(out))
    return best.withColumn(out, F.coalesce(out, inf))


def history(state: DataFrame, samples: DataFrame, keys, pid: str, at: str, backs=(5, 10), rate: int = 10) -> DataFrame:
    """Displacement over the last ``backs`` frames, or what the velocity implies without a sample.

    One pass: the samples wanted are picked by a single join on the play and pivoted by offset.
    """
    k = F.col(at) - F.col("frame_id")
    want = samples.join(state.select(*keys, at).distinct(), keys).filter(k.isin(*backs))
    old = want.groupBy(*keys, pid).agg(*[
        F.max(F.when(k == b, F.col(c))).alias(f"{c}_{b}") for b in backs for c in ("x", "y")])
    out = state.join(old, [*keys, pid], "left")
    cols = {}
    for b in backs:
        cols[f"dx{b}"] = F.coalesce(F.col("x") - F.col(f"x_{b}"), F.col("vx") * b / rate)
        cols[f"dy{b}"] = F.coalesce(F.col("y") - F.col(f"y_{b}"), F.col("vy") * b / rate)
    return out.withColumns(cols).drop(*[f"{c}_{b}" for b in backs for c in ("x", "y")])


def crowded(df: DataFrame, radius: float, keys, pid: str) -> DataFrame:
    """Entities with another one nearer than ``radius``; strips keep it an equi join."""
    a = df.withColumn("_strip", _strip(F.col("x"), radius))
    b = _as(df, "b_", keys, [pid, "x", "y"]).withColumn("_strip", F.explode(_strips(F.col("b_x"), radius)))
    hit = dist(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y")) < radius
    j = a.join(b, [*keys, "_strip"]).filter((F.col(pid) != F.col(f"b_{pid}")) & hit)
    flagged = j.select(*keys, pid).distinct().withColumn("crowded", F.lit(True))
    return df.join(flagged, [*keys, pid], "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))


def event_neighbourhood(rows: DataFrame, event_frames: DataFrame, offsets=(0, -5, -10)) -> DataFrame:
    """Rows of the event frames and of the frames the offsets away, each once."""
    want = event_frames.withColumn("frame_id", F.explode(F.array(*[F.col("frame_id") + o for o in offsets])))
    return rows.join(want.select(*FRAME).distinct(), FRAME, "left_semi")


def track_frames(samples: DataFrame, pid: str, team: str, keys=PLAY, frame: str = "frame_id") -> DataFrame:
    """(keys, pid, team, n, first, frames): what a track has under a team, and the frames it has it on as a list."""
    return samples.groupBy(*keys, pid, team).agg(F.count(F.lit(1)).alias("n"), F.min(frame).alias("first"), F.collect_list(frame).alias("frames"))


def duplicate_pairs(samples: DataFrame, pid: str, team: str, yards: float, share: float, min_shared: int,
                    keys=PLAY, frame: str = "frame_id", tracks: DataFrame | None = None) -> DataFrame:
    """Same-team tracks that are one person: close on most of the frames they share.

    The samples of a team on a frame are sorted across the field once, and each meets those at most ``yards`` ahead of it. Only for tracks that were
    ever close the frames they share are counted, in the lists of ``track_frames`` (``tracks``, where they are known already).
    """
    slim = samples.select(*keys, frame, team, F.col(pid).alias("a"), F.col("x").cast("double").alias("x"), F.col("y").alias("y")).dropna(subset=[*keys, frame, team])
    within = ", ".join(f"`{c}`" for c in (*keys, frame, team))
    # peers are among the rows ahead of each other, so equal places meet twice and count once
    ahead = F.expr(f"collect_list(named_struct('b', a, '_x', x, '_y', y)) OVER (PARTITION BY {within} ORDER BY x RANGE BETWEEN CURRENT ROW AND {yards + 1e-6!r}D FOLLOWING)")
    near = slim.withColumn("_ahead", ahead).filter(F.size("_ahead") > 1).select(*keys, team, "a", "x", "y", F.inline("_ahead"))
    near = near.filter(F.when(F.col("x") < F.col("_x"), F.col("a") != F.col("b")).otherwise(F.col("a") < F.col("b")) & (dist(F.col("x"), F.col("y"), F.col("_x"), F.col("_y")) <= yards))
    near = near.groupBy(*keys, team, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("close"))
    # close frames are at least this share of the shared ones, and those at least so many
    near = near.filter(F.col("close") >= share * min_shared)
    tracks = track_frames(samples, pid, team, keys, frame) if tracks is None else tracks
    ends = near.select(*keys, team, "a", "b", "close", F.explode(F.array("a", "b")).alias("_end"))
    ends = ends.join(tracks.select(*keys, team, F.col(pid).alias("_end"), "frames"), [*keys, team, "_end"])
    g = ends.groupBy(*keys, team, "a", "b").agg(F.max("close").alias("close"), F.collect_list("frames").alias("_f"))
    one, other = F.get("_f", F.lit(0)), F.get("_f", F.lit(1))
    once = lambda f: F.size(F.array_distinct(f)) == F.size(f)
    times = F.aggregate(one, F.lit(0).cast("bigint"), lambda n, v: n + F.size(F.filter(other, lambda w: w == v)))
    shared = F.when(once(one) & once(other), F.size(F.array_intersect(one, other)).cast("bigint")).otherwise(times)
    g = g.select(*keys, team, "a", "b", shared.alias("shared"), "close")
    return g.filter((F.col("shared") >= min_shared) & (F.col("close") / F.col("shared") >= share))


def first_containing_box(points: DataFrame, boxes: DataFrame, keys, box_id: str, px: Column, py: Column) -> DataFrame:
    """The lowest-numbered box that holds each point; a point in no box is left out, a repeated point stays repeated."""
    inside = px.between(F.col("x1"), F.col("x2")) & py.between(F.col("y1"), F.col("y2"))
    j = points.withColumn("_lid", F.monotonically_increasing_id()).join(boxes.select(*keys, box_id, "x1", "y1", "x2", "y2"), keys).filter(inside)
    return j.groupBy("_lid", *points.columns).agg(F.min(box_id).alias(box_id)).drop("_lid")
