"""Whole tracks and play reviews in one call."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.fixture import add_base
from snapspan.catalog.q_review import routes
from snapspan.catalog.registry import Tables, query
from snapspan.operators import tracks as tr
from snapspan.schema import FRAME, PLAY


def released(t: Tables):
    """Some plays come without body angles, some without accelerations."""
    return t.trk.withColumns({"o": F.when(F.col("play_id") % 5 > 0, F.col("o")), "a": F.when(F.col("play_id") % 3 > 0, F.col("a"))}).drop("t")


@query("release_track", """SELECT game_id, play_id, frame_id, nfl_id, round(t, 3) AS t, round(x, 6) AS x, round(y, 6) AS y, round(s, 6) AS s,
  round(CASE WHEN play_id % 3 > 0 THEN a WHEN lag(s) OVER w IS NULL OR lead(s) OVER w IS NULL THEN 0 ELSE abs((lead(s) OVER w - lag(s) OVER w) / 0.2) END + 1e-8, 5) AS a,
  round(cdir, 6) AS dir, round(CASE WHEN play_id % 5 > 0 THEN co ELSE cdir END, 6) AS o, CASE WHEN play_id % 5 > 0 AND o IS NOT NULL THEN 'measured' ELSE 'from_dir' END AS o_source
  FROM men WINDOW w AS (PARTITION BY play_id, nfl_id ORDER BY frame_id)""", "men")
def _(t: Tables):
    s = tr.release_to_track(released(t), t.player_span())["samples"]
    return s.select(*FRAME, "nfl_id", *[F.round(c, 6).alias(c) for c in ("t", "x", "y", "s")], F.round(F.col("a") + 1e-8, 5).alias("a"),
                    F.round("dir", 6).alias("dir"), F.round("o", 6).alias("o"), "o_source")


@query("release_track_meta", """SELECT game_id, play_id, play_direction, play_direction = 'left' AS mirrored, play_id % 5 > 0 AND count(o) > 0 AS orientation_measured,
  play_id % 3 > 0 AS acceleration_measured, coalesce(min(frame_id) FILTER (event = 'ball_snap'), min(frame_id)) AS snap FROM trk GROUP BY game_id, play_id, play_direction""", "trk")
def _(t: Tables):
    return tr.release_to_track(released(t), t.player_span())["meta"].select(*PLAY, "play_direction", "mirrored", "orientation_measured", "acceleration_measured", "snap")


@query("play_review", """WITH e AS (SELECT game_id, play_id, min(frame_id) FILTER (event = 'pass_forward') AS throw, min(frame_id) FILTER (event = 'pass_arrived') AS arrival FROM trk GROUP BY ALL)
 SELECT p.game_id, p.play_id, e.throw, e.arrival, CASE WHEN e.arrival > e.throw THEN e.arrival - e.throw END AS horizon, round(b.x, 6) AS land_x, round(b.y, 6) AS land_y, r.target_id, r.decision,
  CASE WHEN e.arrival IS NULL THEN 0 WHEN r.decision IS NULL THEN 3 ELSE 2 END::INT AS notes, CASE WHEN e.arrival IS NULL THEN 'no pass arrival' WHEN e.throw IS NULL THEN 'no throw' END AS problem
 FROM plays p LEFT JOIN e ON e.play_id = p.play_id LEFT JOIN ball b ON b.play_id = p.play_id AND b.frame_id = e.arrival LEFT JOIN reports r ON r.play_id = p.play_id""", "plays", "trk", "ball", "reports")
def _(t: Tables):
    r = tr.play_review(t.trk, t.ball, t.plays.withColumn("possession_team", F.lit("HOM")), routes(t))
    return r.select(*PLAY, "throw", "arrival", "horizon", F.round("land_x", 6).alias("land_x"), F.round("land_y", 6).alias("land_y"), "target_id", "decision", F.size("notes").alias("notes"), "problem")


# A forecast for each throw: where the players went, half a yard off; a stranger among them in every fifth play, and a missing step in every thirteenth.
add_base("ahead", """SELECT m.game_id, m.play_id, m.nfl_id, m.frame_id - w.throw AS step, m.x + CASE WHEN m.mirrored THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END AS x, m.y, m.club, (w.throw - w.snap) / 10 AS t0
  FROM men m JOIN win w ON w.play_id = m.play_id WHERE m.frame_id > w.throw AND m.frame_id <= w.arrival
  UNION ALL SELECT m.game_id, m.play_id, m.nfl_id + 500, m.frame_id - w.throw, m.x + CASE WHEN m.mirrored THEN -0.5::DOUBLE ELSE 0.5::DOUBLE END, m.y, '?', (w.throw - w.snap) / 10
  FROM men m JOIN win w ON w.play_id = m.play_id WHERE m.frame_id > w.throw AND m.frame_id <= w.arrival AND m.nfl_id = 4 AND m.play_id % 5 = 2""", "men", "win")


def simulated(t: Tables):
    w = t.win.select(*PLAY, "snap", "throw", "arrival")
    p = t.trk.filter("nfl_id IS NOT NULL").join(w, PLAY).filter("frame_id > throw AND frame_id <= arrival").select(*PLAY, "nfl_id", (F.col("frame_id") - F.col("throw")).alias("step"), (F.col("x") + 0.5).alias("x"), "y")
    p = p.unionByName(p.filter("nfl_id = 4 AND play_id % 5 = 2").withColumn("nfl_id", F.col("nfl_id") + 500)).filter("NOT (play_id % 13 = 6 AND step = 2)")
    track = tr.release_to_track(released(t), t.player_span())
    return track, tr.forecast_to_track(p, track, w.select(*PLAY, ((F.col("throw") - F.col("snap")) / 10).alias("t0")), "drift")


@query("forecast_track", """SELECT game_id, play_id, step::INT AS step, nfl_id, round(t0 + step / 10, 3) AS t, round(x, 6) AS x, round(y, 6) AS y, round(coalesce(sqrt(power((lead(x) OVER w - lag(x) OVER w) / 0.2, 2) + power((lead(y) OVER w - lag(y) OVER w) / 0.2, 2)),
   sqrt(power((lead(x) OVER w - x) / 0.1, 2) + power((lead(y) OVER w - y) / 0.1, 2)), sqrt(power((x - lag(x) OVER w) / 0.1, 2) + power((y - lag(y) OVER w) / 0.1, 2)), 0) + 1e-7, 4) AS s, 'forecast' AS kind, 'drift' AS model
  FROM ahead WHERE play_id % 13 <> 6 WINDOW w AS (PARTITION BY play_id, nfl_id ORDER BY step)""", "ahead")
def _(t: Tables):
    s = simulated(t)[1]["samples"]
    return s.select(*PLAY, "step", "nfl_id", F.round("t", 3).alias("t"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.col("s") + 1e-7, 4).alias("s"), F.col("lineage.kind").alias("kind"), F.col("lineage.model").alias("model"))


@query("forecast_track_meta", """SELECT game_id, play_id, max(step)::BIGINT AS steps, count(DISTINCT nfl_id) AS players, coalesce(string_agg(DISTINCT CASE WHEN club = '?' THEN nfl_id::VARCHAR END, ','), '') AS strangers, NULL::VARCHAR AS problem FROM ahead WHERE play_id % 13 <> 6 GROUP BY ALL
  UNION ALL SELECT DISTINCT game_id, play_id, NULL, NULL, NULL, 'steps are not 1 to N' FROM ahead WHERE play_id % 13 = 6""", "ahead")
def _(t: Tables):
    s = simulated(t)[1]
    meta = s["meta"].select(*PLAY, "steps", "players", F.array_join(F.transform("players_not_in_source_roster", lambda i: i.cast("string")), ",").alias("strangers"), F.lit(None).cast("string").alias("problem"))
    none = F.lit(None).cast("bigint")
    return meta.unionByName(s["problems"].select(*PLAY, none.alias("steps"), none.alias("players"), F.lit(None).cast("string").alias("strangers"), "problem"))


@query("joined_track", """SELECT game_id, play_id, kind, count(*) AS n, round(min(t), 3) AS first_t, round(max(t), 3) AS last_t FROM (
  SELECT m.game_id, m.play_id, 'measured' AS kind, round((m.frame_id - w.snap) / 10, 3) AS t FROM men m JOIN win w ON w.play_id = m.play_id WHERE m.frame_id <= w.throw AND m.play_id % 13 <> 6
  UNION ALL SELECT game_id, play_id, 'forecast', round(t0 + step / 10, 3) FROM ahead WHERE play_id % 13 <> 6) z GROUP BY ALL""", "men", "win", "ahead")
def _(t: Tables):
    j = tr.joined_track(*simulated(t))
    return j.groupBy(*PLAY, F.col("lineage.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("t"), 3).alias("first_t"), F.round(F.max("t"), 3).alias("last_t"))
