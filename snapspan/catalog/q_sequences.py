"""Window and sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.registry import Tables, query
from snapspan.functions.angles import blend_angle
from snapspan.operators import events as ev, timeseries as ts
from snapspan.schema import FRAME, PLAY

K = ["game_id", "play_id", "frame_id", "nfl_id"]
W = "WINDOW w AS (PARTITION BY play_id, nfl_id ORDER BY frame_id)"

GRAD = f"""SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM (SELECT game_id, play_id, frame_id, nfl_id, t, x, y, co, o, s,
   CASE WHEN lag(x) OVER w IS NOT NULL AND lead(x) OVER w IS NOT NULL THEN (lead(x) OVER w - lag(x) OVER w) / 0.2::DOUBLE
     WHEN lead(x) OVER w IS NOT NULL THEN (lead(x) OVER w - x) / 0.1::DOUBLE ELSE (x - lag(x) OVER w) / 0.1::DOUBLE END AS vx,
   CASE WHEN lag(y) OVER w IS NOT NULL AND lead(y) OVER w IS NOT NULL THEN (lead(y) OVER w - lag(y) OVER w) / 0.2::DOUBLE
     WHEN lead(y) OVER w IS NOT NULL THEN (lead(y) OVER w - y) / 0.1::DOUBLE ELSE (y - lag(y) OVER w) / 0.1::DOUBLE END AS vy
  FROM men {W}) g0"""


def moving(t: Tables):
    return ts.kinematics(t.men.select(*K, "t", "x", "y", "s", "co"), t.player_span())


@query("gradient_kinematics", f"""WITH g AS ({GRAD}) SELECT game_id, play_id, frame_id, nfl_id, round(vx, 5) AS vx, round(vy, 5) AS vy, round(speed, 5) AS speed,
  round(abs(CASE WHEN lag(speed) OVER w IS NOT NULL AND lead(speed) OVER w IS NOT NULL THEN (lead(speed) OVER w - lag(speed) OVER w) / 0.2
    WHEN lead(speed) OVER w IS NOT NULL THEN (lead(speed) OVER w - speed) / 0.1 ELSE (speed - lag(speed) OVER w) / 0.1 END), 4) AS accel,
  round(coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0), 5) AS step FROM g {W}""", "men")
def _(t: Tables):
    return moving(t).select(*K, *[F.round(c, 5).alias(c) for c in ("vx", "vy", "speed", "step")], F.round("accel", 4).alias("accel"))


@query("held_direction", f"""WITH g AS ({GRAD}), h AS (SELECT *, CASE WHEN round(speed, 9) > 0.6 THEN (round(degrees(atan2(vy, vx)), 4) + 360) % 360 END AS own FROM g),
 n AS (SELECT play_id, nfl_id, count(own) AS moves, arg_max(x, frame_id) - arg_min(x, frame_id) AS dx, arg_max(y, frame_id) - arg_min(y, frame_id) AS dy FROM h GROUP BY ALL)
 SELECT h.game_id, h.play_id, h.frame_id, h.nfl_id, CASE WHEN moves = 0 AND sqrt(dx * dx + dy * dy) > 1e-6 THEN (round(degrees(atan2(dy, dx)), 4) + 360) % 360
   ELSE coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY h.play_id, h.nfl_id ORDER BY h.frame_id), 0) END AS travel
 FROM h JOIN n ON h.play_id = n.play_id AND h.nfl_id = n.nfl_id""", "men")
def _(t: Tables):
    h = ts.held_direction(moving(t), t.player_span())
    return h.select(*K, F.pmod(F.round("travel", 4), F.lit(360.0)).alias("travel"))


def _smooth_sql() -> str:
    h = ts.smooth_weights(7)
    mid = " + ".join(f"{h[3][j]!r} * x_{j}" for j in range(7))
    cases = " ".join(f"WHEN i = {r} THEN " + " + ".join(f"{h[r][j]!r} * first_{j}" for j in range(7)) for r in range(3))
    tails = " ".join(f"WHEN n - 1 - i = {6 - r} THEN " + " + ".join(f"{h[r][j]!r} * last_{j}" for j in range(7)) for r in (4, 5, 6))
    near = ", ".join(f"list_extract(xs, CAST(i - 2 + {j} AS INT)) AS x_{j}" for j in range(7))
    first = ", ".join(f"list_extract(xs, {j + 1}) AS first_{j}" for j in range(7))
    last = ", ".join(f"list_extract(xs, CAST(n - 6 + {j} AS INT)) AS last_{j}" for j in range(7))
    return f"""WITH l AS (SELECT game_id, play_id, nfl_id, list(x ORDER BY frame_id) AS xs, count(*) AS n FROM men GROUP BY ALL),
 e AS (SELECT m.game_id, m.play_id, m.frame_id, m.nfl_id, m.x, xs, n, row_number() OVER (PARTITION BY m.play_id, m.nfl_id ORDER BY m.frame_id) - 1 AS i
   FROM men m JOIN l ON m.play_id = l.play_id AND m.nfl_id = l.nfl_id),
 f AS (SELECT *, {near}, {first}, {last} FROM e)
 SELECT game_id, play_id, frame_id, nfl_id, round(CASE {cases} {tails} ELSE {mid} END, 6) AS sx FROM f"""


@query("smoothed_path", _smooth_sql(), "men")
def _(t: Tables):
    s = ts.smooth(t.men.select(*K, "x", "y"), t.player_span(), {"sx": "x", "sy": "y"})
    return s.select(*K, F.round("sx", 6).alias("sx"))


@query("speed_to_acceleration", f"""SELECT game_id, play_id, frame_id, nfl_id, round(CASE WHEN lag(s) OVER w IS NULL OR lead(s) OVER w IS NULL THEN 0
  ELSE abs((lead(s) OVER w - lag(s) OVER w) / 0.2) END + 1e-8, 5) AS accel,
  round(coalesce(abs(s - lag(s) OVER w) * 10, abs(lead(s) OVER w - s) * 10, 0) + 1e-8, 5) AS back FROM men {W}""", "men")
def _(t: Tables):
    m = t.men.select(*K, "t", "s")
    a = ts.acceleration(m, t.player_span())
    b = ts.acceleration(a.withColumnRenamed("accel", "central"), t.player_span(), central=False)
    return b.select(*K, F.round(F.col("central") + 1e-8, 5).alias("accel"), F.round(F.col("accel") + 1e-8, 5).alias("back"))


@query("resampled_path", f"""WITH g AS (SELECT game_id, play_id, nfl_id, frame_id, t, x, y, lead(t) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1
   FROM men WHERE frame_id % 3 > 0 {W}), k AS (SELECT CAST(range AS BIGINT) AS tick FROM range(-20, 100))
 SELECT game_id, play_id, nfl_id, tick, round(tick * 0.08::DOUBLE, 6) AS t, round(CASE WHEN t1 IS NULL THEN x ELSE x + (x1 - x) * ((tick * 0.08::DOUBLE - t) / (t1 - t)) END, 6) AS x,
  round(CASE WHEN t1 IS NULL THEN y ELSE y + (y1 - y) * ((tick * 0.08::DOUBLE - t) / (t1 - t)) END, 6) AS y FROM g JOIN k ON
  tick * 8 >= round(t * 100) AND CASE WHEN t1 IS NULL THEN tick * 8 <= round(t * 100) ELSE tick * 8 < round(t1 * 100) END""", "men")
def _(t: Tables):
    r = ts.resample(t.men.filter("frame_id % 3 > 0").select(*K, "t", "x", "y"), t.player_span(), ["x", "y"], 0.08)
    return r.select(*PLAY, "nfl_id", "tick", "t", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("cubic_path", """WITH g AS (SELECT game_id, play_id, nfl_id, frame_id, x AS p1, lead(x) OVER w AS p2, coalesce(lag(x) OVER w, x) AS p0,
   coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS p3 FROM men WHERE frame_id % 4 = 1 WINDOW w AS (PARTITION BY play_id, nfl_id ORDER BY frame_id)),
 u AS (SELECT CAST(range AS INT) AS part, CAST(range AS DOUBLE) / 4 AS u FROM range(4))
 SELECT game_id, play_id, nfl_id, frame_id, part, round(0.5 * (2 * p1 + (p2 - p0) * u + (2 * p0 - 5 * p1 + 4 * p2 - p3) * u * u
  + (3 * p1 - p0 - 3 * p2 + p3) * u * u * u) + 1e-8, 6) AS x FROM g, u WHERE p2 IS NOT NULL""", "men")
def _(t: Tables):
    c = ts.cubic_path(t.men.filter("frame_id % 4 = 1").select(*K, "t", "x"), t.player_span(), ["x"], 4)
    return c.select(*PLAY, "nfl_id", "frame_id", "part", F.round(F.col("x") + 1e-8, 6).alias("x"))


@query("angle_blend", """SELECT game_id, play_id, frame_id, nfl_id, round((a + d * 0.3 + 360) % 360 + 1e-8, 5) % 360 AS plain, round((a + d * 0.3 * 0.3 * 2.4 + 360) % 360 + 1e-8, 5) % 360 AS eased FROM (
  SELECT game_id, play_id, frame_id, nfl_id, co AS a, CASE WHEN w > 180 THEN w - 360 ELSE w END AS d FROM (SELECT *, (cdir - co + 720) % 360 AS w FROM men) y) z""", "men")
def _(t: Tables):
    u = F.lit(0.3)
    return t.men.select(*K, (F.round(blend_angle(F.col("co"), F.col("cdir"), u) + 1e-8, 5) % 360).alias("plain"),
                        (F.round(blend_angle(F.col("co"), F.col("cdir"), u, smooth=True) + 1e-8, 5) % 360).alias("eased"))


@query("gap_fill", """WITH s AS (SELECT * FROM men WHERE (frame_id + nfl_id) % 5 > 1)
 SELECT g.game_id, g.play_id, g.frame_id, g.nfl_id, s.x IS NOT NULL AS observed, coalesce(last_value(s.x IGNORE NULLS) OVER w,
   first_value(s.x IGNORE NULLS) OVER (PARTITION BY g.play_id, g.nfl_id ORDER BY g.frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS x
 FROM men g LEFT JOIN s ON s.play_id = g.play_id AND s.nfl_id = g.nfl_id AND s.frame_id = g.frame_id WINDOW w AS (PARTITION BY g.play_id, g.nfl_id ORDER BY g.frame_id)""", "men")
def _(t: Tables):
    s = t.men.filter("(frame_id + nfl_id) % 5 > 1")
    return ts.fill_gaps(t.men.select(*K), s, t.player_span(), ["x", "y"]).select(*K, "observed", "x")


@query("last_state", """SELECT m.game_id, m.play_id, m.nfl_id, arg_max(m.frame_id, m.frame_id) AS frame_id, arg_max(x, m.frame_id) AS x, arg_max(y, m.frame_id) AS y FROM men m
  JOIN win w ON m.play_id = w.play_id WHERE m.frame_id <= w.throw AND (m.frame_id + m.nfl_id) % 3 > 0 GROUP BY ALL""", "men", "win")
def _(t: Tables):
    m = t.men.filter("(frame_id + nfl_id) % 3 > 0").select(*K, "x", "y")
    return ts.last_state(m, t.win.select(*PLAY, F.col("throw").alias("at")), PLAY, "nfl_id")


@query("turn_rate", f"""SELECT game_id, play_id, frame_id, nfl_id, round(CASE WHEN d > 180 THEN d - 360 ELSE d END + 1e-7, 4) AS turn,
  round(abs(CASE WHEN d > 180 THEN d - 360 ELSE d END) / 0.1 + 1e-6, 3) AS turn_rate FROM (SELECT *, (co - lag(co) OVER w + 720) % 360 AS d FROM men {W}) z""", "men")
def _(t: Tables):
    r = ts.turn_rate(t.men.select(*K, "t", "co"), t.player_span(), "co")
    return r.select(*K, F.round(F.col("turn") + 1e-7, 4).alias("turn"), F.round(F.col("turn_rate") + 1e-6, 3).alias("turn_rate"))


@query("drive_numbers", """SELECT game_id, play_id, sum(CASE WHEN pt IS NULL OR pt <> possession_team OR (pq <> quarter AND quarter IN (3, 5)) THEN 1 ELSE 0 END)
  OVER (PARTITION BY game_id ORDER BY play_id)::BIGINT AS drive FROM (SELECT *, lag(possession_team) OVER w AS pt, lag(quarter) OVER w AS pq FROM plays
  WINDOW w AS (PARTITION BY game_id ORDER BY play_id)) z""", "plays")
def _(t: Tables):
    return ev.drives(t.plays.select(*PLAY, "possession_team", "quarter"), t.game_span()).select(*PLAY, F.col("drive").cast("bigint").alias("drive"))


FLIGHT_SQL = """WITH s AS (SELECT *, round(sqrt((x - px) ** 2 + (y - py) ** 2) / greatest(t - pt, 1e-6), 9) > 13 AS fast FROM (SELECT *, lag(t) OVER w AS pt,
   lag(x) OVER w AS px, lag(y) OVER w AS py FROM ball WINDOW w AS (PARTITION BY play_id ORDER BY frame_id)) a),
 r AS (SELECT *, sum(CASE WHEN coalesce(fast, false) THEN 0 ELSE 1 END) OVER (PARTITION BY play_id ORDER BY frame_id) AS run FROM s),
 g AS (SELECT game_id, play_id, run, min(pt) AS t0, max(t) AS t1, arg_min(px, t) AS x0, arg_min(py, t) AS y0, arg_max(x, t) AS x1, arg_max(y, t) AS y1
   FROM r WHERE fast GROUP BY ALL),
 b AS (SELECT *, round(t1 - t0, 6) AS seconds, row_number() OVER (PARTITION BY play_id ORDER BY round(t1 - t0, 6) DESC, run) AS rn FROM g)
 SELECT p.game_id, p.play_id, CASE WHEN n < 4 THEN 'too_few_samples' WHEN seconds IS NULL THEN 'never_fast'
   WHEN seconds < 0.3 OR sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) < 6 THEN 'not_a_throw' ELSE 'pass' END AS verdict,
  round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS flight_yards, seconds
 FROM (SELECT game_id, play_id, count(*) AS n FROM ball GROUP BY ALL) p LEFT JOIN (SELECT * FROM b WHERE rn = 1) b2 ON b2.play_id = p.play_id"""


@query("ball_flights", FLIGHT_SQL, "ball")
def _(t: Tables):
    f = ev.ball_flights(t.ball, t.play_span())
    return f.select(*PLAY, "verdict", F.round("flight_yards", 6).alias("flight_yards"), "seconds")


@query("derived_events", """WITH f AS (""" + FLIGHT_SQL.replace("sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS flight_yards, seconds", "sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS flight_yards, t0, t1") + """)
 SELECT b.game_id, b.play_id, b.frame_id, CASE WHEN abs(b.t - t0) < 0.05 THEN 'pass_forward' ELSE 'pass_arrived' END AS events
 FROM ball b JOIN f ON b.play_id = f.play_id WHERE verdict = 'pass' AND (abs(b.t - t0) < 0.05 OR abs(b.t - t1) < 0.05)""", "ball")
def _(t: Tables):
    f = ev.ball_flights(t.ball, t.play_span())
    frames = t.ball.select(*FRAME, "t", F.array().cast("array<string>").alias("events"))
    once = ev.write_events(frames, f)
    twice = ev.write_events(once, f)
    return twice.filter(F.size("events") > 0).select(*FRAME, F.array_join("events", "|").alias("events"))


@query("throw_arcs", """SELECT w.game_id, w.play_id, w.throw AS release, w.arrival, round(d, 6) AS distance, round(greatest(least(0.15 * d, 12), 1), 6) AS peak FROM (
  SELECT w.*, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM win w JOIN ball a ON a.play_id = w.play_id AND a.frame_id = w.throw
  JOIN ball b ON b.play_id = w.play_id AND b.frame_id = w.arrival) w""", "win", "ball")
def _(t: Tables):
    a = ev.throw_arc(t.trk.filter("nfl_id IS NULL").select(*FRAME, "event"), t.ball)
    return a.select(*PLAY, "release", "arrival", F.round("distance", 6).alias("distance"), F.round("peak", 6).alias("peak"))
