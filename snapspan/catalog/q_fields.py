"""Projections, filters and scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.registry import Tables, query
from snapspan.functions import coding, geometry as g
from snapspan.functions.angles import compass_flip, turn_deg, wrap_deg
from snapspan.operators import events as ev, projections as pr
from snapspan.schema import CONTRACT_WIDTH, EXPORT_WIDTH, FRAME, O_SOURCES, PLAY

KEYS = "game_id, play_id, frame_id, nfl_id"
K = ["game_id", "play_id", "frame_id", "nfl_id"]
NORM_KEYS = [*K]


@query("mirror_left_plays", f"""SELECT {KEYS}, mirrored, round(x, 6) AS x, round(y, 6) AS y, round(o, 6) AS o,
  round(dir, 6) AS dir FROM norm""", "norm")
def _(t: Tables):
    return t.norm.select(*K, "mirrored", *[F.round(c, 6).alias(c) for c in ("x", "y", "o", "dir")])


@query("mirror_round_trip", """SELECT play_direction, count(*) AS n, round(max(abs(x2 - x)), 6) AS err_x,
  round(max(abs(y2 - y)), 6) AS err_y, 0.0::DOUBLE AS err_dir FROM (
  SELECT t.play_direction, t.x, t.y, CASE WHEN mirrored THEN 120 - n.x ELSE n.x END AS x2,
   CASE WHEN mirrored THEN 53.3 - n.y ELSE n.y END AS y2
  FROM norm n JOIN trk t ON n.play_id = t.play_id AND n.frame_id = t.frame_id AND n.nfl_id = t.nfl_id) z GROUP BY ALL""",
       "trk", "norm")
def _(t: Tables):
    left = F.col("mirrored")
    x, y = g.unmirror(F.col("x"), F.col("y"), left, CONTRACT_WIDTH)
    back = g.release_angle(F.col("cdir"), F.when(left, False).otherwise(False))
    men = t.men.select(*K, x.alias("x2"), y.alias("y2"),
                       F.when(left, F.pmod(back + 180, F.lit(360.0))).otherwise(back).alias("dir2"))
    both = t.trk.join(men, K)
    return both.groupBy("play_direction").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("x2") - F.col("x"))), 6).alias("err_x"),
        F.round(F.max(F.abs(F.col("y2") - F.col("y"))), 6).alias("err_y"),
        F.round(F.max(F.abs(turn_deg(F.col("dir2"), F.col("dir")))), 6).alias("err_dir"))


@query("compass_to_contract", f"""SELECT {KEYS}, round((90 - dir + 720) % 360, 6) AS contract_dir,
  round((90 - o + 720) % 360, 6) AS contract_o FROM trk WHERE nfl_id IS NOT NULL""", "trk")
def _(t: Tables):
    return t.trk.filter(F.col("nfl_id").isNotNull()).select(
        *K, F.round(compass_flip(F.col("dir")), 6).alias("contract_dir"),
        F.round(compass_flip(F.col("o")), 6).alias("contract_o"))


@query("mean_angle_error", """SELECT club, count(*) AS n, round(avg(CASE WHEN w > 180 THEN 360 - w ELSE w END), 6) AS mean_error
  FROM (SELECT club, (o - dir + 720) % 360 AS w FROM trk WHERE o IS NOT NULL) z GROUP BY club""", "trk")
def _(t: Tables):
    return t.trk.filter(F.col("o").isNotNull()).groupBy("club").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(turn_deg(F.col("dir"), F.col("o")))), 6).alias("mean_error"))


@query("snap_clock", """SELECT game_id, play_id, CASE WHEN frame_id < snap THEN 'BEFORE_SNAP' WHEN frame_id = snap THEN 'SNAP'
  ELSE 'AFTER_SNAP' END AS frame_type, count(*) AS n, min(round((frame_id - snap) / 10, 3)) AS first_clock,
  max(round((frame_id - snap) / 10, 3)) AS last_clock FROM (SELECT *, coalesce(min(frame_id) FILTER (event IN
  ('ball_snap', 'autoevent_ballsnap', 'snap_direct')) OVER (PARTITION BY game_id, play_id), min(frame_id) OVER
  (PARTITION BY game_id, play_id)) AS snap FROM trk) z GROUP BY ALL""", "trk")
def _(t: Tables):
    c = ev.snap_clock(t.trk.select(*PLAY, "frame_id", "event"))
    c = c.withColumn("frame_type", coding.frame_type(F.col("frame_id"), F.col("snap")))
    return c.groupBy(*PLAY, "frame_type").agg(F.count(F.lit(1)).alias("n"), F.min("clock").alias("first_clock"),
                                              F.max("clock").alias("last_clock"))


@query("frame_events", """SELECT game_id, play_id, frame_id, string_agg(DISTINCT event, '|' ORDER BY event) AS events FROM trk
  WHERE event IN ('ball_snap', 'handoff', 'lateral', 'pass_forward', 'pass_arrived', 'pass_outcome_caught', 'tackle',
  'touchdown', 'out_of_bounds') GROUP BY ALL""", "trk")
def _(t: Tables):
    return ev.frame_events(t.trk).select(*FRAME, F.array_join("events", "|").alias("events"))


@query("player_keys", """SELECT game_id, play_id, coalesce(CAST(nfl_id AS VARCHAR), 'ball') AS player_key, count(*) AS n
  FROM trk GROUP BY ALL""", "trk")
def _(t: Tables):
    return t.trk.groupBy(*PLAY, coding.player_key(F.col("nfl_id").cast("double")).alias("player_key")).agg(
        F.count(F.lit(1)).alias("n"))


@query("stable_player_ids", """SELECT game_id, play_id, pid, CASE WHEN ok THEN CAST(pid AS BIGINT) ELSE 900000 + rn END AS nfl_number
  FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id, ok ORDER BY pid) AS rn FROM (
   SELECT DISTINCT game_id, play_id, CASE WHEN nfl_id % 3 = 0 THEN concat('t', nfl_id) ELSE CAST(nfl_id AS VARCHAR) END AS pid,
     nfl_id % 3 > 0 AS ok FROM trk WHERE nfl_id IS NOT NULL) a) b""", "trk")
def _(t: Tables):
    pid = F.when(F.col("nfl_id") % 3 == 0, F.concat(F.lit("t"), F.col("nfl_id"))).otherwise(F.col("nfl_id").cast("string"))
    roster = t.trk.filter(F.col("nfl_id").isNotNull()).select(*PLAY, pid.alias("pid")).distinct()
    return pr.stable_ids(roster, "pid")


@query("play_type", """SELECT game_id, play_id, CASE WHEN kneel = 1 THEN 'kneel' WHEN spike = 1 THEN 'spike'
  WHEN res IN ('C', 'I', 'IN') THEN 'pass' WHEN res = 'S' THEN 'sack' WHEN res = 'R' THEN 'scramble' ELSE 'run' END AS play_type,
  upper(description) LIKE '%TOUCHDOWN%' AS touchdown
  FROM (SELECT *, CASE play_id % 6 WHEN 1 THEN 'S' WHEN 2 THEN 'R' WHEN 3 THEN NULL ELSE pass_result END AS res FROM plays) p""", "plays")
def _(t: Tables):
    res = F.when(F.col("play_id") % 6 == 1, "S").when(F.col("play_id") % 6 == 2, "R").when(
        F.col("play_id") % 6 == 3, None).otherwise(F.col("pass_result"))
    return t.plays.select(*PLAY, coding.play_type(F.col("kneel"), F.col("spike"), res).alias("play_type"),
                          coding.is_touchdown(F.col("description")).alias("touchdown"))


@query("scrimmage_lines", """SELECT game_id, play_id, los, least(los + yards_to_go, 110.0::DOUBLE) AS first_down
  FROM (SELECT *, CASE WHEN play_direction = 'left' THEN 120 - yardline ELSE yardline END AS los FROM plays) z""", "plays")
def _(t: Tables):
    los = g.scrimmage_x(F.col("yardline"), g.is_left(F.col("play_direction")))
    return t.plays.select(*PLAY, los.alias("los"), g.first_down_x(los, F.col("yards_to_go")).alias("first_down"))


@query("sides_from_club", """SELECT t.game_id, t.play_id, CASE WHEN club = possession_team THEN 'offense' ELSE 'defense' END AS side,
  count(*) AS n FROM trk t JOIN plays p ON t.play_id = p.play_id WHERE nfl_id IS NOT NULL GROUP BY ALL""", "trk", "plays")
def _(t: Tables):
    men = t.trk.filter(F.col("nfl_id").isNotNull()).groupBy(*PLAY, "club").agg(F.count(F.lit(1)).alias("n"))
    j = men.join(t.plays.select(*PLAY, "possession_team"), PLAY)
    return j.groupBy(*PLAY, coding.side_of(F.col("club"), F.col("possession_team")).alias("side")).agg(F.sum("n").alias("n"))


@query("field_clamp", """SELECT game_id, play_id, count(*) FILTER (inside) AS inside, count(*) FILTER (NOT inside) AS outside,
  round(sum(greatest(least(x2, 100.0::DOUBLE), 20.0::DOUBLE)), 4) AS clamped FROM (
  SELECT game_id, play_id, x2, x2 BETWEEN -2 AND 122 AND y2 BETWEEN -2 AND 55.3 AS inside
  FROM (SELECT *, x * 3 - 110 AS x2, y AS y2 FROM norm) a) z GROUP BY ALL""", "norm")
def _(t: Tables):
    n = t.norm.withColumn("x2", F.col("x") * 3 - 110)
    inside = g.on_field(F.col("x2"), F.col("y"), 2.0)
    return n.groupBy(*PLAY).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"),
                                F.round(F.sum(g.clamp(F.col("x2"), 20.0, 100.0)), 4).alias("clamped"))


@query("training_boxes", """SELECT game_id, play_id, frame_id, CASE WHEN frame_id % 7 = 0 THEN '' ELSE
  printf('0 %.6f %.6f %.6f %.6f', x * 10 / 1277, y * 10 / 719, 24.0 / 1277, 24.0 / 719) END AS line FROM ball""", "ball")
def _(t: Tables):
    lab = t.ball.select(*FRAME, F.when(F.col("frame_id") % 7 != 0, F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"),
                        F.lit(24.0).alias("size"), F.lit(1277.0).alias("width"), F.lit(719.0).alias("height"))
    return pr.training_boxes(lab).select(*FRAME, "line")


@query("reviewable_passes", """SELECT game_id, play_id, pass_result FROM plays WHERE play_id % 7 > 0 AND play_id % 5 > 0
  AND pass_result IN ('C', 'I', 'IN')""", "plays")
def _(t: Tables):
    p = t.plays.withColumns({"simulated": F.col("play_id") % 7 == 0,
                             "source": F.when(F.col("play_id") % 5 == 0, "clip").otherwise("release")})
    return pr.reviewable(p).select(*PLAY, "pass_result")


@query("velocity_parts", f"""SELECT {KEYS}, round(s * sin(radians(dir)), 6) AS vx, round(s * cos(radians(dir)), 6) AS vy,
  round(sin(radians(o)), 6) AS ox, round(cos(radians(o)), 6) AS oy, round(s * sin(radians(dir)) * 0.8::DOUBLE, 6) AS cv_dx,
  round(y - 160.0::DOUBLE / 6, 6) AS y_mid FROM norm WHERE nfl_id IS NOT NULL""", "norm")
def _(t: Tables):
    v = pr.velocity(t.norm.filter(F.col("nfl_id").isNotNull()), 0.8)
    v = v.withColumn("y_mid", F.col("y") - EXPORT_WIDTH / 2)
    return v.select(*K, *[F.round(c, 6).alias(c) for c in ("vx", "vy", "ox", "oy", "cv_dx", "y_mid")])


@query("position_codes", """SELECT position, CASE position WHEN 'QB' THEN 0 WHEN 'RB' THEN 1 WHEN 'FB' THEN 1 WHEN 'WR' THEN 2
  WHEN 'TE' THEN 3 WHEN 'T' THEN 4 WHEN 'G' THEN 4 WHEN 'C' THEN 4 WHEN 'DE' THEN 5 WHEN 'DT' THEN 5 WHEN 'NT' THEN 5
  WHEN 'ILB' THEN 6 WHEN 'CB' THEN 7 WHEN 'FS' THEN 8 ELSE -1 END AS pos, count(*) AS n FROM trk GROUP BY ALL""", "trk")
def _(t: Tables):
    return pr.coded(t.trk.groupBy("position").agg(F.count(F.lit(1)).alias("n"))).select("position", "pos", "n")


@query("forecast_steps", f"""SELECT m.game_id, m.play_id, m.nfl_id, CAST(r.h AS INT) AS horizon, round(s * sin(radians(dir)), 6) AS vx,
  CASE WHEN mirrored THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS code, yardline FROM norm m JOIN win w ON m.play_id = w.play_id AND m.frame_id = w.throw
  JOIN plays p ON p.play_id = m.play_id, range(1, 16) r(h) WHERE m.nfl_id IS NOT NULL AND r.h <= w.h AND m.play_id % 4 > 0""", "norm", "win", "plays")
def _(t: Tables):
    men = t.norm.filter(F.col("nfl_id").isNotNull())
    w = t.win
    state = men.join(w.select(*PLAY, F.col("throw").alias("frame_id")), FRAME).select(*PLAY, "nfl_id", "s", "dir")
    land = F.when(F.col("play_id") % 4 > 0, F.lit(50.0))
    p = t.plays.join(w.select(*PLAY, "h"), PLAY).select(*PLAY, "play_direction", "yardline", F.col("h").alias("frames_output"),
                                                        land.alias("ball_land_x"), F.lit(20.0).alias("ball_land_y"))
    f = pr.forecast_steps(state, p)
    return f.select(*PLAY, "nfl_id", "horizon", F.round("vx", 6).alias("vx"), F.col("play_direction_code").alias("code"), "yardline")


@query("attach_play_state", """SELECT game_id, play_id, CASE WHEN play_id % 3 = 0 THEN CAST(40 + play_id % 7 AS DOUBLE) END AS ball_land_x,
  CASE WHEN play_id % 3 = 0 THEN 'supplied' END AS play_state_source FROM plays""", "plays")
def _(t: Tables):
    sup = t.plays.filter(F.col("play_id") % 3 == 0).select(*PLAY, (40 + F.col("play_id") % 7).cast("double").alias("ball_land_x"))
    return pr.attach_play_state(t.plays.select(*PLAY), sup)


MATRIX = "h AS (SELECT game_id, play_id, 12.0::DOUBLE + play_id % 3 AS h0, 0.4::DOUBLE AS h1, 30.0::DOUBLE AS h2, 0.2::DOUBLE AS h3, 11.0::DOUBLE AS h4, 15.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.002::DOUBLE AS h7, 1.0::DOUBLE AS h8 FROM plays)"


def matrices(t: Tables):
    return t.plays.select(*PLAY, F.array((12.0 + F.col("play_id") % 3).cast("double"), *[F.lit(v) for v in (
        0.4, 30.0, 0.2, 11.0, 15.0, 0.0, 0.002, 1.0)]).alias("h"))


@query("projective_map", f"""WITH {MATRIX} SELECT n.game_id, n.play_id, n.frame_id, n.nfl_id,
  round((h0 * x + h1 * y + h2) / (h6 * x + h7 * y + h8), 6) AS px, round((h3 * x + h4 * y + h5) / (h6 * x + h7 * y + h8), 6) AS py,
  round(x, 6) AS back_x, round(y, 6) AS back_y FROM norm n JOIN h ON n.play_id = h.play_id""", "norm", "plays")
def _(t: Tables):
    j = t.norm.join(matrices(t), PLAY)
    j = j.withColumn("pt", g.project(F.col("h"), F.col("x"), F.col("y")))
    j = j.withColumn("back", g.project(g.invert3(F.col("h")), F.col("pt.x"), F.col("pt.y")))
    return j.select(*K, F.round("pt.x", 6).alias("px"), F.round("pt.y", 6).alias("py"),
                    F.round("back.x", 6).alias("back_x"), F.round("back.y", 6).alias("back_y"))


# Person boxes in pixels, ten to the yard, drawn round every player sample.
BOX_SQL = """SELECT game_id, play_id, frame_id, nfl_id, club, x * 10 - 6 AS x1, y * 10 - 18 AS y1, x * 10 + 6 AS x2, y * 10 AS y2,
  CASE WHEN nfl_id % 4 = 3 THEN 'helmet' ELSE 'body' END AS kind, CAST((nfl_id * 7 + frame_id) % 20 AS DOUBLE) / 20 AS score
  FROM norm WHERE nfl_id IS NOT NULL"""


def boxes(t: Tables):
    return t.norm.filter(F.col("nfl_id").isNotNull()).select(
        *K, "club", (F.col("x") * 10 - 6).alias("x1"), (F.col("y") * 10 - 18).alias("y1"), (F.col("x") * 10 + 6).alias("x2"),
        (F.col("y") * 10).alias("y2"), F.when(F.col("nfl_id") % 4 == 3, "helmet").otherwise("body").alias("kind"),
        (((F.col("nfl_id") * 7 + F.col("frame_id")) % 20).cast("double") / 20).alias("score"))


@query("box_geometry", f"""WITH b AS ({BOX_SQL}) SELECT kind, count(*) AS n, round(avg(x2 - x1), 6) AS w, round(avg(y2 - y1), 6) AS h,
  round(avg(CASE WHEN kind = 'body' THEN y2 ELSE (y1 + y2) / 2 END), 6) AS anchor_y,
  round(avg(greatest(x1 - 600, 0, 600 - x2)), 6) AS gap_x FROM b GROUP BY kind""", "norm")
def _(t: Tables):
    b = g.box_measures(boxes(t))
    gap = g.box_gap(F.lit(600.0), F.col("cy"))
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 6).alias("w"), F.round(F.avg("h"), 6).alias("h"),
                                 F.round(F.avg("anchor_y"), 6).alias("anchor_y"), F.round(F.avg(gap), 6).alias("gap_x"))


@query("nearest_landmark", """SELECT landmark, count(*) AS n FROM (SELECT CASE lx WHEN 10 THEN 'goalA' WHEN 110 THEN 'goalB' WHEN 60 THEN 'y50' ELSE
  concat('y', CAST(50 - abs(lx - 60) AS INT), CASE WHEN lx < 60 THEN 'A' ELSE 'B' END) END || '/' || CASE WHEN y < 53.3 / 2 THEN 'hash_y0' ELSE 'hash_ymax' END AS landmark
  FROM (SELECT CAST(floor(x / 5 + 0.5) * 5 AS INT) AS lx, y FROM norm) a) z GROUP BY landmark""", "norm")
def _(t: Tables):
    marks = g.landmarks(t.spark).filter(F.col("lane").startswith("hash"))
    n = t.norm.select((F.floor(F.col("x") / 5 + 0.5) * 5).cast("double").alias("x"),
                      F.when(F.col("y") < CONTRACT_WIDTH / 2, "hash_y0").otherwise("hash_ymax").alias("lane"))
    # The catalogue is 23 lines by 4 lanes whatever the data, so it is broadcast.
    return n.join(F.broadcast(marks), ["x", "lane"]).groupBy(F.col("landmark_id").alias("landmark")).agg(F.count(F.lit(1)).alias("n"))


@query("facing_policy", """SELECT src AS o_source, count(*) AS n, round(avg(o2), 4) AS mean_o FROM (
  SELECT CASE WHEN o IS NOT NULL THEN 'measured' WHEN d IS NOT NULL THEN 'from_dir' ELSE 'assumed' END AS src,
   CASE WHEN o IS NULL AND d IS NULL THEN 0 ELSE (90 - coalesce(o, d) + 720) % 360 END AS o2
  FROM (SELECT o, CASE WHEN frame_id % 5 > 0 THEN dir END AS d FROM norm WHERE nfl_id IS NOT NULL) a) z GROUP BY src""", "norm")
def _(t: Tables):
    c = pr.to_contract(t.norm.filter(F.col("nfl_id").isNotNull()).withColumn(
        "dir", F.when(F.col("frame_id") % 5 > 0, F.col("dir"))))
    return c.groupBy("o_source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o"), 4).alias("mean_o"))


@query("clean_numbers", """SELECT game_id, play_id, count(*) FILTER (v IS NULL) AS blanks, round(sum(v), 4) AS total FROM (
  SELECT game_id, play_id, CASE WHEN frame_id % 6 = 0 THEN NULL ELSE floor(a) + frame_id END AS v FROM trk) z GROUP BY ALL""", "trk")
def _(t: Tables):
    v = F.when(F.col("frame_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.floor("a").cast("double") + F.col("frame_id"))
    c = t.trk.select(*PLAY, coding.clean(v).alias("v"))
    return c.groupBy(*PLAY).agg(F.count_if(F.col("v").isNull()).alias("blanks"), F.round(F.sum("v"), 4).alias("total"))


@query("timeline_samples", """SELECT o_source, CAST(CASE o_source WHEN 'measured' THEN 0 ELSE 1 END AS DOUBLE) AS code, count(*) AS n,
  CAST(4 AS INT) AS width FROM (SELECT CASE WHEN o IS NULL THEN 'from_dir' ELSE 'measured' END AS o_source FROM norm WHERE nfl_id IS NOT NULL) z GROUP BY ALL""", "norm")
def _(t: Tables):
    c = pr.timeline_row(pr.to_contract(t.norm.filter(F.col("nfl_id").isNotNull())), O_SOURCES)
    return c.groupBy("o_source", F.col("sample")[3].alias("code"), F.size("sample").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("named_target", """SELECT game_id, play_id, named, named = concat('P.Name', substr('abcdefghijk', CAST(1 + (play_id + 3) % 11 AS INT), 1)) AS agrees FROM (
  SELECT *, nullif(replace(regexp_extract(description, '(?:pass|complete|incomplete)[^.]*?\\bto\\s+([A-Z][A-Za-z''.-]*\\.\\s?[A-Z][A-Za-z''-]+)', 1), ' ', ''), '') AS named
  FROM plays) z""", "plays")
def _(t: Tables):
    p = t.plays.withColumn("named", coding.named_target(F.col("description")))
    return p.select(*PLAY, "named", (F.col("named") == F.concat(F.lit("P.Name"), F.expr("substr('abcdefghijk', CAST(1 + (play_id + 3) % 11 AS INT), 1)"))).alias("agrees"))


@query("settings_hash", """SELECT game_id, play_id, substr(sha1(concat('{"week":', week, ',"quarter":', quarter, ',"down":', down, '}')), 1, 12) AS stage_key
  FROM plays""", "plays")
def _(t: Tables):
    return t.plays.select(*PLAY, coding.config_hash(["week", "quarter", "down"]).alias("stage_key"))


@query("context_fill", """SELECT game_id, play_id, CASE WHEN play_id % 3 = 0 OR play_id % 5 = 0 THEN description ELSE priority END AS text FROM plays""", "plays")
def _(t: Tables):
    p = t.plays.withColumn("given", F.when(F.col("play_id") % 3 == 0, F.lit("")).when(F.col("play_id") % 5 == 0, None).otherwise(F.col("priority")))
    return p.select(*PLAY, coding.blank_to(F.col("given"), F.col("description")).alias("text"))
