"""Review of throws and runs, sides and roles, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.fixture import add_base
from snapspan.catalog.q_pairs import full_name
from snapspan.catalog.registry import Tables, query
from snapspan.functions import coding
from snapspan.operators import events as ev, forecast as fc, review as rv, sides as sd
from snapspan.schema import FORECAST_FEATURES, FRAME, PLAY

W3 = "160.0::DOUBLE / 3"
# Facing right in the export width.
add_base("wide", f"""SELECT game_id, play_id, frame_id, nfl_id, club, position, event, play_direction = 'left' AS mirrored, s, a,
  CASE WHEN play_direction = 'left' THEN 120 - x ELSE x END AS x, CASE WHEN play_direction = 'left' THEN {W3} - y ELSE y END AS y,
  CASE WHEN play_direction = 'left' THEN (o + 180) % 360 ELSE o END AS o, CASE WHEN play_direction = 'left' THEN (dir + 180) % 360 ELSE dir END AS dir
  FROM trk WHERE nfl_id IS NOT NULL""", "trk")
add_base("samples", f"""SELECT *, x - los AS x_rel, y - {W3} / 2 AS y_mid, x_arr - x AS tx, y_arr - y AS ty, vx * h / 10 AS cv_dx, vy * h / 10 AS cv_dy FROM (
  SELECT s.game_id, s.play_id, s.nfl_id, s.club, s.position, s.mirrored, s.x, s.y, s.s, s.a, s.o, s.dir, w.h, w.throw, w.arrival, e.x AS x_arr, e.y AS y_arr,
   s.s * sin(radians(s.dir)) AS vx, s.s * cos(radians(s.dir)) AS vy, sin(radians(s.o)) AS ox, cos(radians(s.o)) AS oy,
   coalesce(s.x - b5.x, s.s * sin(radians(s.dir)) * 5 / 10) AS dx5, coalesce(s.y - b5.y, s.s * cos(radians(s.dir)) * 5 / 10) AS dy5,
   coalesce(s.x - b10.x, s.s * sin(radians(s.dir)) * 10 / 10) AS dx10, coalesce(s.y - b10.y, s.s * cos(radians(s.dir)) * 10 / 10) AS dy10,
   CASE WHEN s.club = 'HOM' THEN 1 ELSE 0 END AS offense, CASE WHEN s.mirrored THEN 120 - p.yardline ELSE p.yardline END AS los, p.week,
   CASE WHEN s.position IN ('RB', 'TE', 'WR') THEN 1 ELSE 0 END AS route, CASE WHEN s.club = 'HOM' AND s.nfl_id = (s.play_id + 3) % 11 THEN 1 ELSE 0 END AS target
  FROM wide s JOIN win w ON s.play_id = w.play_id AND s.frame_id = w.throw JOIN plays p ON p.play_id = s.play_id
  LEFT JOIN wide e ON e.play_id = s.play_id AND e.nfl_id = s.nfl_id AND e.frame_id = w.arrival
  LEFT JOIN wide b5 ON b5.play_id = s.play_id AND b5.nfl_id = s.nfl_id AND b5.frame_id = w.throw - 5
  LEFT JOIN wide b10 ON b10.play_id = s.play_id AND b10.nfl_id = s.nfl_id AND b10.frame_id = w.throw - 10) z""", "wide", "win", "plays")
SEP = "min(sqrt((o.px - d.px) * (o.px - d.px) + (o.py - d.py) * (o.py - d.py)))"
add_base("reports", f"""WITH p AS (SELECT *, x + cv_dx AS px, y + cv_dy AS py FROM samples),
 sep AS (SELECT o.game_id, o.play_id, o.nfl_id, o.position, o.route, o.target, o.px, o.los, {SEP} AS sep,
   min(sqrt((o.x_arr - d.x_arr) * (o.x_arr - d.x_arr) + (o.y_arr - d.y_arr) * (o.y_arr - d.y_arr))) AS real
   FROM p o JOIN p d ON o.play_id = d.play_id AND d.offense = 0 WHERE o.offense = 1 GROUP BY ALL),
 t AS (SELECT game_id, play_id, arg_min(nfl_id, nfl_id) AS target_id, arg_min(sep, nfl_id) AS t_sep, arg_min(real, nfl_id) AS t_real FROM sep WHERE target = 1 GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY play_id ORDER BY sep DESC, nfl_id) AS rn, count(*) OVER (PARTITION BY play_id) AS alts FROM sep
   WHERE route = 1 AND target = 0 AND position <> 'QB' AND px >= los)
 SELECT t.game_id, t.play_id, target_id, t_sep, t_real, b.nfl_id AS alternative_id, b.sep AS a_sep, b.real AS a_real, coalesce(alts, 0) AS alternatives, pl.down,
  CASE WHEN greatest(t_sep, b.sep) < 3 THEN CASE WHEN pl.down = 4 THEN 'suggest_punt' ELSE 'suggest_run_play' END
   WHEN b.sep - t_sep >= 5 THEN 'consider_alternative' ELSE 'target_was_reasonable' END AS decision
 FROM t LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON b.play_id = t.play_id JOIN plays pl ON pl.play_id = t.play_id""", "samples", "plays")


def routes(t: Tables):
    """Route and target flags of the offense, from its positions."""
    at_throw = t.men.join(t.win.select(*PLAY, "throw"), PLAY).filter("club = 'HOM' AND frame_id = throw")
    return at_throw.select(
        *PLAY, "nfl_id", F.col("position").isin("RB", "TE", "WR").cast("int").alias("route"),
        (F.col("nfl_id") == (F.col("play_id") + 3) % 11).cast("int").alias("target"))


def samples(t: Tables):
    # The offense of the derived tracking is always HOM.
    return rv.forecast_samples(t.trk, t.win, t.plays.withColumn("possession_team", F.lit("HOM")), routes(t))


def reports(t: Tables):
    return rv.review_passes(rv.keep_speed(samples(t)), t.plays)


@query("pass_review", """SELECT game_id, play_id, decision, target_id, alternative_id, round(t_sep, 4) AS target_sep, round(a_sep, 4) AS alternative_sep,
  round(t_real, 4) AS target_real, alternatives, CASE WHEN alternatives >= 2 THEN 'moderate' ELSE 'low' END AS confidence,
  CASE decision WHEN 'consider_alternative' THEN 0.75::DOUBLE WHEN 'target_was_reasonable' THEN 0.28::DOUBLE END AS p_alternative FROM reports""".replace(", 4)", " + 1e-9, 2)"), "reports")
def _(t: Tables):
    e = F.col("evidence")
    return reports(t).select(*PLAY, "decision", e.target_id.alias("target_id"), e.alternative_id.alias("alternative_id"),
                             e.target_separation.alias("target_sep"), e.alternative_separation.alias("alternative_sep"),
                             e.target_actual_separation.alias("target_real"), e.alternatives.alias("alternatives"), "confidence",
                             F.try_element_at("probabilities", F.lit("consider_alternative")).alias("p_alternative"))


@query("forecast_samples", "SELECT game_id, play_id, nfl_id, week, offense, route, target, h, " + ", ".join(
    f"round({c}, 5) AS {c}" for c in ("x_rel", "y_mid", "vx", "ox", "oy", "dx5", "dy5", "dx10", "dy10", "cv_dx", "cv_dy", "tx", "ty")) + " FROM samples", "samples")
def _(t: Tables):
    return samples(t).select(*PLAY, "nfl_id", "week", "offense", "route", "target", "h", *[F.round(c, 5).alias(c) for c in (
        "x_rel", "y_mid", "vx", "ox", "oy", "dx5", "dy5", "dx10", "dy10", "cv_dx", "cv_dy", "tx", "ty")])


@query("baseline_errors", """WITH e AS (SELECT 'keep_speed' AS way, sqrt((tx - cv_dx) ** 2 + (ty - cv_dy) ** 2) AS e FROM samples WHERE tx IS NOT NULL
  UNION ALL SELECT 'stand_still', sqrt(tx * tx + ty * ty) FROM samples WHERE tx IS NOT NULL)
 SELECT way, count(*) AS n, round(avg(e), 5) AS mean, round(quantile_cont(round(e, 6), 0.5), 5) AS median, round(quantile_cont(round(e, 6), 0.9), 5) AS p90 FROM e GROUP BY way""", "samples")
def _(t: Tables):
    e = rv.error_table(rv.keep_speed(samples(t))).filter("way <> 'model'")
    return e.select("way", "n", *[F.round(c, 5).alias(c) for c in ("mean", "median", "p90")])


@query("cross_fit_errors")
def _(t: Tables):
    fitted = fc.cross_fit(samples(t))
    return rv.error_table(fitted)


@query("forecast_order", "SELECT TRUE AS model_beats_keep_speed, TRUE AS keep_speed_beats_stand_still, (SELECT count(*) FROM samples WHERE tx IS NOT NULL) AS n", "samples")
def _(t: Tables):
    e = rv.error_table(fc.cross_fit(samples(t)))
    of = lambda way: F.max(F.when(F.col("way") == way, F.col("mean")))
    return e.agg((of("model") < of("keep_speed")).alias("model_beats_keep_speed"), (of("keep_speed") < of("stand_still")).alias("keep_speed_beats_stand_still"), F.max("n").alias("n"))


@query("run_review", """SELECT game_id, play_id, 'suggest_pass_next_time' AS decision, format('The run gained {} yards on {} and {}, short of what the down needed.', yards_gained, down, yards_to_go) AS reason
  FROM plays WHERE NOT is_dropback AND kneel = 0 AND coalesce(spike, 0) = 0 AND (yards_gained <= 0 OR (down >= 3 AND yards_gained < yards_to_go))""", "plays")
def _(t: Tables):
    return rv.review_runs(t.plays).select(*PLAY, "decision", "reason")


@query("decision_counts", """SELECT game_id, decision, count(*) AS n FROM (SELECT game_id, decision FROM reports UNION ALL SELECT game_id, 'suggest_pass_next_time' FROM plays
  WHERE NOT is_dropback AND kneel = 0 AND coalesce(spike, 0) = 0 AND (yards_gained <= 0 OR (down >= 3 AND yards_gained < yards_to_go))) z GROUP BY ALL""", "reports", "plays")
def _(t: Tables):
    return rv.all_reviews(reports(t), rv.review_runs(t.plays)).groupBy("game_id", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("top_reviews", """SELECT game_id, play_id, decision, round(a_sep - t_sep + 1e-9, 2) AS advantage FROM reports ORDER BY coalesce(round(a_sep - t_sep + 1e-9, 2), -1) DESC, game_id, play_id LIMIT 20""", "reports")
def _(t: Tables):
    return rv.top_reviews(reports(t), 20).select(*PLAY, "decision", F.col("evidence.advantage").alias("advantage"))


@query("flat_reports", """SELECT game_id, play_id, decision, target_id, alternatives, 5.0::DOUBLE AS advantage_threshold_yards, 22::BIGINT AS tracked_players FROM reports""", "reports")
def _(t: Tables):
    return rv.flat_reports(reports(t)).select(*PLAY, "decision", "target_id", "alternatives", "advantage_threshold_yards", "tracked_players")


@query("recommendations", """SELECT game_id, play_id, CASE decision WHEN 'consider_alternative' THEN 'pass' WHEN 'target_was_reasonable' THEN 'unchanged'
  WHEN 'suggest_run_play' THEN 'run' ELSE 'punt' END AS call_type, 6 AS assumptions, TRUE AS ok FROM reports""", "reports")
def _(t: Tables):
    r = rv.recommendation_problems(rv.recommendations(reports(t)))
    return r.select(*PLAY, F.col("call.call_type").alias("call_type"), F.size("assumptions").alias("assumptions"), "ok")


@query("step_decisions", """WITH s AS (SELECT *, x + vx * h / 10 AS px, y + vy * h / 10 AS py, CASE WHEN club = 'AWY' THEN 'Defensive Coverage' WHEN target = 1 THEN 'Targeted Receiver'
   WHEN route = 1 THEN 'Other Route Runner' ELSE 'Passer' END AS role FROM samples),
 p AS (SELECT o.game_id, o.play_id, o.nfl_id, o.role, min(sqrt((o.px - d.px) ** 2 + (o.py - d.py) ** 2)) AS sep FROM s o JOIN s d ON d.play_id = o.play_id AND d.role = 'Defensive Coverage'
   WHERE o.role IN ('Targeted Receiver', 'Other Route Runner') AND o.position <> 'QB' GROUP BY ALL),
 g AS (SELECT game_id, play_id, max(sep) FILTER (role = 'Targeted Receiver') AS t, max(sep) FILTER (role = 'Other Route Runner') AS a FROM p GROUP BY ALL)
 SELECT g.game_id, g.play_id, CASE WHEN greatest(t, a) < 3 THEN CASE WHEN down = 4 THEN 'suggest_punt' ELSE 'suggest_run_play' END WHEN a - t >= 1.5 THEN 'consider_alternative'
  ELSE 'target_was_reasonable' END AS decision, round(t, 4) AS target_sep, round(a, 4) AS alt_sep FROM g JOIN plays pl ON pl.play_id = g.play_id WHERE t IS NOT NULL""", "samples", "plays")
def _(t: Tables):
    s = samples(t)
    role = (F.when(F.col("club") == "AWY", "Defensive Coverage").when(F.col("target") == 1, "Targeted Receiver")
            .when(F.col("route") == 1, "Other Route Runner").otherwise("Passer"))
    steps = s.withColumn("role", role).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("h"))))
    steps = steps.withColumns({"pred_x": F.col("x") + F.col("vx") * F.col("step") / 10, "pred_y": F.col("y") + F.col("vy") * F.col("step") / 10})
    d = rv.step_decisions(steps, t.plays)
    return d.select(*PLAY, "decision", F.round("target_sep", 4).alias("target_sep"), F.round("alt_sep", 4).alias("alt_sep"))


@query("suggested_replay", """WITH p AS (SELECT *, x + cv_dx AS px, y + cv_dy AS py FROM samples), k AS (SELECT p.*, CAST(range AS INT) AS step FROM p JOIN range(1, 30) ON range <= h),
 c AS (SELECT *, x + vx * step / 10 + (px - x - vx * (h / 10)) * ((step / 10) / (h / 10)) * ((step / 10) / (h / 10)) AS cx FROM k)
 SELECT game_id, play_id, record_type, count(*) AS n, round(sum(x), 3) AS sx FROM (
  SELECT t.game_id, t.play_id, CASE WHEN t.nfl_id IS NULL THEN 'recorded' ELSE 'observed_player' END AS record_type, round(t.x, 6) AS x FROM trk t JOIN win w ON t.play_id = w.play_id
    AND t.frame_id <= w.throw JOIN reports r ON r.play_id = t.play_id
  UNION ALL SELECT c.game_id, c.play_id, 'simulated_player', round(CASE WHEN mirrored THEN 120 - cx ELSE cx END, 6) FROM c JOIN reports r ON r.play_id = c.play_id
  UNION ALL SELECT c.game_id, c.play_id, 'simulated_straight_line', round(bx + (CASE WHEN mirrored THEN 120 - px ELSE px END - bx) * (step / h), 6) FROM c
    JOIN reports r ON r.play_id = c.play_id AND c.nfl_id = CASE WHEN r.decision = 'consider_alternative' THEN r.alternative_id ELSE r.target_id END
    JOIN (SELECT play_id, frame_id, round(x, 6) AS bx FROM trk WHERE nfl_id IS NULL) b ON b.play_id = c.play_id AND b.frame_id = c.throw) z GROUP BY ALL""", "samples", "reports", "win", "trk")
def _(t: Tables):
    p = rv.keep_speed(samples(t))
    f = rv.suggested_frames(t.trk, t.win, p, rv.review_passes(p, t.plays), digits=6)
    return f.groupBy(*PLAY, "record_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("sx"))


@query("continued_plays", """SELECT game_id, play_id, simulated, count(*) AS n FROM (SELECT m.game_id, m.play_id, false AS simulated FROM men m JOIN win w ON m.play_id = w.play_id AND m.frame_id < w.throw
  UNION ALL SELECT s.game_id, s.play_id, true FROM samples s JOIN range(0, 30) ON range <= s.h) z GROUP BY ALL""", "men", "win", "samples")
def _(t: Tables):
    s = samples(t).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("h"))))
    f = s.select(*PLAY, (F.col("throw") + F.col("step")).alias("frame_id"), "nfl_id", "x", "y")
    c = rv.continue_play(t.men.select(*FRAME, "nfl_id", "x", "y"), f, t.win.select(*PLAY, F.col("throw").alias("at")))
    return c.groupBy(*PLAY, "simulated").agg(F.count(F.lit(1)).alias("n"))


@query("inferred_direction", """SELECT game_id, play_id, CASE WHEN play_id % 2 = 0 THEN dirn ELSE CASE WHEN dx >= 0 THEN 'right' ELSE 'left' END END AS direction,
  CASE WHEN play_id % 2 = 0 THEN 1.0::DOUBLE ELSE round(least(abs(dx) / 10, 1), 6) END AS confidence, CASE WHEN play_id % 2 = 0 THEN 'column' ELSE 'ball_displacement' END AS source
  FROM (SELECT game_id, play_id, min(play_direction) AS dirn, arg_max(x, frame_id) - arg_min(x, frame_id) AS dx FROM trk WHERE nfl_id IS NULL GROUP BY ALL) z""", "trk")
def _(t: Tables):
    r = t.trk.withColumn("play_direction", F.when(F.col("play_id") % 2 == 0, F.col("play_direction")))
    return sd.play_direction(r).withColumn("confidence", F.round("confidence", 6))


LINES = "CASE WHEN play_direction = 'left' THEN 120 - yardline ELSE yardline END"


@query("resolved_sides", f"""WITH s AS (SELECT m.* FROM men m WHERE event = 'ball_snap'),
 l AS (SELECT s.game_id, s.play_id, club, avg(x - los) AS m FROM s JOIN (SELECT play_id, {LINES} AS los FROM plays WHERE play_id % 3 = 0) p ON p.play_id = s.play_id GROUP BY ALL),
 lg AS (SELECT game_id, play_id, arg_min(club, m) AS offense, min(m) < 0 AND max(m) > 0 AS apart FROM l GROUP BY ALL),
 c AS (SELECT s.game_id, s.play_id, arg_min(club, sqrt((s.x - b.x) ** 2 + (s.y - b.y) ** 2) * 1000 + s.nfl_id / 1e6) AS offense, min(sqrt((s.x - b.x) ** 2 + (s.y - b.y) ** 2)) AS d
   FROM s JOIN ball b ON b.play_id = s.play_id AND b.frame_id = s.frame_id WHERE s.play_id % 5 > 0 GROUP BY ALL),
 q AS (SELECT m.game_id, m.play_id, club, avg(m.s) AS m FROM men m JOIN (SELECT play_id, min(frame_id) AS snap FROM s GROUP BY ALL) w ON w.play_id = m.play_id AND m.frame_id < snap AND m.frame_id >= snap - 10 GROUP BY ALL),
 qg AS (SELECT game_id, play_id, min_by(club, m * 1e6 + CASE club WHEN 'AWY' THEN 0 ELSE 1e-3 END) AS offense FROM q GROUP BY ALL)
 SELECT p.game_id, p.play_id, coalesce(lg.offense, c.offense, qg.offense) AS offense, CASE coalesce(lg.offense, c.offense, qg.offense) WHEN 'HOM' THEN 'AWY' ELSE 'HOM' END AS defense,
  CASE WHEN apart THEN 'behind_the_los' WHEN lg.offense IS NOT NULL THEN 'behind_the_los_unseparated' WHEN c.offense IS NOT NULL THEN 'ball_at_snap' ELSE 'presnap_stillness' END AS method,
  CASE WHEN apart THEN 0.95::DOUBLE WHEN lg.offense IS NOT NULL THEN 0.5 WHEN c.offense IS NOT NULL THEN 0.987 ELSE 0.812 END AS confidence
 FROM plays p LEFT JOIN lg ON lg.play_id = p.play_id LEFT JOIN (SELECT * FROM c WHERE d <= 2) c ON c.play_id = p.play_id LEFT JOIN qg ON qg.play_id = p.play_id""", "men", "ball", "plays")
def _(t: Tables):
    los = F.when(F.col("play_direction") == "left", 120 - F.col("yardline")).otherwise(F.col("yardline"))
    lines = t.plays.filter("play_id % 3 = 0").select(*PLAY, los.alias("los"), F.lit("right").alias("attacks"))
    snaps = ev.snap_frames(t.trk)
    return sd.resolve_sides(t.men, t.ball.filter("play_id % 5 > 0"), snaps, lines=lines)


@query("formation_line", """WITH s AS (SELECT * FROM men WHERE event = 'ball_snap'), g AS (SELECT game_id, play_id, quantile_cont(x, 0.5) FILTER (club = 'HOM') AS mo, quantile_cont(x, 0.5) FILTER (club = 'AWY') AS md,
   quantile_cont(x, 0.9) FILTER (club = 'HOM') AS o9, quantile_cont(x, 0.1) FILTER (club = 'HOM') AS o1, quantile_cont(x, 0.9) FILTER (club = 'AWY') AS d9, quantile_cont(x, 0.1) FILTER (club = 'AWY') AS d1 FROM s GROUP BY ALL),
 f AS (SELECT *, md > mo AS r, CASE WHEN md > mo THEN o9 ELSE o1 END AS fo, CASE WHEN md > mo THEN d1 ELSE d9 END AS fd FROM g)
 SELECT game_id, play_id, round((fo + fd) / 2, 5) AS los, CASE WHEN r THEN 'right' ELSE 'left' END AS attacks, round(abs(fd - fo), 5) AS gap,
  CASE WHEN abs(fd - fo) > 8 OR (r AND fd < fo) OR (NOT r AND fd > fo) THEN 0.3::DOUBLE WHEN abs(fd - fo) <= 4 THEN 0.8 ELSE 0.6 END AS confidence FROM f""", "men")
def _(t: Tables):
    snap = t.men.filter("event = 'ball_snap'").withColumn("side", F.when(F.col("club") == "HOM", "offense").otherwise("defense"))
    f = sd.formation_line(snap)
    return f.select(*PLAY, F.round("los", 5).alias("los"), "attacks", F.round("gap", 5).alias("gap"), "confidence")


def told(t: Tables):
    return t.plays.select(*PLAY, F.lit("HOM").alias("offense"))


ROLES = """WITH near AS (SELECT m.*, row_number() OVER (PARTITION BY m.play_id, m.frame_id, m.position IN ('T', 'G', 'C') ORDER BY sqrt((m.x - b.x) * (m.x - b.x) + (m.y - b.y) * (m.y - b.y)), m.nfl_id) AS rn
   FROM men m JOIN ball b ON b.play_id = m.play_id AND b.frame_id = m.frame_id WHERE club = 'HOM' AND m.event = 'pass_forward'),
 ps AS (SELECT play_id, nfl_id AS passer FROM near WHERE rn = 1 AND position NOT IN ('T', 'G', 'C')),
 tg AS (SELECT play_id, nfl_id AS target FROM (SELECT m.*, row_number() OVER (PARTITION BY m.play_id ORDER BY sqrt((m.x - b.x) * (m.x - b.x) + (m.y - b.y) * (m.y - b.y)), m.nfl_id) AS rn FROM men m
   JOIN ball b ON b.play_id = m.play_id AND b.frame_id = m.frame_id JOIN ps ON ps.play_id = m.play_id WHERE m.event = 'pass_arrived' AND position IN ('WR', 'TE', 'RB') AND nfl_id <> passer) z WHERE rn = 1),
 ro AS (SELECT DISTINCT game_id, play_id, nfl_id, club, position FROM men)
 SELECT ro.game_id, ro.play_id, ro.nfl_id, CASE WHEN club = 'AWY' THEN 'Defensive Coverage' WHEN nfl_id = passer THEN 'Passer' WHEN nfl_id = target THEN 'Targeted Receiver'
  WHEN position IN ('WR', 'TE', 'RB') THEN 'Other Route Runner' END AS role FROM ro LEFT JOIN ps ON ps.play_id = ro.play_id LEFT JOIN tg ON tg.play_id = ro.play_id"""


@query("inferred_roles", ROLES, "men", "ball")
def _(t: Tables):
    return sd.infer_roles(t.men, t.ball, t.trk.filter("nfl_id IS NULL"), told(t)).select(*PLAY, "nfl_id", "role")


@query("role_accuracy", f"""WITH r AS ({ROLES}), j AS (SELECT p.play_id, r.nfl_id, r.nfl_id = CASE WHEN p.play_id % 4 = 0 THEN (p.play_id + 4) % 11 ELSE (p.play_id + 3) % 11 END AS hit FROM plays p
   LEFT JOIN r ON r.play_id = p.play_id AND r.role = 'Targeted Receiver')
 SELECT count(*) AS plays, count(*) FILTER (nfl_id IS NULL) AS no_target, 0::BIGINT AS unnamed, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
  round(count(*) FILTER (hit) / count(*) FILTER (nfl_id IS NOT NULL), 3) AS hit_rate FROM j""", "men", "ball", "plays")
def _(t: Tables):
    roles = sd.infer_roles(t.men, t.ball, t.trk.filter("nfl_id IS NULL"), told(t))
    named = t.plays.withColumn("named", coding.named_target(F.col("description")))
    hit = coding.name_matches(F.col("named"), full_name())
    return sd.role_accuracy(roles, named, hit)


@query("feature_list_check", "SELECT count(*) AS n, 21::BIGINT AS columns FROM samples", "samples")
def _(t: Tables):
    s = samples(t).select(*FORECAST_FEATURES)
    return s.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(len(s.columns)).cast("bigint"))
