"""Scores, reports, roster work, shots."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.fixture import add_base
from snapspan.catalog.registry import Tables, query
from snapspan.catalog.q_fields import BOX_SQL, boxes, matrices
from snapspan.catalog.q_interactions import contacts, held
from snapspan.catalog.q_review import reports
from snapspan.functions.coding import facing
from snapspan.functions.geometry import project
from snapspan.operators import matching as mt, quality as ql, roster as rs, shots as sh
from snapspan.plans.ranking import global_rank, ntile
from snapspan.plans.sequences import Span, span
from snapspan.schema import FRAME, PLAY

K = ["game_id", "play_id", "frame_id", "nfl_id"]
D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"

# Recovered tracks: the truth shifted a little, some frames lost, two players' names crossed late in a play.
add_base("pred", """SELECT game_id, play_id, frame_id, CASE WHEN nfl_id IN (3, 4) AND frame_id > 30 THEN 7 - nfl_id ELSE nfl_id END + 100 AS pred_id,
  x + 0.3::DOUBLE AS x, y + 0.4::DOUBLE AS y, s + 0.5::DOUBLE AS s, cdir, co, CASE WHEN o IS NULL THEN 'from_dir' ELSE 'measured' END AS o_source FROM men WHERE (frame_id + nfl_id * 3) % 11 > 0""", "men")


def recovered(t: Tables):
    swap = F.col("nfl_id").isin(3, 4) & (F.col("frame_id") > 30)
    return t.men.filter("(frame_id + nfl_id * 3) % 11 > 0").select(
        *FRAME, (F.when(swap, 7 - F.col("nfl_id")).otherwise(F.col("nfl_id")) + 100).alias("pred_id"), (F.col("x") + 0.3).alias("x"),
        (F.col("y") + 0.4).alias("y"), (F.col("s") + 0.5).alias("s"), "cdir", "co", facing(F.col("o"), F.col("dir"))[1].alias("o_source"))


def matched(t: Tables):
    m = mt.match_frames(t.men, recovered(t), FRAME, "nfl_id", "pred_id", **ql.pair_errors())
    sp = Span((*PLAY, "truth_id"), ("frame_id",), t.player_span().block)
    return mt.switches(m, sp)


@query("frame_matches")
def _(t: Tables):
    return mt.match_frames(t.men, recovered(t), FRAME, "nfl_id", "pred_id")


@query("tracking_score")
def _(t: Tables):
    return ql.tracking_score(t.men, recovered(t), matched(t))


@query("player_score")
def _(t: Tables):
    return ql.tracking_score(t.men, recovered(t), matched(t), by=[*PLAY, "truth_id"])


@query("condition_summary")
def _(t: Tables):
    s = ql.tracking_score(t.men, recovered(t), matched(t))
    return ql.condition_summary(s.withColumn("condition", F.when(F.col("play_id") % 2 == 0, "ideal").otherwise("shifted")))


@query("identity_switches", """WITH m AS (SELECT m.game_id, m.play_id, m.frame_id, m.nfl_id AS truth_id, p.pred_id FROM men m JOIN pred p ON p.play_id = m.play_id AND p.frame_id = m.frame_id
   AND p.pred_id - 100 = CASE WHEN m.nfl_id IN (3, 4) AND m.frame_id > 30 THEN 7 - m.nfl_id ELSE m.nfl_id END)
 SELECT game_id, play_id, truth_id, sum(CASE WHEN pred_id <> was THEN 1 ELSE 0 END)::BIGINT AS switches FROM (SELECT *, lag(pred_id) OVER (PARTITION BY play_id, truth_id ORDER BY frame_id) AS was FROM m) z GROUP BY ALL""", "men", "pred")
def _(t: Tables):
    # Matches are given by name here, so the count itself is what is compared.
    swap = F.col("nfl_id").isin(3, 4) & (F.col("frame_id") > 30)
    m = t.men.select(*FRAME, F.col("nfl_id").alias("truth_id"), (F.when(swap, 7 - F.col("nfl_id")).otherwise(F.col("nfl_id")) + 100).alias("pred_id"))
    m = m.join(recovered(t).select(*FRAME, "pred_id"), [*FRAME, "pred_id"])
    s = mt.switches(m, Span((*PLAY, "truth_id"), ("frame_id",), t.player_span().block))
    return s.groupBy(*PLAY, "truth_id").agg(F.sum("switch").alias("switches"))


@query("box_claims")
def _(t: Tables):
    pts = t.norm.filter("nfl_id IS NOT NULL").select(*K, (F.col("x") * 10 + 4).alias("px"), (F.col("y") * 10 - 2).alias("py"))
    c = mt.claim_boxes(pts, boxes(t).withColumn("box", F.col("nfl_id")), FRAME, "nfl_id", "box")
    return c.groupBy(*PLAY, "state").agg(F.count(F.lit(1)).alias("n"), F.avg("miss").alias("mean_miss"))


# Chains of four boxes a man: each overlaps the next by more than the limit, and not the one after it.
add_base("stack", """SELECT game_id, play_id, frame_id, nfl_id * 10 + k AS box, nfl_id * 200 + k * 5.0::DOUBLE AS x1, 10.0::DOUBLE AS y1, nfl_id * 200 + k * 5 + 24.0::DOUBLE AS x2, 50.0::DOUBLE AS y2,
  ((nfl_id * 7 + k * (3 + play_id % 4) + frame_id) % 10)::DOUBLE / 10 AS score FROM men, unnest([0, 1, 2, 3]) c(k)""", "men")


def stacked(t: Tables):
    k = t.men.select(*K, F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    x = F.col("nfl_id") * 200 + F.col("k") * 5.0
    return k.select(*FRAME, (F.col("nfl_id") * 10 + F.col("k")).alias("box"), x.alias("x1"), F.lit(10.0).alias("y1"), (x + 24).alias("x2"), F.lit(50.0).alias("y2"),
                    (((F.col("nfl_id") * 7 + F.col("k") * (3 + F.col("play_id") % 4) + F.col("frame_id")) % 10).cast("double") / 10).alias("score"))


@query("overlap_suppression", """WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY play_id, frame_id, box // 10 ORDER BY score DESC, box) AS k FROM stack),
 s AS (SELECT play_id, frame_id, box // 10 AS man, 1 AS k, [x1] AS kept, true AS stays, box FROM b WHERE k = 1
  UNION ALL SELECT s.play_id, s.frame_id, s.man, b.k::INT, CASE WHEN ok THEN list_append(kept, b.x1) ELSE kept END, ok, b.box FROM s JOIN b ON b.play_id = s.play_id AND b.frame_id = s.frame_id AND b.box // 10 = s.man AND b.k = s.k + 1,
   LATERAL (SELECT len(list_filter(kept, lambda o: (24 - abs(o - b.x1)) / (24 + abs(o - b.x1)) >= 0.55)) = 0 AS ok) z)
 SELECT p.game_id, p.play_id, count(*) AS kept, sum(s.box)::BIGINT AS boxes FROM s JOIN plays p ON p.play_id = s.play_id WHERE stays GROUP BY ALL""", "stack", "plays")
def _(t: Tables):
    kept = mt.suppress_overlaps(stacked(t), FRAME, "box")
    return kept.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("kept"), F.sum("box").alias("boxes"))


@query("angle_conventions", """WITH m AS (SELECT *, (degrees(atan2(dy, dx)) + 360) % 360 AS mv FROM (SELECT game_id, play_id, dir, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM men
   WINDOW w AS (PARTITION BY play_id, nfl_id ORDER BY frame_id)) z WHERE sqrt(dx * dx + dy * dy) * 10 > 2),
 e AS (SELECT game_id, play_id, reading, abs(CASE WHEN w > 180 THEN w - 360 ELSE w END) AS err FROM (
   SELECT game_id, play_id, 'compass_cw_from_y' AS reading, (90 - dir - mv + 720) % 360 AS w FROM m UNION ALL SELECT game_id, play_id, 'math_ccw_from_x', (dir - mv + 720) % 360 FROM m
   UNION ALL SELECT game_id, play_id, 'compass_cw_from_x', (-dir - mv + 1080) % 360 FROM m UNION ALL SELECT game_id, play_id, 'ccw_from_y', (dir + 90 - mv + 720) % 360 FROM m) z)
 SELECT game_id, play_id, reading, round(quantile_cont(round(err, 6), 0.5), 3) AS median_error FROM e GROUP BY ALL""", "men")
def _(t: Tables):
    a = ql.angle_conventions(t.men.select(*K, "x", "y", "dir"), t.player_span())
    return a.select(*PLAY, "reading", F.round("median_error", 3).alias("median_error"))


@query("validated_plays", """WITH f AS (SELECT game_id, play_id, count(DISTINCT frame_id) AS frames FROM trk GROUP BY ALL),
 r AS (SELECT * FROM men WHERE (frame_id + nfl_id) % 31 > 0), s AS (SELECT play_id, count(*) AS n, count(*) FILTER (o IS NULL) AS bad FROM r GROUP BY ALL)
 SELECT f.game_id, f.play_id, frames, 22::BIGINT AS people, frames * 22 - n AS missing, 0::BIGINT AS off_field, bad AS bad_angles, e.events,
  CAST(CASE WHEN frames * 22 - n > 0 THEN 1 ELSE 0 END + CASE WHEN bad > 0 THEN 1 ELSE 0 END AS INT) AS problems FROM f JOIN s ON s.play_id = f.play_id
 JOIN (SELECT play_id, count(DISTINCT frame_id) AS events FROM trk WHERE event IS NOT NULL GROUP BY ALL) e ON e.play_id = f.play_id""", "trk", "men")
def _(t: Tables):
    rows = t.men.filter("(frame_id + nfl_id) % 31 > 0").withColumn("o_source", facing(F.col("o"), F.col("dir"))[1])
    v = ql.validate_plays(rows, t.men.select(*PLAY, "nfl_id").distinct(), t.ball.select(*FRAME, "t"), t.play_span(), t.ball, t.trk.select(*FRAME, "event"))
    return v.withColumn("problems", F.size("problems"))


@query("provenance", """SELECT game_id, play_id, count(*) AS samples, count(o) AS measured, round(count(o) / count(*), 6) AS measured_share,
  CASE WHEN count(o) = count(*) THEN 'measured' WHEN count(o) > 0 THEN 'estimated' ELSE 'simulated' END AS source_class FROM men GROUP BY ALL""", "men")
def _(t: Tables):
    p = ql.provenance(t.men.withColumn("o_source", facing(F.col("o"), F.col("dir"))[1]))
    return p.select(*PLAY, "samples", "measured", F.round("measured_share", 6).alias("measured_share"), "source_class")


def sourced_ball(t: Tables):
    src = F.when(F.col("frame_id") % 4 == 0, "coasted").when(F.col("frame_id") % 9 == 0, "carrier").otherwise("detected")
    return t.ball.withColumn("source", src)


@query("ball_statistics", """SELECT game_id, play_id, count(*) AS samples, count(*) FILTER (frame_id % 4 > 0 AND frame_id % 9 > 0) AS detected, count(*) FILTER (frame_id % 4 = 0) AS coasted,
  count(*) FILTER (frame_id % 4 > 0 AND frame_id % 9 = 0) AS carrier, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 5) AS travelled FROM ball GROUP BY ALL""", "ball")
def _(t: Tables):
    return ql.ball_statistics(sourced_ball(t)).select(*PLAY, "samples", "detected", "coasted", "carrier", F.round("travelled", 5).alias("travelled"))


@query("marker_check", """SELECT play_id, stated, round(m, 5) AS measured, round(sc, 5) AS straightness, frames, abs(m - stated) <= 0.5 AND sc <= 0.5 AS ok FROM (
  SELECT play_id, CAST(10 AS DOUBLE) AS stated, quantile_cont(round(abs(fd - los), 6), 0.5) AS m, quantile_cont(round(sc, 6), 0.5) AS sc, count(*) AS frames FROM (SELECT play_id, x AS los,
  x + 10 + (play_id % 5) / 5 + frame_id / 1000 AS fd, CAST(frame_id AS DOUBLE) / 50 AS sc FROM ball) z GROUP BY play_id) y""", "ball")
def _(t: Tables):
    m = t.ball.select("play_id", F.lit(10.0).alias("stated"), F.col("x").alias("los_x"),
                      (F.col("x") + 10 + (F.col("play_id") % 5) / 5 + F.col("frame_id") / 1000).alias("fd_x"), (F.col("frame_id") / 50).alias("scatter"))
    c = ql.marker_check(m, ["play_id"])
    return c.select("play_id", "stated", F.round("measured", 5).alias("measured"), F.round("straightness", 5).alias("straightness"), "frames", "ok")


@query("registration_check", """WITH h AS (SELECT play_id, 12.0::DOUBLE + play_id % 3 AS h0, 0.4::DOUBLE AS h1, 30.0::DOUBLE AS h2, 0.2::DOUBLE AS h3, 11.0::DOUBLE AS h4, 15.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.002::DOUBLE AS h7, 1.0::DOUBLE AS h8 FROM plays),
 e AS (SELECT n.game_id, n.play_id, n.x, n.y, n.nfl_id % 3 = 0 AS off FROM norm n WHERE n.event = 'ball_snap' AND nfl_id IS NOT NULL)
 SELECT game_id, play_id, count(*) AS points, round(sqrt(avg(CASE WHEN off THEN 25.0 ELSE 0 END)), 5) AS rms_px, count(*) FILTER (NOT off) AS inliers, round(max(x) - min(x), 5) AS span_x FROM e GROUP BY ALL""", "plays", "norm")
def _(t: Tables):
    m = matrices(t)
    p = t.norm.filter("event = 'ball_snap' AND nfl_id IS NOT NULL").join(m, PLAY)
    p = p.withColumn("_q", project(F.col("h"), F.col("x"), F.col("y")))
    off = F.when(F.col("nfl_id") % 3 == 0, 1.0).otherwise(0.0)
    pts = p.select(*PLAY, "x", "y", (F.col("_q.x") + 3 * off).alias("px"), (F.col("_q.y") + 4 * off).alias("py"))
    c = ql.registration_check(pts, m, PLAY)
    return c.select(*PLAY, "points", F.round("rms_px", 5).alias("rms_px"), "inliers", F.round("span_x", 5).alias("span_x"))


@query("registration_verdict", """SELECT game_id, play_id, play_id % 4 <> 0 AS trustworthy, TRUE AS finite, TRUE AS convex FROM plays""", "plays")
def _(t: Tables):
    p = t.plays.select(*PLAY, F.array(F.when(F.col("play_id") % 4 == 0, "the field is Folded over").otherwise("a little blurred")).alias("problems"))
    return ql.registration_verdict(p).join(ql.corners_fold(matrices(t), PLAY), PLAY).select(*PLAY, "trustworthy", "finite", "convex")


@query("effective_rate", "SELECT game_id, play_id, count(*) AS n, round((count(*) - 1) / (max(t) - min(t)), 5) AS rate FROM ball GROUP BY ALL", "ball")
def _(t: Tables):
    r = ql.effective_rate(t.ball, PLAY)
    return r.withColumn("rate", F.round("rate", 5))


@query("identity_churn", """SELECT i.game_id, i.play_id, tracks, people, round(tracks / people, 6) AS churn FROM (SELECT game_id, play_id, count(DISTINCT pred_id) AS tracks FROM pred GROUP BY ALL) i
  JOIN (SELECT play_id, quantile_cont(n, 0.5) AS people FROM (SELECT play_id, frame_id, count(*) AS n FROM pred GROUP BY ALL) z GROUP BY ALL) p ON p.play_id = i.play_id""", "pred")
def _(t: Tables):
    c = ql.churn(recovered(t), PLAY, "frame_id", "pred_id")
    return c.withColumn("churn", F.round("churn", 6))


@query("play_qa", """WITH m AS (SELECT m.*, abs(CASE WHEN w > 180 THEN w - 360 ELSE w END) / 0.1 AS rate FROM (SELECT m.*, b.x AS bx, b.y AS b_y, (co - lag(co) OVER (PARTITION BY m.play_id, m.nfl_id ORDER BY m.frame_id) + 720) % 360 AS w
   FROM men m LEFT JOIN ball b ON b.play_id = m.play_id AND b.frame_id = m.frame_id) m),
 g AS (SELECT game_id, play_id, nfl_id, count(*) AS frames, avg(CASE WHEN abs(CASE WHEN v > 180 THEN v - 360 ELSE v END) <= 45 THEN 1.0 ELSE 0 END) AS view_share, max(rate) AS max_turn, avg(CASE WHEN o IS NULL THEN 0.0 ELSE 1 END) AS measured_share
   FROM (SELECT *, (degrees(atan2(b_y - y, bx - x)) - co + 720) % 360 AS v FROM m) z GROUP BY ALL),
 h AS (SELECT a.play_id, a.nfl_id, count(*) AS hits FROM men a JOIN men b ON b.play_id = a.play_id AND b.frame_id = a.frame_id AND b.nfl_id <> a.nfl_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 0.45 GROUP BY ALL),
 p AS (SELECT DISTINCT play_id, holder AS nfl_id FROM held WHERE holder IS NOT NULL)
 SELECT g.game_id, g.play_id, g.nfl_id, frames, round(view_share, 6) AS view_share, round(coalesce(hits, 0) / frames, 6) AS overlap_share, round(measured_share, 6) AS measured_share, p.nfl_id IS NOT NULL AS principal,
  CAST(CASE WHEN p.nfl_id IS NOT NULL AND view_share < 0.25 THEN 1 ELSE 0 END + CASE WHEN p.nfl_id IS NOT NULL AND coalesce(hits, 0) / frames > 0.12 THEN 1 ELSE 0 END + CASE WHEN max_turn > 262.5 THEN 1 ELSE 0 END AS INT) AS fails
 FROM g LEFT JOIN h ON h.play_id = g.play_id AND h.nfl_id = g.nfl_id LEFT JOIN p ON p.play_id = g.play_id AND p.nfl_id = g.nfl_id""", "men", "ball", "held")
def _(t: Tables):
    m = t.men.withColumn("o_source", facing(F.col("o"), F.col("dir"))[1])
    who = held(t).filter("holder IS NOT NULL").select(*PLAY, F.col("holder").alias("nfl_id"))
    q = ql.play_qa(m, t.ball, t.player_span(), who)
    return q.select(*PLAY, "nfl_id", "frames", *[F.round(c, 6).alias(c) for c in ("view_share", "overlap_share", "measured_share")], "principal", F.size("fails").alias("fails"))


@query("review_gate", """WITH b AS (SELECT game_id, play_id, sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS tr, count(*) FILTER (frame_id % 4 > 0 AND frame_id % 9 > 0) / count(*) AS ms FROM ball GROUP BY ALL)
 SELECT game_id, play_id, CASE WHEN tr < 10 THEN 'ball does not move' WHEN ms < 0.25 THEN 'ball seldom seen' WHEN play_id % 3 = 0 THEN 'no throw found' ELSE '' END AS blockers,
  NOT (tr < 10 OR ms < 0.25 OR play_id % 3 = 0) AS reviewable FROM b""", "ball")
def _(t: Tables):
    b = ql.ball_statistics(sourced_ball(t))
    facts = b.select(*PLAY, "travelled", "measured_share", F.lit(True).alias("trustworthy"), F.lit(0.95).alias("side_confidence"), F.lit(0.8).alias("line_confidence"),
                     F.lit("right").alias("attacks"), (F.col("positioned") > 0).alias("has_ball"), (F.col("play_id") % 3 > 0).alias("has_throw"), F.lit(10).alias("yards_to_go"))
    return ql.gate(facts).select(*PLAY, F.array_join("blockers", "|").alias("blockers"), "reviewable")


@query("outcome_check", """WITH r AS (SELECT r.play_id, a_sep - t_sep AS adv, r.decision, CASE WHEN pl.pass_result = 'I' THEN 1.0 ELSE 0.0 END AS inc FROM reports r JOIN plays pl ON pl.play_id = r.play_id WHERE a_sep IS NOT NULL),
 n AS (SELECT *, ntile(4) OVER (ORDER BY round(adv + 1e-9, 2), play_id) AS tile FROM r)
 SELECT round(avg(inc) FILTER (tile = 4), 6) AS top_rate, round(avg(inc) FILTER (tile = 1), 6) AS bottom_rate, round(avg(CASE WHEN decision = 'consider_alternative' THEN 1.0 ELSE 0 END), 6) AS flagged_share,
  round(quantile_cont(round(adv + 1e-9, 2), 0.5), 4) AS median_advantage FROM n""", "reports", "plays")
def _(t: Tables):
    r = reports(t).select("play_id", F.col("evidence.advantage").alias("advantage"), (F.col("decision") == "consider_alternative").alias("flagged"),
                          (F.col("pass_result") == "I").cast("double").alias("incomplete")).filter("advantage IS NOT NULL")
    k = global_rank(r, "advantage", "play_id", "rank", "total")
    o = ql.outcome_check(k.withColumn("tile", ntile(F.col("rank"), F.col("total"), 4)))
    return o.select(*[F.round(c, 6).alias(c) for c in ("top_rate", "bottom_rate", "flagged_share")], F.round("median_advantage", 4).alias("median_advantage"))


@query("roster_dimension", "SELECT game_id, play_id, nfl_id, arg_min(club, frame_id) AS club, arg_min(position, frame_id) AS position, arg_min(jersey, frame_id) AS jersey FROM men GROUP BY ALL", "men")
def _(t: Tables):
    return rs.roster_of(t.trk)


@query("majority_event", """SELECT game_id, play_id, kit FROM (SELECT *, row_number() OVER (PARTITION BY play_id ORDER BY n DESC, f0, kit) AS rn FROM (SELECT game_id, play_id, club || (nfl_id % 3) AS kit, count(*) AS n, min(frame_id) AS f0 FROM men GROUP BY ALL) a) z WHERE rn = 1""", "men")
def _(t: Tables):
    v = t.men.select(*PLAY, "frame_id", F.concat("club", (F.col("nfl_id") % 3).cast("string")).alias("kit"))
    return rs.majority(v, PLAY, "kit", "frame_id")


# Video-like tracks: some short, a third kit, a few doubled a step aside.
def video_tracks(t: Tables):
    m = t.men.select(*FRAME, "t", "nfl_id", F.when(F.col("nfl_id") == 21, "REF").otherwise(F.col("club")).alias("club"), "x", "y")
    m = m.filter((F.col("nfl_id") != 20) | (F.col("frame_id") <= 4))
    # twins stand beside their track row by row: a union would part the plays from their buckets
    own, twin = F.struct("nfl_id", "x"), F.struct((F.col("nfl_id") + 40).alias("nfl_id"), (F.col("x") + 0.3).alias("x"))
    both = F.when(F.col("nfl_id").isin(2, 13) & (F.col("frame_id") % 2 == 0), F.array(own, twin)).otherwise(F.array(own))
    return m.select(*FRAME, "t", "club", "y", F.explode(both).alias("v")).select(*FRAME, "t", "v.nfl_id", "club", "v.x", "y")


add_base("video", """SELECT game_id, play_id, frame_id, nfl_id, CASE WHEN nfl_id = 21 THEN 'REF' ELSE club END AS club, x, y FROM men WHERE nfl_id <> 20 OR frame_id <= 4
  UNION ALL SELECT game_id, play_id, frame_id, nfl_id + 40, club, x + 0.3, y FROM men WHERE nfl_id IN (2, 13) AND frame_id % 2 = 0""", "men")
# No two merges share a track here, so every duplicate pair is a merge.
add_base("fate", f"""WITH l AS (SELECT play_id, nfl_id, club, count(*) AS life FROM video GROUP BY ALL), m AS (SELECT play_id, club FROM (SELECT play_id, club, row_number() OVER (PARTITION BY play_id ORDER BY sum(life) DESC, club) AS rn FROM l GROUP BY play_id, club) z WHERE rn <= 2),
 n AS (SELECT play_id, count(DISTINCT frame_id) AS frames FROM video GROUP BY ALL),
 t AS (SELECT l.*, frames, CASE WHEN m.club IS NULL THEN 'unlabelled' WHEN life < greatest(2, round_even(0.18 * frames, 0)) THEN 'short' END AS early FROM l JOIN n ON n.play_id = l.play_id LEFT JOIN m ON m.play_id = l.play_id AND m.club = l.club),
 v AS (SELECT video.*, life FROM video JOIN t ON t.play_id = video.play_id AND t.nfl_id = video.nfl_id AND early IS NULL),
 d AS (SELECT a.play_id, CASE WHEN a.life >= b.life THEN b.nfl_id ELSE a.nfl_id END AS loser, CASE WHEN a.life >= b.life THEN a.nfl_id ELSE b.nfl_id END AS winner FROM v a JOIN v b ON b.play_id = a.play_id AND b.frame_id = a.frame_id AND b.club = a.club AND a.nfl_id < b.nfl_id
   GROUP BY a.play_id, a.nfl_id, b.nfl_id, a.life, b.life HAVING count(*) >= 4 AND count(*) FILTER ({D} <= 0.9) / count(*) >= 0.6)
 SELECT t.play_id, t.nfl_id, winner, life, frames, CASE WHEN early IS NOT NULL THEN early WHEN loser IS NOT NULL THEN 'merged' WHEN row_number() OVER (PARTITION BY t.play_id, t.club, early IS NULL AND loser IS NULL ORDER BY life DESC, t.nfl_id) > 11 THEN 'surplus' ELSE 'kept' END AS status
 FROM t LEFT JOIN d ON d.play_id = t.play_id AND d.loser = t.nfl_id""", "video")


@query("roster_consolidation", """SELECT p.game_id, p.play_id, count(*) AS before, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'merged') AS merged, count(*) FILTER (status = 'unlabelled') AS unlabelled,
  count(*) FILTER (status = 'short') AS short, round(avg(life / frames) FILTER (status = 'kept'), 6) AS coverage FROM fate JOIN plays p ON p.play_id = fate.play_id GROUP BY ALL""", "fate", "plays")
def _(t: Tables):
    _, rep = rs.consolidate(video_tracks(t))
    return rep.select(*PLAY, "before", "kept", "merged", "unlabelled", "short", F.round("coverage", 6).alias("coverage"))


@query("consolidated_samples", """SELECT game_id, v.play_id, who AS nfl_id, count(DISTINCT frame_id) AS n FROM (SELECT video.*, coalesce(winner, video.nfl_id) AS who FROM video JOIN fate f ON f.play_id = video.play_id AND f.nfl_id = video.nfl_id AND status IN ('kept', 'merged')) v
  SEMI JOIN fate k ON k.play_id = v.play_id AND k.nfl_id = v.who AND k.status = 'kept' GROUP BY ALL""", "video", "fate")
def _(t: Tables):
    v = video_tracks(t)
    tracks, _ = rs.consolidate(v)
    return rs.apply_merges(v, tracks).groupBy(*PLAY, "nfl_id").agg(F.count(F.lit(1)).alias("n"))


def fragments(t: Tables):
    """Tracks cut in three with holes of 0.5 s between the parts."""
    part = F.floor((F.col("frame_id") - 1) / 14)
    m = t.men.filter("(frame_id - 1) % 14 < 10").withColumn("piece", F.col("nfl_id") * 10 + part)
    return m.select(*FRAME, "t", "piece", "x", "y")


@query("stitch_candidates", """WITH f AS (SELECT game_id, play_id, frame_id, t, nfl_id * 10 + CAST(floor((frame_id - 1) / 14) AS BIGINT) AS piece, x, y FROM men WHERE (frame_id - 1) % 14 < 10),
 r AS (SELECT *, row_number() OVER (PARTITION BY play_id, piece ORDER BY t DESC) AS k, count(*) OVER (PARTITION BY play_id, piece) AS n FROM f),
 e AS (SELECT game_id, play_id, piece, max(n) AS n, max(t) AS t1, arg_max(x, t) AS x1, arg_max(y, t) AS y1, min(t) AS t0, arg_min(x, t) AS x0, arg_min(y, t) AS y0,
   arg_min(x, t) FILTER (k <= 4) AS xo, arg_min(y, t) FILTER (k <= 4) AS yo, min(t) FILTER (k <= 4) AS tt FROM r GROUP BY ALL HAVING max(n) >= 2),
 v AS (SELECT *, (x1 - xo) / greatest(t1 - tt, 1e-6) AS vx, (y1 - yo) / greatest(t1 - tt, 1e-6) AS vy FROM e),
 s AS (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) > 11 THEN 11 / sqrt(vx * vx + vy * vy) ELSE 1 END AS k FROM v)
 SELECT game_id, play_id, a, b, gap, round(miss, 5) AS miss FROM (SELECT a.game_id, a.play_id, a.piece AS a, b.piece AS b, round(b.t0 - a.t1, 6) AS gap, sqrt((b.x0 - a.x1 - a.vx * a.k * round(b.t0 - a.t1, 6)) ** 2 + (b.y0 - a.y1 - a.vy * a.k * round(b.t0 - a.t1, 6)) ** 2) AS miss,
   sqrt((b.x0 - a.x1) ** 2 + (b.y0 - a.y1) ** 2) / nullif(round(b.t0 - a.t1, 6), 0) AS need FROM s a JOIN s b ON a.play_id = b.play_id AND a.piece <> b.piece AND round(b.t0 - a.t1, 6) > 0 AND round(b.t0 - a.t1, 6) <= 1.2) z
 WHERE miss <= 3.5 AND need <= 11""", "men")
def _(t: Tables):
    c = rs.stitch_candidates(rs.track_ends(fragments(t), "piece"), "piece")
    return c.select(*PLAY, "a", "b", "gap", F.round("miss", 5).alias("miss"))


@query("stitched_tracks")
def _(t: Tables):
    return rs.stitch(rs.track_ends(fragments(t), "piece"), "piece")


@query("sideline_furniture", """SELECT game_id, play_id, nfl_id FROM (SELECT game_id, play_id, nfl_id, max(x) - min(x) AS w, max(y) - min(y) AS h, min(y) AS lo, max(y) AS hi, count(*) AS n
   FROM (SELECT game_id, play_id, nfl_id, x, y FROM men UNION ALL SELECT game_id, play_id, 900, 40, 0.5 + (play_id % 7) * 0.5 + f / 100 FROM plays, range(12) r(f)) z GROUP BY ALL) z
  WHERE n >= 2 AND sqrt(w * w + h * h) <= 1 AND least(lo, 53.3 - hi) <= 2""", "men", "plays")
def _(t: Tables):
    # A chain crew member stands beside every play, near the line in some.
    crew = t.plays.select(*PLAY, F.lit(900).cast("bigint").alias("nfl_id"), F.lit(40.0).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("f"))
    crew = crew.withColumn("y", 0.5 + (F.col("play_id") % 7) * 0.5 + F.col("f") / 100)
    return rs.static_furniture(t.men.select(*PLAY, "nfl_id", "x", "y").unionByName(crew.drop("f")), "nfl_id")


@query("sideline_cuts")
def _(t: Tables):
    return rs.sideline_cuts(t.men.select(*FRAME, "y"), PLAY, "frame_id", min_crowd=1.0)


@query("static_candidates")
def _(t: Tables):
    still = t.plays.select(*PLAY).withColumn("frame_id", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumns({"x": F.lit(20.0), "y": F.lit(30.0)})
    pts = t.ball.select(*PLAY, F.col("frame_id").cast("int").alias("frame_id"), "x", "y").unionByName(still)
    return rs.static_candidates(pts, PLAY, "frame_id")


@query("hold_out_split", """WITH c AS (SELECT game_id, dense_rank() OVER (ORDER BY game_id) AS r, count(*) AS n FROM plays GROUP BY game_id), m AS (SELECT max(r) AS clips FROM c)
 SELECT game_id, n, CASE WHEN r > clips - greatest(1, round_even(0.2 * clips, 0)) THEN 'val' ELSE 'train' END AS split FROM c, m""", "plays")
def _(t: Tables):
    return rs.hold_out(t.plays.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")), "game_id")


@query("kit_clusters", """SELECT game_id, play_id, nfl_id, CASE WHEN nfl_id % 11 = 0 THEN 'other' WHEN club = 'AWY' THEN 'teamA' ELSE 'teamB' END AS kit, count(*) AS samples,
  abs(max(avg(CASE WHEN nfl_id % 11 > 0 AND club = 'AWY' THEN 1 END)) OVER (PARTITION BY play_id)) > 0 AS apart FROM men GROUP BY game_id, play_id, nfl_id, club""", "men")
def _(t: Tables):
    c = t.men.select(*PLAY, "nfl_id", F.when(F.col("club") == "HOM", 80.0).otherwise(30.0).alias("l"),
                                             F.when(F.col("nfl_id") % 11 == 0, 60.0).otherwise(5.0).alias("a"), (F.col("s") % 3).alias("b"))
    return rs.kit_clusters(c, [*PLAY, "nfl_id"]).select(*PLAY, "nfl_id", "kit", "samples", F.col("separation").between(49.0, 52.0).alias("apart"))


# Frame descriptors from the event stream: 60 events make a clip.
SHOT_BASE = """SELECT CAST(floor(event_id / 600) AS BIGINT) AS clip, CAST(event_id % 600 AS INT) AS frame, value / 500 AS turf, CAST(event_id % 10 AS DOUBLE) / 100 AS motion, 0.9::DOUBLE - (event_id % 4) / 20 AS grid,
  CAST(event_id % 7 AS DOUBLE) / 40 AS blob, 0.5::DOUBLE AS bright, 1.0::DOUBLE + CASE WHEN floor(event_id / 90) % 3 = 0 THEN 20 ELSE 0 END AS h0, 1.0::DOUBLE + CASE WHEN floor(event_id / 90) % 3 = 1 THEN 20 ELSE 0 END AS h1,
  1.0::DOUBLE + CASE WHEN floor(event_id / 90) % 3 = 2 THEN 20 ELSE 0 END AS h2, 1.0::DOUBLE + (event_id % 3) / 10 AS h3 FROM events"""
add_base("descr", SHOT_BASE)
add_base("shots", """WITH j AS (SELECT *, lag(h0) OVER w AS p0, lag(h1) OVER w AS p1, lag(h2) OVER w AS p2, lag(h3) OVER w AS p3 FROM descr WINDOW w AS (PARTITION BY clip ORDER BY frame)),
 d AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN sqrt(greatest(1 - (sqrt(h0 * p0) + sqrt(h1 * p1) + sqrt(h2 * p2) + sqrt(h3 * p3)) / sqrt((h0 + h1 + h2 + h3) * (p0 + p1 + p2 + p3)), 0)) END AS jump FROM j),
 s AS (SELECT *, coalesce(jump >= 0.35, false) AS cut, sum(CASE WHEN p0 IS NULL OR jump >= 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY frame) AS shot FROM d)
 SELECT clip, shot, min(frame) AS start_frame, max(frame) AS end_frame, avg(turf) AS turf, stddev_pop(turf) AS turf_sd, avg(grid) AS grid, avg(blob) AS blob, coalesce(avg(motion) FILTER (p0 IS NOT NULL AND NOT cut), 0) AS motion
 FROM s GROUP BY ALL HAVING max(frame) - min(frame) + 1 >= 8""", "descr")
R = "greatest(least({}, 1), 0)"
SECS = "(end_frame - start_frame + 1) / 30"
PARTS = [R.format("(grid - 0.55) / 0.2"), R.format("(0.45 - blob) / 0.2"), R.format("motion / 0.04"), R.format(f"({SECS} - 2) / 2") + " * " + R.format(f"(60 - {SECS}) / 20")]
add_base("scored", f"SELECT *, {SECS} AS seconds, CASE WHEN least({', '.join(PARTS)}) <= 0 THEN 0 ELSE power({' * '.join(f'({p})' for p in PARTS)}, 0.25) END AS score FROM shots", "shots")


def descriptors(t: Tables):
    return t.spark.sql("SELECT clip, frame, turf, motion, grid, blob, bright, array(h0, h1, h2, h3) AS hist FROM (" + SHOT_BASE.replace("FROM events", "FROM {events}").replace("::DOUBLE", "D") + ")", events=t.raw("events"))


def clip_span(t: Tables):
    """The frames of a clip, in blocks."""
    return span(["clip"], "frame", "floor(frame / 4096)")


@query("shot_segments", "SELECT clip, start_frame, end_frame, round(turf, 6) AS turf, round(turf_sd, 6) AS turf_sd, round(motion, 6) AS motion FROM shots", "shots")
def _(t: Tables):
    s = sh.segment(descriptors(t), clip_span(t))
    return s.select("clip", "start_frame", "end_frame", *[F.round(c, 6).alias(c) for c in ("turf", "turf_sd", "motion")])


@query("shot_scores", "SELECT clip, start_frame, round(seconds, 6) AS seconds, round(score, 6) AS score FROM scored", "scored")
def _(t: Tables):
    s = sh.playlike(sh.segment(descriptors(t), clip_span(t)), 30.0)
    return s.select("clip", "start_frame", F.round("seconds", 6).alias("seconds"), F.round("score", 6).alias("score"))


@query("footage_census", """SELECT count(*) AS shots, round(sum(seconds) / 60, 6) AS minutes, quantile_cont(round(seconds, 6), 0.5) AS median_seconds, count(*) FILTER (score >= 0.35) AS candidates,
  round(coalesce(sum(seconds) FILTER (score >= 0.35), 0) / sum(seconds), 6) AS candidate_share, count(*) FILTER (turf > 0.4) AS on_grass FROM scored""", "scored")
def _(t: Tables):
    c = sh.census(sh.playlike(sh.segment(descriptors(t), clip_span(t)), 30.0))
    return c.withColumns({"minutes": F.round("minutes", 6), "candidate_share": F.round("candidate_share", 6)})


@query("snap_samples", """WITH a AS (SELECT clip, frame, (coalesce(lag(turf, 2) OVER w, 0) + coalesce(lag(turf) OVER w, 0) + turf + coalesce(lead(turf) OVER w, 0) + coalesce(lead(turf, 2) OVER w, 0)) / 5 AS m,
   row_number() OVER w AS k FROM descr WINDOW w AS (PARTITION BY clip ORDER BY frame)),
 d AS (SELECT clip, k, round(lead(m) OVER (PARTITION BY clip ORDER BY frame) - m, 12) AS rise, count(*) OVER (PARTITION BY clip) AS n FROM a)
 SELECT clip, CAST(CASE WHEN n < 12 THEN 0 ELSE k END AS INT) AS snap_sample FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY rise DESC NULLS LAST, k) AS rn FROM d) z WHERE rn = 1""", "descr")
def _(t: Tables):
    return sh.snap_sample(descriptors(t).select("clip", "frame", "turf"), clip_span(t), "turf")


@query("engagement_kinds", "SELECT game_id, kind, count(*) AS n FROM contacts GROUP BY ALL", "contacts")
def _(t: Tables):
    return contacts(t).groupBy("game_id", "kind").agg(F.count(F.lit(1)).alias("n"))
