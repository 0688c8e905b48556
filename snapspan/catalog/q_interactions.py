"""Possession, contact, evasion and view."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.fixture import add_base
from snapspan.catalog.registry import Tables, query
from snapspan.functions.coding import facing
from snapspan.operators import interactions as ia
from snapspan.plans.what_happened import derive
from snapspan.schema import FRAME, PLAY

D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"

add_base("held", f"""SELECT game_id, play_id, frame_id, t, CASE WHEN d <= 1.6 THEN nfl_id END AS holder FROM (
  SELECT a.game_id, a.play_id, a.frame_id, a.t, a.nfl_id, {D} AS d, row_number() OVER (PARTITION BY a.play_id, a.frame_id ORDER BY {D}, a.nfl_id) AS rn
  FROM men a JOIN ball b ON a.play_id = b.play_id AND a.frame_id = b.frame_id) z WHERE rn = 1""", "men", "ball")
add_base("contacts", f"""WITH near AS (SELECT a.game_id, a.play_id, a.frame_id, a.nfl_id AS a, b.nfl_id AS b, a.s AS a_s, b.s AS b_s, {D} AS d, h.holder
   FROM men a JOIN men b ON a.play_id = b.play_id AND a.frame_id = b.frame_id AND a.nfl_id < b.nfl_id AND a.club <> b.club
   JOIN held h ON h.play_id = a.play_id AND h.frame_id = a.frame_id WHERE {D} <= 2.2),
 c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 5 THEN 1 ELSE 0 END) OVER w AS chain FROM (SELECT *, frame_id - lag(frame_id) OVER w AS gap FROM near
   WINDOW w AS (PARTITION BY play_id, a, b ORDER BY frame_id)) z WINDOW w AS (PARTITION BY play_id, a, b ORDER BY frame_id)),
 o AS (SELECT c.*, s0 FROM c JOIN (SELECT play_id, a, b, chain, min(frame_id) AS s0 FROM c WHERE d <= 1.5 GROUP BY ALL) e
   ON c.play_id = e.play_id AND c.a = e.a AND c.b = e.b AND c.chain = e.chain AND c.frame_id >= s0),
 k AS (SELECT *, first_value(CASE WHEN holder IN (a, b) THEN holder END IGNORE NULLS) OVER (PARTITION BY play_id, a, b, chain ORDER BY frame_id) AS held_id FROM o),
 g AS (SELECT game_id, play_id, a, b, chain, min(frame_id) AS start_frame, max(frame_id) AS end_frame, min(d) AS closest,
   arg_min(a_s, frame_id) - min(a_s) AS a_drop, arg_min(b_s, frame_id) - min(b_s) AS b_drop, coalesce(bool_or(holder IN (a, b)), false) AS carrier,
   min(frame_id) FILTER (held_id IS NOT NULL AND CASE WHEN held_id = a THEN a_s ELSE b_s END < 1.4) AS down_frame FROM k GROUP BY ALL)
 SELECT game_id, play_id, a, b, start_frame, end_frame, closest, a_drop, b_drop, carrier, down_frame,
  CASE WHEN carrier AND greatest(a_drop, b_drop) >= 1.5 THEN 'tackle' WHEN carrier THEN 'tackle_attempt' WHEN end_frame - start_frame >= 6 THEN 'block' ELSE 'collision' END AS kind
 FROM g WHERE end_frame - start_frame >= 2""", "men", "held")
add_base("runs", """SELECT game_id, play_id, holder, min(frame_id) AS start_frame, max(frame_id) AS end_frame FROM (
  SELECT *, sum(CASE WHEN rn = 1 OR holder IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY play_id ORDER BY frame_id) AS run FROM (
   SELECT *, lag(holder) OVER w AS was, row_number() OVER w AS rn FROM held WINDOW w AS (PARTITION BY play_id ORDER BY frame_id)) a) z GROUP BY game_id, play_id, holder, run""", "held")
add_base("evaded", f"""WITH c AS (SELECT h.game_id, h.play_id, h.frame_id, h.holder, greatest(h.frame_id - 5, lo) AS lo, least(h.frame_id + 5, hi) AS hi FROM held h
   JOIN (SELECT play_id, min(frame_id) AS lo, max(frame_id) AS hi FROM held GROUP BY ALL) e ON e.play_id = h.play_id WHERE holder IS NOT NULL),
 n AS (SELECT c.*, b.nfl_id AS other, {D} AS d, least(c.holder, b.nfl_id) AS p, greatest(c.holder, b.nfl_id) AS q FROM c
   JOIN men a ON a.play_id = c.play_id AND a.frame_id = c.frame_id AND a.nfl_id = c.holder
   JOIN men b ON b.play_id = c.play_id AND b.frame_id = c.frame_id AND b.club <> a.club WHERE {D} <= 3.5),
 u AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM contacts k WHERE k.play_id = n.play_id AND k.a = p AND k.b = q)),
 m AS (SELECT u.*, abs(CASE WHEN w > 180 THEN w - 360 ELSE w END) AS swing, ahead FROM (SELECT u.*, (h2.cdir - l.cdir + 720) % 360 AS w,
   (o.x - h2.x) * cos(radians(h2.cdir)) + (o.y - h2.y) * sin(radians(h2.cdir)) AS ahead FROM u
   JOIN men l ON l.play_id = u.play_id AND l.frame_id = u.lo AND l.nfl_id = u.holder JOIN men h2 ON h2.play_id = u.play_id AND h2.frame_id = u.hi AND h2.nfl_id = u.holder
   JOIN men o ON o.play_id = u.play_id AND o.frame_id = u.hi AND o.nfl_id = u.other) u)
 SELECT game_id, play_id, holder AS carrier, other AS beaten, frame_id, d, swing FROM (SELECT *, row_number() OVER (PARTITION BY play_id, p, q ORDER BY frame_id) AS rn
   FROM m WHERE swing >= 25 AND ahead <= -0.5) z WHERE rn = 1""", "men", "held", "contacts")


def held(t: Tables):
    return ia.holders(t.men, t.ball)


def everything(t: Tables, sides=None, wanted=None):
    m = t.men.withColumn("o_source", facing(F.col("o"), F.col("dir"))[1])
    return derive(m, t.ball, t.play_span(), t.player_span(), sides, wanted)


def contacts(t: Tables):
    return ia.engagements(t.men, held(t), t.play_span())


@query("ball_holders", "SELECT * FROM held", "held")
def _(t: Tables):
    return held(t)


@query("ball_usable", """WITH h AS (SELECT a.game_id, a.play_id, a.nfl_id, a.club, row_number() OVER (PARTITION BY a.play_id, a.frame_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), a.nfl_id) AS rn,
   sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM men a JOIN ball b ON a.play_id = b.play_id AND a.frame_id = b.frame_id WHERE b.t >= 0)
 SELECT game_id, play_id, live, held, by_offense, held / live >= 0.75 AND coalesce(by_offense / nullif(held, 0), 1) >= 0.85 AS usable FROM (
  SELECT game_id, play_id, count(*) AS live, count(*) FILTER (d <= 1.6) AS held, count(*) FILTER (d <= 1.6 AND club = 'HOM') AS by_offense FROM h WHERE rn = 1 GROUP BY ALL) z""", "men", "ball")
def _(t: Tables):
    m = t.men.withColumn("side", F.when(F.col("club") == "HOM", "offense").otherwise("defense"))
    return ia.ball_usable(m, t.ball).select(*PLAY, "live", "held", "by_offense", "usable")


@query("possession_runs", "SELECT * FROM runs", "runs")
def _(t: Tables):
    return ia.possession_runs(held(t), t.play_span()).select(*PLAY, "holder", "start_frame", "end_frame")


CONV = """SELECT o.game_id, o.play_id, o.frame_id, o.nfl_id, sum(CASE WHEN d <= 15 AND d >= 1e-6 AND closing > 0 THEN closing ELSE 0 END) AS score FROM (
  SELECT o.*, sqrt(dx * dx + dy * dy) AS d, -(dvx * dx + dvy * dy) / sqrt(dx * dx + dy * dy) AS closing FROM (
   SELECT o.*, d.x - o.x AS dx, d.y - o.y AS dy, d.s * cos(radians(d.cdir)) - o.s * cos(radians(o.cdir)) AS dvx, d.s * sin(radians(d.cdir)) - o.s * sin(radians(o.cdir)) AS dvy
   FROM men o JOIN men d ON d.play_id = o.play_id AND d.frame_id = o.frame_id AND d.club = 'AWY' WHERE o.club = 'HOM') o) o GROUP BY ALL"""


@query("defensive_convergence", CONV.replace("sum(CASE", "round(sum(CASE").replace("ELSE 0 END) AS score", "ELSE 0 END), 5) AS score"), "men")
def _(t: Tables):
    m = t.men.withColumn("side", F.when(F.col("club") == "HOM", "offense").otherwise("defense"))
    return ia.convergence(m).select(*FRAME, "nfl_id", F.round("score", 5).alias("score"))


add_base("conv", CONV, "men")


@query("inferred_possession", """WITH RECURSIVE best AS (SELECT play_id, frame_id, map_from_entries(list((nfl_id, score))) AS scores, max(score) AS lead, arg_min(nfl_id, (-score, nfl_id)) AS top FROM conv GROUP BY ALL),
 p AS MATERIALIZED (SELECT b.game_id, b.play_id, b.frame_id, b.t, scores, lead, CASE WHEN b.t >= 0 THEN top END AS top, row_number() OVER (PARTITION BY b.play_id ORDER BY b.frame_id) AS k FROM ball b LEFT JOIN best ON best.play_id = b.play_id AND best.frame_id = b.frame_id),
 s AS (SELECT game_id, play_id, frame_id, t, k, top AS who FROM p WHERE k = 1
   UNION ALL SELECT p.game_id, p.play_id, p.frame_id, p.t, p.k, CASE WHEN p.top IS NOT NULL AND (who IS NULL OR p.lead - coalesce(p.scores[who], 0) > 1.5) THEN p.top ELSE who END FROM s JOIN p ON p.play_id = s.play_id AND p.k = s.k + 1),
 h AS (SELECT *, CASE WHEN t >= 0 THEN who END AS holder FROM s),
 g AS (SELECT *, sum(CASE WHEN k = 1 OR holder IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY play_id ORDER BY k) AS run FROM (SELECT *, lag(holder) OVER (PARTITION BY play_id ORDER BY k) AS was FROM h) y)
 SELECT game_id, play_id, any_value(holder) AS holder, min(frame_id) AS start_frame, max(frame_id) AS end_frame FROM g GROUP BY game_id, play_id, run""", "conv", "ball")
def _(t: Tables):
    m = t.men.withColumn("side", F.when(F.col("club") == "HOM", "offense").otherwise("defense"))
    who = ia.inferred_holders(ia.convergence(m), t.ball.select(*FRAME, "t"))
    return ia.possession_runs(who, t.play_span()).select(*PLAY, "holder", "start_frame", "end_frame")


@query("engagements", """SELECT game_id, play_id, a, b, start_frame, end_frame, round(closest, 6) AS closest, round(a_drop, 6) AS a_drop, round(b_drop, 6) AS b_drop,
  carrier, down_frame, kind FROM contacts""", "contacts")
def _(t: Tables):
    return contacts(t).select(*PLAY, "a", "b", "start_frame", "end_frame", *[F.round(c, 6).alias(c) for c in ("closest", "a_drop", "b_drop")],
                              "carrier", "down_frame", "kind")


@query("evades", "SELECT game_id, play_id, carrier, beaten, frame_id, round(d, 6) AS d, round(swing, 4) AS swing FROM evaded", "evaded")
def _(t: Tables):
    e = everything(t)["evades"]
    return e.select(*PLAY, "carrier", "beaten", "frame_id", F.round("d", 6).alias("d"), F.round("swing", 4).alias("swing"))


@query("ball_in_view", """WITH v AS (SELECT m.game_id, m.play_id, m.nfl_id, m.frame_id, CASE WHEN m.o IS NULL THEN 'from_dir' ELSE 'measured' END AS src,
   abs(CASE WHEN w > 180 THEN w - 360 ELSE w END) AS off FROM (SELECT m.*, (degrees(atan2(b.y - m.y, b.x - m.x)) - co + 720) % 360 AS w FROM men m
   JOIN ball b ON b.play_id = m.play_id AND b.frame_id = m.frame_id) m),
 r AS (SELECT *, sum(CASE WHEN seen IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY play_id, nfl_id ORDER BY frame_id) AS run FROM (
   SELECT *, off <= 100 AS seen, lag(off <= 100) OVER w AS was, lead(frame_id) OVER w AS nf FROM v WINDOW w AS (PARTITION BY play_id, nfl_id ORDER BY frame_id)) a)
 SELECT game_id, play_id, nfl_id, start_frame, end_frame, basis, max_offset FROM (SELECT game_id, play_id, nfl_id, run, min(frame_id) AS start_frame,
   arg_max(coalesce(nf, frame_id), frame_id) AS end_frame, min(src) AS basis, round(max(off), 4) AS max_offset FROM r WHERE seen GROUP BY ALL) z
 WHERE end_frame - start_frame >= 2""", "men", "ball")
def _(t: Tables):
    m = t.men.withColumn("o_source", facing(F.col("o"), F.col("dir"))[1])
    v = ia.view_windows(m, t.ball, t.player_span())
    return v.select(*PLAY, "nfl_id", "start_frame", "end_frame", "basis", F.round("max_offset", 4).alias("max_offset"))


@query("interval_timeline", """SELECT game_id, play_id, 'possession' AS what, holder AS who, CAST(NULL AS BIGINT) AS other, start_frame, end_frame FROM runs
  WHERE holder IS NOT NULL AND end_frame - start_frame >= 3
 UNION ALL SELECT game_id, play_id, kind, a, b, start_frame, end_frame FROM contacts WHERE kind <> 'collision'
 UNION ALL SELECT game_id, play_id, 'evade', carrier, beaten, frame_id, frame_id FROM evaded""", "runs", "contacts", "evaded")
def _(t: Tables):
    return everything(t)["timeline"]


@query("play_notes")
def _(t: Tables):
    sides = t.plays.select(*PLAY, F.lit("HOM").alias("offense"), F.lit("ball_at_snap").alias("method"), F.when(F.col("play_id") % 2 == 0, 0.812).otherwise(0.987).alias("confidence"))
    return everything(t, sides, {"notes"})["notes"].select(*PLAY, F.array_join("notes", "|").alias("notes"))
