"""Joins: nearest, proximity, history, as-of, semi and anti."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.fixture import add_base
from snapspan.catalog.registry import Tables, query
from snapspan.functions import coding
from snapspan.operators import events as ev, pairs as pa
from snapspan.plans.joins import in_interval, nearest_in_time
from snapspan.schema import FRAME, LINE_POSITIONS, PLAY

K = ["game_id", "play_id", "frame_id", "nfl_id"]
D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def full_name():
    """Names of the derived rosters end in a letter of their own."""
    return F.concat(F.lit("Pat Name"), F.expr("substr('abcdefghijk', CAST(nfl_id + 1 AS INT), 1)"))


def at_throw(t: Tables):
    w = t.win.select(*PLAY, F.col("throw").alias("frame_id"), "h", "arrival")
    return t.men.join(w, FRAME)


@query("nearest_opponent", f"""WITH th AS (SELECT m.* FROM men m JOIN win w ON m.play_id = w.play_id AND m.frame_id = w.throw),
 r AS (SELECT a.game_id, a.play_id, a.nfl_id, b.x - a.x AS dx, b.y - a.y AS dy, {D} AS d,
   row_number() OVER (PARTITION BY a.play_id, a.nfl_id ORDER BY {D}, b.nfl_id) AS rn
   FROM th a JOIN th b ON a.play_id = b.play_id AND a.club <> b.club)
 SELECT game_id, play_id, nfl_id, round(dx, 6) AS opp_dx, round(dy, 6) AS opp_dy, round(d, 6) AS opp_dist FROM r WHERE rn = 1""", "men", "win")
def _(t: Tables):
    th = at_throw(t).withColumn("offense", (F.col("club") == "HOM").cast("int"))
    o = pa.nearest_opponent(th.select(*PLAY, "nfl_id", "offense", "x", "y"), PLAY)
    return o.select(*PLAY, "nfl_id", *[F.round(c, 6).alias(c) for c in ("opp_dx", "opp_dy", "opp_dist")])


@query("passer_and_target", f"""WITH c AS (SELECT a.game_id, a.play_id, a.frame_id, a.nfl_id, a.position, {D} AS d FROM men a JOIN ball b
  ON a.play_id = b.play_id AND a.frame_id = b.frame_id WHERE a.club = 'HOM'),
 p AS (SELECT c.game_id, c.play_id, min_by(nfl_id, d * 100 + nfl_id / 1e6) AS passer FROM c JOIN win w ON c.play_id = w.play_id AND c.frame_id = w.throw
   WHERE position NOT IN ('T', 'G', 'C') GROUP BY ALL),
 g AS (SELECT c.play_id, min_by(nfl_id, d * 100 + nfl_id / 1e6) AS target FROM c JOIN win w ON c.play_id = w.play_id AND c.frame_id = w.arrival
   JOIN p ON p.play_id = c.play_id WHERE position IN ('WR', 'TE', 'RB') AND nfl_id <> passer GROUP BY ALL)
 SELECT p.game_id, p.play_id, passer, target FROM p LEFT JOIN g ON p.play_id = g.play_id""", "men", "ball", "win")
def _(t: Tables):
    off = t.men.filter("club = 'HOM'")
    w = t.win
    thrown = off.filter(~F.col("position").isin(*LINE_POSITIONS)).join(w.select(*PLAY, F.col("throw").alias("frame_id")), FRAME)
    p = pa.nearest_to_ball(thrown, t.ball).select(*PLAY, F.col("near_id").alias("passer"))
    arrived = (off.filter(F.col("position").isin("WR", "TE", "RB", "FB"))
               .join(w.select(*PLAY, F.col("arrival").alias("frame_id")), FRAME)
               .join(p, PLAY).filter(F.col("nfl_id") != F.col("passer")))
    g = pa.nearest_to_ball(arrived, t.ball).select(*PLAY, F.col("near_id").alias("target"))
    return p.join(g, PLAY, "left")


@query("close_pairs", f"""SELECT a.game_id, a.play_id, a.frame_id, a.nfl_id AS a, b.nfl_id AS b, round({D}, 6) AS d FROM men a JOIN men b
  ON a.play_id = b.play_id AND a.frame_id = b.frame_id AND a.nfl_id < b.nfl_id AND a.club <> b.club WHERE {D} <= 2.2""", "men")
def _(t: Tables):
    p = pa.close_pairs(t.men, 2.2)
    return p.select(*FRAME, F.col("a_nfl_id").alias("a"), F.col("b_nfl_id").alias("b"), F.round("d", 6).alias("d"))


@query("separation_at_arrival", f"""SELECT a.game_id, a.play_id, a.nfl_id, round(min({D}), 6) AS separation FROM men a
  JOIN win w ON a.play_id = w.play_id AND a.frame_id = w.arrival
  JOIN men b ON a.play_id = b.play_id AND a.frame_id = b.frame_id AND b.club = 'AWY' WHERE a.club = 'HOM' GROUP BY ALL""", "men", "win")
def _(t: Tables):
    arr = t.men.join(t.win.select(*PLAY, F.col("arrival").alias("frame_id")), FRAME)
    s = pa.separation(arr.filter("club = 'HOM'").select(*PLAY, "nfl_id", "x", "y"), arr.filter("club = 'AWY'"), PLAY)
    return s.select(*PLAY, "nfl_id", F.round("separation", 6).alias("separation"))


@query("throw_history", """WITH s AS (SELECT m.*, w.throw, m.s * sin(radians(m.dir)) AS vx, m.s * cos(radians(m.dir)) AS vy FROM men m
   JOIN win w ON m.play_id = w.play_id AND m.frame_id = w.throw)
 SELECT s.game_id, s.play_id, s.nfl_id, round(coalesce(s.x - h5.x, vx * 5 / 10), 6) AS dx5, round(coalesce(s.y - h5.y, vy * 5 / 10), 6) AS dy5,
  round(coalesce(s.x - h10.x, vx * 10 / 10), 6) AS dx10, round(coalesce(s.y - h10.y, vy * 10 / 10), 6) AS dy10 FROM s
 LEFT JOIN men h5 ON h5.play_id = s.play_id AND h5.nfl_id = s.nfl_id AND h5.frame_id = s.throw - 5
 LEFT JOIN (SELECT * FROM men WHERE nfl_id % 5 > 0) h10 ON h10.play_id = s.play_id AND h10.nfl_id = s.nfl_id AND h10.frame_id = s.throw - 10""", "men", "win")
def _(t: Tables):
    s = at_throw(t).withColumn("throw", F.col("frame_id")).withColumns({
        "vx": F.col("s") * F.sin(F.radians("dir")), "vy": F.col("s") * F.cos(F.radians("dir"))})
    old = t.men.filter((F.col("nfl_id") % 5 > 0) | (F.col("frame_id") > 2))
    h = pa.history(s.select(*PLAY, "nfl_id", "throw", "x", "y", "vx", "vy"), old, PLAY, "nfl_id", "throw")
    return h.select(*PLAY, "nfl_id", *[F.round(c, 6).alias(c) for c in ("dx5", "dy5", "dx10", "dy10")])


@query("crowded_players", f"""SELECT game_id, play_id, count(*) AS n, count(*) FILTER (near < 1.2) AS crowded FROM (
  SELECT a.game_id, a.play_id, a.frame_id, a.nfl_id, min({D}) AS near FROM men a LEFT JOIN men b ON a.play_id = b.play_id
   AND a.frame_id = b.frame_id AND a.nfl_id <> b.nfl_id GROUP BY ALL) z GROUP BY ALL""", "men")
def _(t: Tables):
    c = pa.crowded(t.men.select(*K, "x", "y"), 1.2, FRAME, "nfl_id")
    return c.groupBy(*PLAY).agg(F.count(F.lit(1)).alias("n"), F.count_if("crowded").alias("crowded"))


@query("event_neighbourhood", """SELECT game_id, play_id, frame_id, count(*) AS n FROM trk t WHERE EXISTS (SELECT 1 FROM trk e WHERE
  e.play_id = t.play_id AND e.event IS NOT NULL AND e.nfl_id IS NULL AND t.frame_id IN (e.frame_id, e.frame_id - 5, e.frame_id - 10)) GROUP BY ALL""", "trk")
def _(t: Tables):
    e = t.trk.filter("event IS NOT NULL AND nfl_id IS NULL").select(*FRAME)
    return pa.event_neighbourhood(t.trk, e).groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))


@query("nearest_frame_pairing", """WITH p AS (SELECT game_id, play_id, t + 0.03 AS pt, x AS px FROM ball WHERE frame_id % 3 > 0)
 SELECT b.game_id, b.play_id, b.frame_id, round(min_by(px, abs(pt - t) * 1000 + pt / 1e6), 6) AS px FROM ball b JOIN p ON b.play_id = p.play_id AND abs(pt - t) <= 0.05
 GROUP BY ALL""", "ball")
def _(t: Tables):
    p = t.ball.filter("frame_id % 3 > 0").select(*PLAY, (F.col("t") + 0.03).alias("pt"), F.col("x").alias("px"))
    out = nearest_in_time(t.ball.select(*FRAME, "t"), p, PLAY, "t", "pt", 0.05, ["px"], prefix="").filter("px IS NOT NULL")
    return out.select(*FRAME, F.round("px", 6).alias("px"))


@query("latest_event_so_far", """SELECT game_id, play_id, frame_id, last_value(event IGNORE NULLS) OVER (PARTITION BY play_id ORDER BY frame_id) AS latest
  FROM trk WHERE nfl_id IS NULL""", "trk")
def _(t: Tables):
    from snapspan.plans.sequences import last_known
    b = t.trk.filter("nfl_id IS NULL").select(*FRAME, "event")
    return last_known(b, t.play_span(), F.col("event"), "latest").select(*FRAME, "latest")


@query("interval_lookup", """WITH iv AS (SELECT game_id, play_id, snap AS i0, throw AS i1, 'pocket' AS phase, 1 AS ord FROM win
   UNION ALL SELECT game_id, play_id, throw, arrival, 'flight', 2 FROM win)
 SELECT b.game_id, b.play_id, b.frame_id, min_by(phase, ord) AS phase FROM ball b LEFT JOIN iv ON b.play_id = iv.play_id AND b.frame_id BETWEEN i0 AND i1
 GROUP BY ALL""", "ball", "win")
def _(t: Tables):
    w = t.win
    iv = w.select(*PLAY, F.col("snap").alias("s"), F.col("throw").alias("e"), F.lit("pocket").alias("phase"), F.lit(1).alias("ord"))
    iv = iv.unionByName(w.select(*PLAY, F.col("throw").alias("s"), F.col("arrival").alias("e"), F.lit("flight").alias("phase"), F.lit(2).alias("ord")))
    return in_interval(t.ball.select(*FRAME), iv, PLAY, "frame_id", "s", "e", ["phase"], 16, "ord")


# A second track follows every sixth man half a yard off, on two frames of three far enough away to doubt it for every twelfth.
add_base("doubled", """SELECT game_id, play_id, frame_id, nfl_id, club, x, y FROM men UNION ALL
  SELECT game_id, play_id, frame_id, nfl_id + 100, club, x + CASE WHEN nfl_id % 12 = 5 AND frame_id % 3 > 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END, y FROM men WHERE nfl_id % 6 = 5 AND frame_id % 4 > 0""", "men")


def doubled(t: Tables):
    m = t.men.select(*K, "club", "x", "y")
    off = F.when((F.col("nfl_id") % 12 == 5) & (F.col("frame_id") % 3 > 0), 1.5).otherwise(0.5)
    # twins stand beside their track row by row: a union would part the plays from their buckets
    own = F.struct("nfl_id", "x")
    twin = F.when((F.col("nfl_id") % 6 == 5) & (F.col("frame_id") % 4 > 0), F.struct((F.col("nfl_id") + 100).alias("nfl_id"), (F.col("x") + off).alias("x")))
    return m.select(*FRAME, "club", "y", F.explode(F.array_compact(F.array(own, twin))).alias("v")).select(*FRAME, "v.nfl_id", "club", "v.x", "y")


@query("duplicate_tracks", f"""SELECT a.game_id, a.play_id, a.nfl_id AS a, b.nfl_id AS b, count(*) AS shared, count(*) FILTER ({D} <= 0.9) AS close FROM doubled a JOIN doubled b ON a.play_id = b.play_id
  AND a.frame_id = b.frame_id AND a.club = b.club AND a.nfl_id < b.nfl_id GROUP BY ALL HAVING count(*) >= 4 AND count(*) FILTER ({D} <= 0.9) / count(*) >= 0.6""", "doubled")
def _(t: Tables):
    return pa.duplicate_pairs(doubled(t), "nfl_id", "club", 0.9, 0.6, 4).drop("club")


@query("players_without_match", """SELECT DISTINCT a.game_id, a.play_id, a.nfl_id FROM men a WHERE NOT EXISTS (SELECT 1 FROM men b WHERE b.play_id = a.play_id
  AND b.nfl_id = a.nfl_id AND b.s > 5)""", "men")
def _(t: Tables):
    people = t.men.select(*PLAY, "nfl_id").distinct()
    return people.join(t.men.filter("s > 5").select(*PLAY, "nfl_id"), [*PLAY, "nfl_id"], "left_anti")


@query("plays_without_throw", "SELECT p.game_id, p.play_id FROM plays p WHERE play_id NOT IN (SELECT play_id FROM trk WHERE frame_id = 30)", "plays", "trk")
def _(t: Tables):
    return t.plays.select(*PLAY).join(t.trk.filter("frame_id = 30").select(*PLAY), PLAY, "left_anti")


@query("shared_players", """SELECT nfl_id FROM (SELECT nfl_id FROM men WHERE s > 8 INTERSECT SELECT nfl_id FROM men WHERE position = 'CB') z""", "men")
def _(t: Tables):
    return t.men.filter("s > 8").select("nfl_id").intersect(t.men.filter("position = 'CB'").select("nfl_id"))


@query("players_only_in_first", "SELECT nfl_id FROM (SELECT DISTINCT nfl_id FROM men EXCEPT SELECT nfl_id FROM men WHERE position IN ('QB', 'CB')) z", "men")
def _(t: Tables):
    return t.men.select("nfl_id").distinct().subtract(t.men.filter(F.col("position").isin("QB", "CB")).select("nfl_id"))


@query("name_matches", """SELECT DISTINCT p.game_id, p.play_id, m.nfl_id FROM plays p JOIN men m ON m.play_id = p.play_id AND m.club = 'HOM'
  WHERE m.nfl_id = CASE WHEN p.play_id % 4 = 0 THEN (p.play_id + 4) % 11 ELSE (p.play_id + 3) % 11 END""", "plays", "men")
def _(t: Tables):
    roster = t.men.filter("club = 'HOM'").select(*PLAY, "nfl_id").distinct()
    j = roster.join(t.plays.withColumn("named", coding.named_target(F.col("description"))).select(*PLAY, "named"), PLAY)
    return j.filter(coding.name_matches(F.col("named"), full_name())).select(*PLAY, "nfl_id")


@query("first_box_vote", """WITH b AS (SELECT game_id, play_id, frame_id, nfl_id AS box, x - 1.5 AS x1, x + 1.5 AS x2, y - 1.5 AS y1, y + 1.5 AS y2 FROM men WHERE club = 'HOM')
 SELECT m.game_id, m.play_id, m.frame_id, m.nfl_id, min(box) AS box FROM men m JOIN b ON m.play_id = b.play_id AND m.frame_id = b.frame_id
 AND m.x BETWEEN x1 AND x2 AND m.y BETWEEN y1 AND y2 WHERE m.club = 'AWY' GROUP BY ALL""", "men")
def _(t: Tables):
    b = t.men.filter("club = 'HOM'").select(*FRAME, F.col("nfl_id").alias("box"), (F.col("x") - 1.5).alias("x1"), (F.col("x") + 1.5).alias("x2"),
                                            (F.col("y") - 1.5).alias("y1"), (F.col("y") + 1.5).alias("y2"))
    p = t.men.filter("club = 'AWY'").select(*K, F.col("x").alias("px"), F.col("y").alias("py"))
    return pa.first_containing_box(p, b, FRAME, "box", F.col("px"), F.col("py")).drop("px", "py")


@query("first_event_by_priority", """SELECT game_id, play_id, coalesce(min(frame_id) FILTER (event = 'pass_arrived'), min(frame_id) FILTER (event = 'pass_forward')) AS at,
  CASE WHEN count(*) FILTER (event = 'pass_arrived') > 0 THEN 'pass_arrived' ELSE 'pass_forward' END AS event
  FROM trk WHERE event IN ('pass_arrived', 'pass_forward') GROUP BY ALL""", "trk")
def _(t: Tables):
    return ev.first_by_priority(t.trk, ["pass_arrived", "pass_outcome_caught", "pass_forward"])


@query("plays_with_snap", "SELECT DISTINCT game_id, play_id FROM trk WHERE event = 'ball_snap'", "trk")
def _(t: Tables):
    return ev.with_snap(t.trk)


@query("pass_windows", "SELECT * FROM win", "win")
def _(t: Tables):
    return t.win
