"""Sources, documents, lookups, chains, trackers, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapspan.catalog.q_interactions import contacts, held
from snapspan.catalog.q_review import reports, samples
from snapspan.catalog.registry import Tables, query
from snapspan.functions.coding import facing
from snapspan.operators import chains as ch, events as ev, library as lb, pairs as pa, quality as ql, roster as rs, timeseries as ts, trackers as tk
from snapspan.plans.sequences import Span
from snapspan.sources import readers as rd, writers as wr
from snapspan.streaming import live
from snapspan.schema import FRAME, PLAY

K = ["game_id", "play_id", "frame_id", "nfl_id"]


@query("split_game_play", """SELECT game_id, play_id, count(*) AS n FROM (SELECT split_part(gp, '_', 1) AS game_id, substr(gp, instr(gp, '_') + 1) AS play_id FROM (SELECT game_id || '_' || play_id AS gp FROM trk) a) z GROUP BY ALL""", "trk")
def _(t: Tables):
    raw = t.trk.select(F.concat_ws("_", "game_id", "play_id").alias("game_play"), F.coalesce(F.col("nfl_id").cast("string"), F.lit("ball")).alias("nfl_player_id"),
                       F.col("frame_id").alias("step"), F.col("x").alias("X"), "y", F.lit(1).alias("unused"))
    return rd.canonical(raw).groupBy("game_id", "play_id").agg(F.count(F.lit(1)).alias("n"))


@query("play_list", "SELECT DISTINCT game_id, play_id FROM trk", "trk")
def _(t: Tables):
    return rd.play_list(t.trk)


@query("truth_labels", "SELECT play_id, nfl_id, frame_id, x, y FROM trk WHERE game_id = 3 AND nfl_id IS NOT NULL", "trk")
def _(t: Tables):
    raw = t.trk.select(F.col("game_id").alias("Game_ID"), F.col("play_id").alias("Play_ID"), F.col("nfl_id").alias("NFL_id"), F.col("frame_id").alias("Frame_Id"), "x", "y")
    return rd.truth_rows(raw, 3).filter("nfl_id IS NOT NULL").select("play_id", "nfl_id", "frame_id", "x", "y")


@query("clip_settings", """SELECT play_id, start, CAST(least(coalesce(stop, n), n) AS INT) AS window_stop, CAST(CASE WHEN play_id % 3 = 0 THEN 0 ELSE greatest(0, 30 - start) END AS INT) AS snap,
  CAST(CASE WHEN play_id % 5 = 0 THEN 7 ELSE floor((start + least(coalesce(stop, n), n)) / 2) END AS INT) AS read_frame, 12 AS out_fps FROM (
  SELECT play_id, CAST(play_id % 40 AS INT) AS start, CASE WHEN play_id % 2 = 0 THEN CAST(100 + play_id % 90 AS INT) END AS stop, 150 AS n FROM plays) z""", "plays")
def _(t: Tables):
    c = F.to_json(F.struct((F.col("play_id") % 40).cast("int").alias("start"), F.when(F.col("play_id") % 2 == 0, (100 + F.col("play_id") % 90).cast("int")).alias("stop"),
                           F.when(F.col("play_id") % 3 != 0, 30).alias("snap_frame"), F.when(F.col("play_id") % 5 == 0, F.struct(F.lit(7).alias("frame"))).alias("register")))
    return rd.clip_specs(t.plays.select("play_id", F.lit(150).alias("n_frames"), c.alias("value"))).select("play_id", "start", "window_stop", "snap", "read_frame", "out_fps")


@query("last_report_lines", """SELECT game_id, play_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id ORDER BY line DESC) AS rn FROM (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey % 50 END AS game_id, o_orderkey % 7 AS play_id, o_orderpriority AS decision, o_orderkey AS line, o_orderkey % 13 = 5 AS broken FROM orders) a
  WHERE NOT broken AND game_id IS NOT NULL) z WHERE rn = 1""")
def _(t: Tables):
    o = t.raw("orders")
    doc = F.to_json(F.struct(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_custkey") % 50).alias("game_id"), (F.col("o_orderkey") % 7).alias("play_id"), F.col("o_orderpriority").alias("decision")))
    lines = o.select(F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 13 == 5, F.concat(doc, F.lit("{oops"))).otherwise(doc).alias("value"))
    lines = lines.withColumn("value", F.when(F.col("line") % 13 == 5, F.substring("value", 2, 20)).otherwise(F.col("value")))
    from pyspark.sql import types as T
    good, _ = rd.split_json(lines, T.StructType.fromDDL("game_id bigint, play_id bigint, decision string"))
    return rd.last_per_key(good, PLAY).select(*PLAY, "decision")


def documents(t: Tables):
    s = t.norm.filter("nfl_id IS NOT NULL").withColumn("o_source", facing(F.col("o"), F.col("dir"))[1])
    roster = rs.roster_of(t.trk).withColumns({"name": F.concat(F.lit("P"), "nfl_id"), "side": F.when(F.col("club") == "HOM", "offense").otherwise("defense")})
    plays = t.plays.join(ev.snap_frames(t.trk), PLAY)
    return wr.play_documents(s, roster, plays, t.ball)


@query("play_documents", """SELECT m.game_id, m.play_id, count(*) AS samples, count(DISTINCT m.frame_id) AS frames, 22::BIGINT AS people, count(o) AS measured, round(min(b.x), 2) AS los
  FROM men m JOIN (SELECT b.play_id, b.x FROM ball b WHERE frame_id = 5) b ON b.play_id = m.play_id GROUP BY ALL""", "men", "ball")
def _(t: Tables):
    # what is told of the document goes with its samples, so it is made and parsed once
    told = {"people": F.size("players").cast("long"), "los": F.col("lineOfScrimmage")}
    s = rd.documents_to_rows(rd.parse_documents(documents(t)), carry=told)["samples"].filter("people > 0")
    s = s.groupBy(*PLAY, "frame_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_source") == "measured").alias("m"), *[F.first(c).alias(c) for c in told])
    return s.groupBy(*PLAY).agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("frames"), F.sum("m").alias("measured"), *[F.first(c).alias(c) for c in told])


@query("game_indexes", """SELECT game_id, CAST(count(*) AS INT) AS n, concat('H', game_id % 7) AS home, CASE WHEN game_id % 4 > 0 THEN concat('V', game_id % 5) END AS visitor FROM plays GROUP BY ALL""", "plays")
def _(t: Tables):
    # every fourth game has no visitor told
    p = t.plays.withColumns({"home_team": F.concat(F.lit("H"), F.col("game_id") % 7), "visitor_team": F.when(F.col("game_id") % 4 > 0, F.concat(F.lit("V"), F.col("game_id") % 5))})
    return wr.index_documents(p).select("game_id", "n", F.get_json_object("value", "$.homeTeam").alias("home"), F.get_json_object("value", "$.visitorTeam").alias("visitor"))


@query("whole_tracks", "SELECT game_id, play_id, frame_id, t, CAST(nfl_id AS VARCHAR) AS player_id, x, y, s, CASE WHEN o IS NULL THEN 'from_dir' ELSE 'measured' END AS o_source FROM men", "men")
def _(t: Tables):
    m = t.men.withColumn("o_source", facing(F.col("o"), F.col("dir"))[1])
    return wr.read_whole_tracks(wr.whole_tracks(m.select(*K, "t", "x", "y", "s", "o_source")))


@query("release_rows", """SELECT h.game_id, h.play_id, h.frame_id, coalesce(CAST(m.nfl_id AS VARCHAR), 'ball') AS player_id, m.nfl_id IS NULL OR coalesce(h.holder = m.nfl_id, false) AS has_ball,
  coalesce(e.event, '') AS events, CASE WHEN m.nfl_id IS NOT NULL THEN round(m.s / 10, 4) END AS dis FROM trk m JOIN held h ON h.play_id = m.play_id AND h.frame_id = m.frame_id
  LEFT JOIN (SELECT DISTINCT play_id, frame_id, event FROM trk WHERE event IS NOT NULL) e ON e.play_id = m.play_id AND e.frame_id = m.frame_id""", "trk", "held")
def _(t: Tables):
    m = t.men.withColumn("o_source", facing(F.col("o"), F.col("dir"))[1])
    roster = rs.roster_of(t.trk).select(*PLAY, "nfl_id", F.concat(F.lit("P"), "nfl_id").alias("name"), F.when(F.col("club") == "HOM", "offense").otherwise("defense").alias("side"))
    r = wr.release_rows(m, t.ball, held(t), ev.frame_events(t.trk), roster)
    return r.select(*FRAME, "player_id", "has_ball", "events", "dis")


@query("loose_rows", """SELECT game_id, play_id, count(*) FILTER (nfl_id IS NULL) AS balls, round(sum(CASE WHEN play_direction = 'left' THEN 120 - x ELSE x END), 4) AS sx,
  count(*) FILTER (nfl_id IS NOT NULL AND o IS NULL) AS from_dir FROM trk GROUP BY ALL""", "trk")
def _(t: Tables):
    r = rd.tracking_rows(t.trk.withColumn("display_name", F.when(F.col("nfl_id").isNull(), "Football").otherwise("P")))
    return r.groupBy(*PLAY).agg(F.count_if("is_ball").alias("balls"), F.round(F.sum("x"), 4).alias("sx"), F.count_if(F.col("o_source") == "from_dir").alias("from_dir"))


@query("model_answers", "SELECT game_id, play_id, round(t + 0.4 - 0.4, 3) AS t, CAST(nfl_id AS VARCHAR) AS player_id, x, y FROM men", "men")
def _(t: Tables):
    f = t.men.groupBy(*PLAY, (F.col("t") + 0.4).alias("t")).agg(F.collect_list(F.struct(F.col("nfl_id").cast("string").alias("player_id"), F.col("club").alias("team"), "x", "y")).alias("players"))
    d = f.groupBy(*PLAY).agg(F.to_json(F.struct(F.collect_list(F.struct("t", "players")).alias("frames"))).alias("value"))
    return rd.model_answers(d.withColumn("snap_offset", F.lit(0.4))).select(*PLAY, "t", "player_id", "x", "y")


@query("label_counts", "SELECT quality, count(*) AS total, count(*) FILTER (toxic = 0) AS with_ball, count(*) FILTER (toxic <> 0) AS without_ball FROM labels GROUP BY ALL")
def _(t: Tables):
    seen = F.when(F.col("toxic") == 0, 1.0)
    one = t.raw("labels").select("quality", F.to_json(F.map_from_arrays(F.array(F.col("doc_id").cast("string")), F.array(F.struct(seen.alias("x"), seen.alias("y"), F.lit(9.0).alias("size"))))).alias("value"))
    kind = "map<string,struct<x:double,y:double,size:double>>"
    l = one.select("quality", F.explode(F.from_json("value", kind)).alias("key", "v")).select("quality", "key", "v.*")
    return rd.label_counts(l, ["quality"])


def library(t: Tables):
    sim = F.col("play_id") % 6 == 5
    return t.plays.select(*PLAY, sim.alias("simulated"), F.when(sim, F.col("play_id") - 1 - F.col("play_id") % 2).alias("simulated_from"),
                          F.concat_ws("_", "game_id", "play_id").alias("path"), "quarter", "down")


@query("linked_simulations", """SELECT p.game_id, p.play_id, s.simulation_id FROM plays p LEFT JOIN (SELECT game_id, src, arg_max(play_id, path) AS simulation_id FROM (SELECT game_id, play_id, play_id - 1 - play_id % 2 AS src, game_id || '_' || play_id AS path
  FROM plays WHERE play_id % 6 = 5) a GROUP BY ALL) s ON s.game_id = p.game_id AND s.src = p.play_id WHERE p.play_id % 6 <> 5""", "plays")
def _(t: Tables):
    return lb.link_simulations(library(t)).select(*PLAY, "simulation_id")


@query("compared_versions", """SELECT p.game_id, p.play_id, p.play_id % 4 > 0 AS has_current, p.play_id % 3 = 0 AS has_suggested, p.play_id % 5 = 0 AS has_optimal, p.play_id % 2 = 0 AS has_report FROM plays p
  WHERE p.play_id % 4 > 0 OR p.play_id % 3 = 0""", "plays")
def _(t: Tables):
    v = lambda m, name: t.plays.filter(m).select(*PLAY, F.col("description").alias(name))
    c = lb.compare_versions(v("play_id % 4 > 0", "current"), v("play_id % 3 = 0", "suggested"), v("play_id % 5 = 0", "optimal"), v("play_id % 2 = 0", "report"))
    return c.select(*PLAY, "has_current", "has_suggested", "has_optimal", "has_report")


@query("simulation_ids")
def _(t: Tables):
    p = library(t)
    have = p.filter("simulated AND play_id % 4 = 1").select("game_id", F.col("simulated_from").alias("play_id"), F.col("play_id").alias("simulation_id"))
    src = p.filter("NOT simulated").select(*PLAY)
    return lb.simulation_ids(src, p.select(*PLAY), have.join(src, PLAY, "left_semi").dropDuplicates(PLAY))


@query("game_summaries", """SELECT p.game_id, count(*) AS plays, count(*) FILTER (p.play_id % 6 = 5) AS simulated, (SELECT count(*) FROM reports r WHERE r.game_id = p.game_id) AS reports FROM plays p GROUP BY ALL""", "plays", "reports")
def _(t: Tables):
    return lb.game_summaries(library(t), reports(t).select(*PLAY))


@query("health_counts", "SELECT (SELECT count(DISTINCT game_id) FROM plays) AS games, (SELECT count(*) FROM plays) AS plays, (SELECT count(*) FROM win) AS reports", "plays", "win")
def _(t: Tables):
    return lb.health(t.plays, t.win)


@query("majority_game", "SELECT game_id FROM trk GROUP BY game_id ORDER BY count(*) DESC, game_id LIMIT 1", "trk")
def _(t: Tables):
    return lb.majority_game(t.trk)


DRIVES = """SELECT game_id, play_id, quarter, clock, sum(CASE WHEN pt IS NULL OR pt <> possession_team OR (pq <> quarter AND quarter IN (3, 5)) THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY play_id)::BIGINT AS drive FROM (
  SELECT *, CAST(15 - play_id % 15 AS INT) AS clock, lag(possession_team) OVER w AS pt, lag(quarter) OVER w AS pq FROM plays WINDOW w AS (PARTITION BY game_id ORDER BY play_id)) z"""


def grouped(t: Tables):
    d = ev.drives(t.plays.select(*PLAY, "possession_team", "quarter", (15 - F.col("play_id") % 15).cast("int").alias("clock")), t.game_span())
    return lb.hierarchy(d, t.game_span())


@query("drive_hierarchy", f"""SELECT game_id, quarter, drive, count(*) AS plays, min(play_id) AS first_play, arg_min(clock, play_id) AS first_clock, arg_max(clock, play_id) AS last_clock FROM ({DRIVES}) d GROUP BY ALL""", "plays")
def _(t: Tables):
    return grouped(t).select("game_id", "quarter", F.col("drive").cast("bigint").alias("drive"), "plays", "first_play", "first_clock", "last_clock")


@query("quarter_rollup", f"""SELECT game_id, quarter, sum(n)::BIGINT AS plays, count(*) AS drives FROM (SELECT game_id, quarter, drive, count(*) AS n FROM ({DRIVES}) d GROUP BY ALL) z GROUP BY GROUPING SETS ((game_id, quarter), (game_id))""", "plays")
def _(t: Tables):
    return lb.quarter_rollup(grouped(t))


@query("play_context", """SELECT game_id, play_id, '{"down":' || down || CASE WHEN spike IS NOT NULL THEN ',"spike":' || spike ELSE '' END || ',"pass_result":"' || pass_result || '"}' AS context FROM plays""", "plays")
def _(t: Tables):
    return lb.play_context(t.plays, ["down", "spike", "pass_result"])


@query("play_lookup", "SELECT game_id, play_id, frame_id, nfl_id, x FROM trk WHERE game_id = 1 AND play_id = 30", "trk")
def _(t: Tables):
    return lb.point_lookup(t.trk, "1_30.json").select(*K, "x")


@query("incomplete_forecasts", """SELECT game_id, play_id, nfl_id, n, last, first FROM (SELECT game_id, play_id, nfl_id, count(DISTINCT step) AS n, max(step) AS last, min(step) AS first FROM (
  SELECT s.game_id, s.play_id, s.nfl_id, CAST(range AS INT) AS step FROM samples s JOIN range(1, 30) ON range <= s.h WHERE (s.play_id + s.nfl_id + range) % 41 > 0) a GROUP BY ALL) z WHERE n <> last OR first <> 1""", "samples")
def _(t: Tables):
    s = samples(t).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("h")))).filter((F.col("play_id") + F.col("nfl_id") + F.col("step")) % 41 > 0)
    return lb.incomplete_forecasts(s.select(*PLAY, "nfl_id", "step"))


@query("detections_by_frame", "SELECT game_id, play_id, frame_id, count(*) AS boxes, max(jersey) AS top FROM men GROUP BY ALL", "men")
def _(t: Tables):
    return t.men.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("boxes"), F.max("jersey").alias("top"))


@query("worst_players", "SELECT game_id, play_id, nfl_id, n FROM (SELECT game_id, play_id, nfl_id, count(*) FILTER (o IS NOT NULL) AS n FROM men GROUP BY ALL) z ORDER BY n, game_id, play_id, nfl_id LIMIT 25", "men")
def _(t: Tables):
    g = t.men.groupBy(*PLAY, "nfl_id").agg(F.count("o").alias("n"))
    return lb.worst(g, "n", [*PLAY, "nfl_id"], 25)


@query("carrier_chain", """WITH RECURSIVE n AS (SELECT a.game_id, a.play_id, a.frame_id, a.nfl_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM men a JOIN ball b ON b.play_id = a.play_id AND b.frame_id = a.frame_id),
 p AS MATERIALIZED (SELECT game_id, play_id, frame_id, CASE WHEN frame_id = 3 OR d <= 1.5 THEN nfl_id ELSE -1 END AS pick, frame_id = 3 AS sure, row_number() OVER (PARTITION BY play_id ORDER BY frame_id) AS k
   FROM (SELECT *, row_number() OVER (PARTITION BY play_id, frame_id ORDER BY d, nfl_id) AS rn FROM n) z WHERE rn = 1),
 s AS (SELECT game_id, play_id, frame_id, k, CASE WHEN sure THEN pick ELSE -1 END AS held, CASE WHEN pick <> -1 AND NOT sure THEN 1 ELSE 0 END AS waited FROM p WHERE k = 1
   UNION ALL SELECT p.game_id, p.play_id, p.frame_id, p.k, CASE WHEN p.pick <> held AND (p.sure OR waited >= 1) THEN p.pick ELSE held END, CASE WHEN p.pick <> held AND NOT (p.sure OR waited >= 1) THEN waited + 1 ELSE 0 END
   FROM s JOIN p ON p.play_id = s.play_id AND p.k = s.k + 1)
 SELECT game_id, play_id, frame_id, nullif(held, -1) AS carrier FROM s""", "men", "ball")
def _(t: Tables):
    near = pa.nearest_to_ball(t.men, t.ball).withColumn("declared", F.when(F.col("frame_id") == 3, F.col("near_id")))
    return ch.carrier_chain(near)


@query("ball_exchanges", """WITH e AS (SELECT game_id, play_id, min(frame_id) FILTER (event = 'pass_forward') AS throw, min(frame_id) FILTER (event = 'pass_arrived') AS arrival FROM trk GROUP BY ALL),
 n AS (SELECT a.play_id, a.frame_id, a.nfl_id, row_number() OVER (PARTITION BY a.play_id, a.frame_id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), a.nfl_id) AS rn FROM men a JOIN ball b ON b.play_id = a.play_id AND b.frame_id = a.frame_id SEMI JOIN e ON e.play_id = a.play_id AND e.arrival = a.frame_id)
 SELECT e.game_id, e.play_id, 'pass_forward' AS kind, throw AS start_frame, h.holder AS giver, n.nfl_id AS receiver, CASE WHEN arrival > throw THEN arrival END AS arrive_frame FROM e
  LEFT JOIN held h ON h.play_id = e.play_id AND h.frame_id = throw LEFT JOIN n ON n.play_id = e.play_id AND n.frame_id = arrival AND n.rn = 1 WHERE throw IS NOT NULL""", "trk", "men", "ball", "held")
def _(t: Tables):
    near = pa.nearest_to_ball(t.men, t.ball)
    return ch.exchanges(held(t).select(*FRAME, F.col("holder").alias("carrier")), t.trk.filter("nfl_id IS NULL"), near, t.play_span())


@query("keyframe_paths", """WITH g AS (SELECT game_id, play_id, nfl_id, frame_id, t, x AS p1, lead(t) OVER w AS t1, lead(x) OVER w AS p2, lag(t) OVER w AS t0, coalesce(lag(x) OVER w, x) AS p0, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS p3
   FROM men WHERE frame_id % 5 = 1 WINDOW w AS (PARTITION BY play_id, nfl_id ORDER BY frame_id)), k AS (SELECT *, CAST(range AS BIGINT) AS tick FROM g JOIN range(-10, 60) ON range <= round(t1 * 10) AND CASE WHEN t0 IS NULL THEN range >= round(t * 10) ELSE range > round(t * 10) END),
 u AS (SELECT *, (tick / 10 - t) / (t1 - t) AS u FROM k)
 SELECT game_id, play_id, nfl_id, tick, round(0.5 * (2 * p1 + (p2 - p0) * u + (2 * p0 - 5 * p1 + 4 * p2 - p3) * u * u + (3 * p1 - p0 - 3 * p2 + p3) * u * u * u) + 1e-8, 6) AS x FROM u""", "men")
def _(t: Tables):
    k = ch.keyframe_paths(t.men.filter("frame_id % 5 = 1").select(*K, "t", "x", "y"), t.player_span())
    return k.select(*PLAY, "nfl_id", "tick", F.round(F.col("x") + 1e-8, 6).alias("x"))


@query("keyframe_ball", """WITH f AS (SELECT DISTINCT game_id, play_id, frame_id, CAST(round(t * 10) AS BIGINT) AS tick FROM men),
 s AS (SELECT w.play_id, w.throw, w.arrival, g.holder AS giver, r.holder AS receiver FROM win w JOIN held g ON g.play_id = w.play_id AND g.frame_id = w.throw JOIN held r ON r.play_id = w.play_id AND r.frame_id = w.arrival WHERE w.snap IS NOT NULL),
 b AS (SELECT f.*, throw, arrival, giver, CASE WHEN f.frame_id < throw THEN giver ELSE coalesce(receiver, giver) END AS receiver, CASE WHEN throw IS NULL THEN NULL WHEN f.frame_id < throw THEN 'carry' ELSE 'pass' END AS kind FROM f LEFT JOIN s ON s.play_id = f.play_id)
 SELECT b.game_id, b.play_id, b.tick, kind, round(gm.x + (rm.x - gm.x) * CASE WHEN kind = 'carry' THEN 0 ELSE greatest(least((b.frame_id - throw) / (arrival - throw), 1), 0) END + 1e-8, 4) AS x
 FROM b LEFT JOIN men gm ON gm.play_id = b.play_id AND gm.frame_id = b.frame_id AND gm.nfl_id = b.giver LEFT JOIN men rm ON rm.play_id = b.play_id AND rm.frame_id = b.frame_id AND rm.nfl_id = b.receiver""", "held", "win", "men")
def _(t: Tables):
    h, w = held(t), t.win
    who = w.join(h.select(*PLAY, F.col("frame_id").alias("throw"), F.col("holder").alias("giver")), [*PLAY, "throw"])
    who = who.join(h.select(*PLAY, F.col("frame_id").alias("arrival"), F.col("holder").alias("receiver")), [*PLAY, "arrival"])
    clock = lambda c: (F.col(c) - F.col("snap")) / 10
    none = F.lit(None).cast("bigint")
    seg = who.select(*PLAY, F.lit(-0.4).alias("t0"), clock("throw").alias("t1"), F.lit("carry").alias("kind"), "giver", none.alias("receiver")).unionByName(
        who.select(*PLAY, clock("throw").alias("t0"), clock("arrival").alias("t1"), F.lit("pass").alias("kind"), "giver", "receiver"))
    paths = t.men.select(*PLAY, F.round(F.col("t") * 10).cast("bigint").alias("tick"), "nfl_id", "x", "y")
    b = ch.held_ball(paths.select(*PLAY, "tick").distinct(), seg, paths)
    return b.select(*PLAY, "tick", "kind", F.round(F.col("x") + 1e-8, 4).alias("x"))


@query("player_tracks")
def _(t: Tables):
    pts = t.men.filter("(frame_id + nfl_id * 5) % 13 > 0").select(*FRAME, "x", "y", "club")
    k = tk.track_players(pts, PLAY, "frame_id", "club")
    return k.groupBy(*PLAY).agg(F.count_distinct("track").alias("tracks"), F.count(F.lit(1)).alias("samples"))


@query("ball_tracks")
def _(t: Tables):
    cand = t.ball.filter("frame_id % 6 > 0").select(*FRAME, "x", "y", F.lit(0.9).alias("confidence"))
    return tk.track_balls(cand, t.men.select(*FRAME, "x", "y"), t.ball, PLAY, "frame_id").groupBy(*PLAY, "source").agg(F.count(F.lit(1)).alias("n"))


@query("capped_facing", """WITH RECURSIVE p AS MATERIALIZED (SELECT game_id, play_id, nfl_id, frame_id, t, round(s, 9) > 0.6 AS moving, cdir, CASE WHEN nfl_id < 11 THEN 0.0::DOUBLE ELSE 180.0::DOUBLE END AS rest,
   row_number() OVER (PARTITION BY play_id, nfl_id ORDER BY frame_id) AS k FROM men),
 s AS (SELECT game_id, play_id, nfl_id, frame_id, k, t, CASE WHEN moving THEN cdir ELSE rest END AS o, CASE WHEN moving THEN 'from_velocity' ELSE 'assumed' END AS src FROM p WHERE k = 1
   UNION ALL SELECT p.game_id, p.play_id, p.nfl_id, p.frame_id, p.k, p.t, (s.o + greatest(-250 * (p.t - s.t), least(250 * (p.t - s.t), CASE WHEN round(d, 9) > 180 THEN d - 360 ELSE d END)) + 360) % 360, 'from_velocity'
   FROM s JOIN p ON p.play_id = s.play_id AND p.nfl_id = s.nfl_id AND p.k = s.k + 1, LATERAL (SELECT CASE WHEN p.moving THEN (p.cdir - s.o + 720) % 360 ELSE 0 END AS d) x)
 SELECT game_id, play_id, nfl_id, frame_id, round(sin(radians(o)), 6) AS across, round(cos(radians(o)), 6) AS along, src AS facing_source FROM s""", "men")
def _(t: Tables):
    m = t.men.select(*K, "t", F.col("s").alias("speed"), F.col("cdir").alias("travel"), ts.resting_angle(F.when(F.col("nfl_id") < 11, "offense").otherwise("defense")).alias("rest"))
    f = ts.facing_from_motion(m, [*PLAY, "nfl_id"], "frame_id", "rest")
    return f.select(*K, F.round(F.sin(F.radians("facing")), 6).alias("across"), F.round(F.cos(F.radians("facing")), 6).alias("along"), "facing_source")


@query("track_to_contract")
def _(t: Tables):
    """Resample, smooth, differentiate and orient video tracks."""
    rag = t.men.filter("(frame_id + nfl_id) % 7 > 0").select(*K, "t", "x", "y")
    r = ts.resample(rag, t.player_span(), ["x", "y"], 0.1)
    sp = Span((*PLAY, "nfl_id"), ("tick",), t.player_span().block and "floor(tick / 4096)")
    s = ts.smooth(r, sp, {"sx": "x", "sy": "y"}).withColumns({"x": F.col("sx"), "y": F.col("sy")})
    d = ts.held_direction(ts.kinematics(s.select(*PLAY, "nfl_id", "tick", "t", "x", "y"), sp), sp)
    rest = ts.resting_angle(F.when(F.col("nfl_id") < 11, "offense").otherwise("defense"))
    return ts.facing_from_motion(d.withColumn("rest", rest), [*PLAY, "nfl_id"], "tick", "rest")


@query("user_sessions", """SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR epoch(ts) - epoch(p) >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) a) z GROUP BY user_id, s""")
def _(t: Tables):
    e = t.raw("events").select("user_id", "ts", "event_id")
    # a user may have very many events, so the sequence is cut by the hour
    return live.sessions(e, ["user_id"], "ts", 1800, "event_id", "date_trunc('hour', ts)").select(
        "user_id", *[F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")).alias(c) for c in ("start", "last")], "n")


@query("contact_sessions_by_game", "SELECT game_id, count(*) AS n, sum(end_frame - start_frame)::BIGINT AS frames FROM contacts GROUP BY ALL", "contacts")
def _(t: Tables):
    return contacts(t).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("frames"))


@query("round_trip_error", "SELECT count(*) AS n, 0.0::DOUBLE AS max_x, 0.0::DOUBLE AS max_dir FROM men", "men")
def _(t: Tables):
    back = t.men.withColumn("dir", F.pmod(90.0 - F.col("cdir"), F.lit(360.0)))
    r = ql.round_trip(t.men, back, K, ["x"], ["dir"])
    return r.select("n", F.round("max_x", 6).alias("max_x"), F.round("max_dir", 6).alias("max_dir"))


@query("deduplicated_rows", "SELECT DISTINCT game_id, play_id, frame_id, event FROM trk", "trk")
def _(t: Tables):
    return t.trk.unionByName(t.trk).select(*FRAME, "event").dropDuplicates()


@query("weekly_union", "SELECT week, count(*) AS n FROM (SELECT week FROM plays WHERE week = 1 UNION ALL SELECT week FROM plays WHERE week > 1) z GROUP BY week", "plays")
def _(t: Tables):
    return t.plays.filter("week = 1").unionByName(t.plays.filter("week > 1")).groupBy("week").agg(F.count(F.lit(1)).alias("n"))


@query("anchored_points", """SELECT game_id, play_id, frame_id, kind, count(*) AS n, round(avg(CASE WHEN kind = 'body' THEN y * 10 ELSE y * 10 - 9 END), 4) AS anchor_y FROM (
  SELECT *, CASE WHEN nfl_id % 4 = 3 THEN 'helmet' ELSE 'body' END AS kind FROM men) z GROUP BY ALL""", "men")
def _(t: Tables):
    from snapspan.catalog.q_fields import boxes
    from snapspan.functions.geometry import box_measures
    return box_measures(boxes(t)).groupBy(*FRAME, "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("anchor_y"), 4).alias("anchor_y"))
