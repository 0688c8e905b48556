"""Known answers on hand-made plays."""

import pytest
from pyspark.sql import functions as F

from snapspan.functions import angles, coding, geometry as g
from snapspan.operators import interactions as ia, library as lb, review as rv, roster as rs
from snapspan.plans.sequences import span
from snapspan.sources import readers as rd

PLAY = ["game_id", "play_id"]
MEN = "game_id long, play_id long, frame_id int, t double, nfl_id long, club string, x double, y double, s double, cdir double"


def test_angles(spark):
    r = spark.range(1).select(
        angles.wrap_deg(F.lit(-1e-15)).alias("a"), angles.turn_deg(F.lit(359.0), F.lit(1.0)).alias("b"),
        angles.turn_deg(F.lit(0.0), F.lit(180.0)).alias("c"), angles.compass_flip(angles.compass_flip(F.lit(33.0))).alias("d")).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (0.0, 2.0, 180.0, 33.0)


def test_names(spark):
    m = lambda a, b: spark.range(1).select(coding.name_matches(F.lit(a), F.lit(b))).first()[0]
    assert m("J.Chase", "Ja'Marr Chase") and not m("T.Chase", "Ja'Marr Chase") and not m("J.Hill", "Ja'Marr Chase")
    t = spark.range(1).select(coding.named_target(F.lit("(9:01) B.Q pass short left to J.Chase to CIN 40"))).first()[0]
    assert t == "J.Chase"


def contact_play(gap_frames):
    """Two men touching on frames 1-5 and again after a hole."""
    out = []
    for f in range(1, 20):
        near = f <= 5 or (5 + gap_frames < f <= 10 + gap_frames)
        out.append((1, 1, f, (f - 1) / 10, 1, "A", 10.0, 10.0, 5.0 if f < 4 else 1.0, 0.0))
        out.append((1, 1, f, (f - 1) / 10, 2, "B", 11.0 if near else 20.0, 10.0, 3.0, 0.0))
    return out


@pytest.mark.parametrize("gap,expected", [(3, 1), (4, 2)])
@pytest.mark.parametrize("block", [None, "floor(frame_id / 3)"])
def test_contact_grace(rows, gap, expected, block):
    men = rows(contact_play(gap), MEN)
    held = men.filter("nfl_id = 1").select(*PLAY, "frame_id", "t", F.col("nfl_id").alias("holder"))
    c = ia.engagements(men, held, span(PLAY, "frame_id", block)).orderBy("start_frame").collect()
    assert len(c) == expected
    assert c[0]["start_frame"] == 1 and c[0]["kind"] == "tackle" and c[0]["down_frame"] == 4


def test_possession_run_ends_on_its_last_sample(rows):
    f = rows([(1, 1, i, i / 10, h) for i, h in enumerate([7, 7, None, None, 8, 7])], "game_id long, play_id long, frame_id int, t double, holder long")
    r = ia.possession_runs(f, span(PLAY, "frame_id")).orderBy("start_frame").collect()
    assert [(x["holder"], x["start_frame"], x["end_frame"]) for x in r] == [(7, 0, 1), (None, 2, 3), (8, 4, 4), (7, 5, 5)]


def test_review_flags_the_open_man(rows):
    cols = "game_id long, play_id long, nfl_id long, position string, offense int, route int, target int, px double, py double, x_arr double, y_arr double, los double, throw int, arrival int"
    man = lambda i, pos, off, route, tgt, x, y: (1, 1, i, pos, off, route, tgt, x, y, x, y, 40.0, 25, 33)
    p = rows([man(1, "QB", 1, 0, 0, 30.0, 26.0), man(2, "WR", 1, 1, 1, 50.0, 10.0), man(3, "WR", 1, 1, 0, 52.0, 45.0),
              man(11, "CB", 0, 0, 0, 50.5, 10.0), man(12, "CB", 0, 0, 0, 45.0, 30.0)], cols)
    plays = rows([(1, 1, 2, "x", "I", 0)], "game_id long, play_id long, down int, description string, pass_result string, yards_gained int")
    rep = rv.review_passes(p, plays)
    r = rep.first()
    assert r["decision"] == "consider_alternative" and r["evidence"]["alternative_id"] == 3 and r["confidence"] == "low"
    assert rv.recommendation_problems(rv.recommendations(rep)).first()["problems"] == []


def test_simulation_ids_match_the_sequential_rule(rows):
    taken = [(1, i) for i in (10, 11, 13, 14, 15, 20)] + [(2, 5)]
    src = [(1, 10), (1, 11), (1, 13), (1, 20), (2, 5)]
    used, want = set(taken), {}
    for game, play in src:
        c = play + 1
        while (game, c) in used:
            c += 1
        used.add((game, c))
        want[(game, play)] = c
    k = "game_id long, play_id long"
    for block in (None, "floor({} / 4)"):
        got = lb.simulation_ids(rows(src, k), rows(taken, k), rows([], k + ", simulation_id long"), block)
        assert {(r["game_id"], r["play_id"]): r["simulation_id"] for r in got.collect()} == want


def test_the_motion_of_a_chain_is_worked_out_once(monkeypatch):
    """Of 60 tracks in four rounds each chain goes on, and no pair asks again where a chain is heading."""
    from snapspan.schema import StitchRules

    calls, motion = [], rs._motion
    monkeypatch.setattr(rs, "_motion", lambda tail, rules: calls.append(1) or motion(tail, rules))
    at = lambda who, t: (t, 2.0 * t, 4.0 * who)
    ends = [(100 * k + who, 1.4 * k, *at(who, 1.4 * k)[1:], [at(who, 1.4 * k + step / 10) for step in range(6, 10)]) for k in range(4) for who in range(15)]
    got = rs._folded(ends, StitchRules())
    assert [(kept, part) for kept, part, _ in got] == [(who, 100 * k + who) for k in range(1, 4) for who in range(15)]
    assert len(calls) == len(ends) and max(miss for *_, miss in got) < 1e-9


def test_stitching_joins_a_chain_of_three(rows):
    s = []
    for piece, frames in ((1, range(0, 5)), (2, range(8, 12)), (3, range(15, 20))):
        s += [(1, 1, f, f / 10, piece, 10 + 0.5 * f, 20.0) for f in frames]
    s += [(1, 1, f, f / 10, 9, 90.0, 5.0) for f in range(0, 20)]
    df = rows(s, "game_id long, play_id long, frame_id int, t double, pid long, x double, y double")
    got = {r["part"]: r["kept"] for r in rs.stitch(rs.track_ends(df, "pid"), "pid").collect()}
    assert got == {2: 1, 3: 1}


def test_duplicates_fold_into_the_longest(rows):
    s = [(1, 1, f, i, "A", 10.0 + 0.1 * i, 20.0) for i, n in ((1, 20), (2, 12), (3, 8)) for f in range(n)]
    s += [(1, 1, f, 7, "A", 12.0, 20.0) for f in range(20)]
    tracks, report = rs.consolidate(rows(s, "game_id long, play_id long, frame_id int, nfl_id long, club string, x double, y double"))
    assert {r["nfl_id"]: (r["status"], r["winner"]) for r in tracks.collect()} == {
        1: ("kept", None), 2: ("merged", 1), 3: ("merged", 1), 7: ("kept", None)}
    assert report.first()["kept"] == 2


def test_projection_inverts(spark):
    h = F.array(*[F.lit(v) for v in (12.0, 0.4, 30.0, 0.2, 11.0, 15.0, 0.0, 0.002, 1.0)])
    p = spark.range(1).select(g.project(h, F.lit(33.0), F.lit(21.0)).alias("p"), h.alias("h"))
    r = p.select(g.project(g.invert3(F.col("h")), F.col("p.x"), F.col("p.y")).alias("q")).first()["q"]
    assert (r["x"], r["y"]) == (pytest.approx(33.0), pytest.approx(21.0))


def test_release_csv_with_other_names(spark, tmp_path):
    (tmp_path / "w.csv").write_text("game_play,NFL_player_id,frame.id,X,y,extra\n58168_003392,7,3,1.5,2.5,z\n58168_003392,NA,3,9,9,z\n")
    r = rd.load_tracking(spark, str(tmp_path / "w.csv")).orderBy("x").collect()
    assert (r[0]["game_id"], r[0]["play_id"], r[0]["frame"], r[0]["x"]) == ("58168", "003392", 3, 1.5)
    with pytest.raises(ValueError, match="missing"):
        rd.resolve_columns(["x", "y"])


def test_weekly_files_and_subset(spark, tmp_path):
    for n in ("plays", "player_play", "players"):
        (tmp_path / f"{n}.csv").write_text("a\n1\n")
    (tmp_path / "games.csv").write_text("gameId,week\n1,1\n2,2\n")
    (tmp_path / "tracking_week_1.csv").write_text("gameId,x\n1,5\n2,6\n")
    (tmp_path / "tracking_week_2.csv").write_text("gameId,x\n2,7\n")
    assert rd.load_weeks(spark, str(tmp_path))["tracking"].count() == 3
    one = rd.load_weeks(spark, str(tmp_path), [1])["tracking"].collect()
    assert [(r["gameId"], r["source_file"]) for r in one] == [("1", "tracking_week_1.csv")]


def test_documents_are_refused_with_a_reason(spark):
    docs = spark.createDataFrame([('{"schemaVersion":2,"gameId":1,"playId":1,"frames":[{"frameId":1}]}',), ('{"schemaVersion":1,"gameId":1,"playId":2,"frames":[]}',)], "value string")
    got = rd.documents_to_rows(rd.parse_documents(docs))
    assert sorted(r["problem"] for r in got["problems"].collect()) == ["newer schema version", "no frames"]
    with pytest.raises(ValueError):
        rd.documents_to_rows(rd.parse_documents(docs), strict=True)


def test_cross_fit_query_keeps_the_defaults(monkeypatch):
    """The query fits as many rounds, as deep, as the operator does by default."""
    import inspect

    from snapspan.catalog import load, q_review

    seen = {}
    fit = inspect.signature(q_review.fc.fit).parameters

    def cross_fit(samples, rounds=300, fold=None, **kw):
        seen.update({"rounds": rounds, "depth": fit["depth"].default} | kw)

    monkeypatch.setattr(q_review.fc, "cross_fit", cross_fit)
    monkeypatch.setattr(q_review, "samples", lambda t: None)
    monkeypatch.setattr(q_review.rv, "error_table", lambda fitted: fitted)
    load().QUERIES["cross_fit_errors"](None, "")
    assert seen == {"rounds": 300, "depth": 5}
