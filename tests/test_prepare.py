"""Clip preparation by hand-made clips, one play for each thing that may be missing."""

import tempfile

import pytest

from snapspan.operators.prepare import Settings, prepare
from snapspan.plans.stages import Stages

CLIP = "game_id long, play_id long, snap int, trustworthy boolean, render_problems array<string>, los double, attacks string, yards_to_go double, offense string, measured_share double, travelled double"


def clip(play, attacks="right", gap=1.0, ball=True, still=False, third=False):
    """Twenty-two men in two ranks at the snap, a ball thrown thirty yards."""
    sign = 1 if attacks == "right" else -1
    men, balls = [], []
    for f in range(1, 31):
        for i in range(22):
            off = i < 11
            x = 60 - sign * gap / 2 - sign * (i % 4) if off else 60 + sign * gap / 2 + sign * (i % 4)
            men.append((1, play, f, i, "teamA" if off else "teamB", x + (sign * 0.3 * max(f - 10, 0) if off else 0.0), 5.0 + 2 * i, 0.0, 90.0, 45.0))
        if third:
            men.append((1, play, f, 50, "other", 20.0, 20.0, 0.0, 90.0, 45.0))
        if ball:
            balls.append((1, play, f, (f - 10) / 10, 60 - sign * 7 + sign * (0.0 if still else 2.5 * min(max(f - 12, 0), 12)), 25.0))
    return men, balls


@pytest.fixture(scope="module")
def tables(spark):
    plays = {
        1: clip(1), 2: clip(2, "left"), 3: clip(3, ball=False), 4: clip(4), 5: clip(5, still=True), 6: clip(6), 7: clip(7), 8: clip(8, gap=26.0), 9: clip(9), 10: clip(10, third=True), 11: clip(11)}
    men = [r for m, _ in plays.values() for r in m]
    balls = [r for _, b in plays.values() for r in b]
    base = dict(trust=True, bad=[], los=60.0, attacks="right", togo=6.0, offense=None, measured=0.6, far=30.0)
    change = {2: dict(attacks="left"), 3: dict(measured=None, far=None), 4: dict(measured=0.05), 5: dict(far=2.4), 6: dict(trust=False, bad=["collinear", "folded", "third"]),
              7: dict(los=None, attacks=None, togo=None), 8: dict(los=None, attacks=None), 9: dict(offense="teamB"), 11: dict(attacks=None)}
    clips = [(1, p, 10, *{**base, **change.get(p, {})}.values()) for p in plays]
    return (spark.createDataFrame(men, "game_id long, play_id long, frame_id int, nfl_id long, club string, x double, y double, s double, dir double, o double"),
            spark.createDataFrame(balls, "game_id long, play_id long, frame_id int, t double, x double, y double"), spark.createDataFrame(clips, CLIP))


@pytest.fixture(scope="module")
def made(spark, tables):
    return prepare(*tables, Stages(spark, "clips", "v1", tempfile.mkdtemp(prefix="spark-", dir="/tmp")))


def test_report(made):
    got = {r["play_id"]: r for r in made["report"].collect()}
    assert len(got) == 11
    a = got[1]
    assert a["reviewable"] and a["offense"] == "teamA" and a["method"] == "behind_the_los" and a["line_source"] == "broadcast" and a["first_down_line"] == 66.0 and a["kept"] == 22 and not a["notes"]
    assert a["thrown_at"] == pytest.approx(0.2) and a["arrived_at"] == pytest.approx(1.4)
    assert got[2]["mirrored"] and got[2]["line_of_scrimmage"] == 60.0 and got[2]["reviewable"]
    assert got[3]["blockers"][0].startswith("no ball track") and not got[3]["has_ball"]
    assert "5 %" in got[4]["blockers"][0] and got[4]["thrown_at"] is None
    assert "2.4 yards" in got[5]["blockers"][0]
    assert got[6]["blockers"] == ["the registration is not trustworthy, so nothing here is in yards: collinear; folded"]
    assert got[7]["line_source"] == "formation" and got[7]["reviewable"] and any("distance" in n for n in got[7]["notes"]) and got[7]["attacks"] == "right"
    assert got[8]["line_source"] is None and "not a snap" in got[8]["blockers"][0]
    assert (got[9]["offense"], got[9]["method"], got[9]["confidence"]) == ("teamB", "caller", 1.0)
    assert got[10]["unlabelled"] == 1 and got[10]["confidence"] > 0.9
    assert "attacks" in got[11]["blockers"][0] and len(got[11]["blockers"]) == 1


def test_left_plays_are_turned(made):
    x = {(r["nfl_id"]): r for r in made["samples"].filter("play_id = 2 and frame_id = 10").collect()}
    assert x[0]["x"] == 59.5 and x[0]["dir"] == 270.0 and made["ball"].filter("play_id = 2 and frame_id = 30").first()["x"] == 83.0


def test_second_call_reads_and_a_changed_setting_runs_from_there(spark, tables):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    first, second, third, other = (Stages(spark, "clips", v, folder) for v in ("v1", "v1", "v1", "v2"))
    names = ["roster", "men", "sides", "line", "turned", "ball", "throw", "report"]
    want = prepare(*tables, first)["report"].orderBy("play_id").collect()
    assert first.ran == names and first.read == []
    assert prepare(*tables, second)["report"].orderBy("play_id").collect() == want and second.ran == [] and second.read == names
    prepare(*tables, third, Settings(min_measured=0.01))
    assert third.read == names[:-1] and third.ran == ["report"]
    prepare(*tables, other)
    assert other.ran == names
