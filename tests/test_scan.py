"""Scans over blocks against plain loops, with sequences cut in many blocks."""

import random

import pytest

from snapspan.operators import chains, interactions, timeseries

FRAMES = 300


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_carrier_chain(spark, block):
    rng = random.Random(6)
    rows, want = [], {}
    for play in range(6):
        held, waited, near = -1, 0, 4
        for f in range(FRAMES):
            near = rng.choice([near, near, near, rng.randrange(9)])
            d, declared = rng.choice([0.4, 1.5, 1.6]), (rng.randrange(9) if rng.random() < 0.03 else None)
            rows.append((1, play, f, near, d, declared))
            pick = declared if declared is not None else near if d <= 1.5 else -1
            if pick != held:
                waited += 1
                if declared is not None or waited >= 2:
                    held, waited = pick, 0
            else:
                waited = 0
            want[play, f] = None if held == -1 else held
    df = spark.createDataFrame(rows, "game_id long, play_id long, frame_id int, near_id long, near_dist double, declared long").repartition(3)
    assert {(r["play_id"], r["frame_id"]): r["carrier"] for r in chains.carrier_chain(df, block=block).collect()} == want


@pytest.mark.parametrize("block", [1, 16, 1000])
def test_inferred_holders(spark, block):
    rng = random.Random(7)
    scores, frames, want = [], [], {}
    for play in range(5):
        cur = None
        for f in range(FRAMES):
            t = (f - 20) / 10
            s = {i: rng.choice([0.0, 0.5, 1.0, 2.0, 2.5, 4.0]) for i in rng.sample(range(8), rng.choice([0, 3, 5]))}
            frames.append((1, play, f, t))
            scores += [(1, play, f, i, v) for i, v in s.items()]
            if t >= 0 and s:
                top = min(s, key=lambda k: (-s[k], k))
                if cur is None or s[top] - s.get(cur, 0.0) > 1.5:
                    cur = top
            want[play, f] = cur if t >= 0 else None
    sc = spark.createDataFrame(scores, "game_id long, play_id long, frame_id int, nfl_id long, score double")
    fr = spark.createDataFrame(frames, "game_id long, play_id long, frame_id int, t double").repartition(3)
    got = interactions.inferred_holders(sc, fr, block=block)
    assert got.columns == ["game_id", "play_id", "frame_id", "t", "holder"]
    assert {(r["play_id"], r["frame_id"]): r["holder"] for r in got.collect()} == want


@pytest.mark.parametrize("block", [1, 31, 1000])
def test_facing_from_motion(spark, block):
    rng = random.Random(8)
    rows, want = [], {}
    for who in range(4):
        last, then, t, travel = None, None, 0.0, 10.0
        for f in range(FRAMES):
            t += rng.choice([0.1, 0.1, 0.5])
            travel = (travel + rng.choice([0, 3, 170, 200, -90])) % 360
            speed = rng.choice([0.0, 0.6, 2.0]) if f > 3 else 0.0
            rows.append((1, who, f, t, speed, float(travel), 180.0))
            moving = speed > 0.6
            target = travel if moving else (last if last is not None else 180.0)
            source = "from_velocity" if moving or last is not None else "assumed"
            if last is not None:
                cap, delta = 250.0 * max(t - then, 1e-6), (target - last) % 360.0
                delta -= 360.0 if round(delta, 9) > 180.0 else 0.0
                target = last + max(-cap, min(cap, delta))
            last, then = target % 360.0, t
            want[who, f] = (round(last, 6), source)
    df = spark.createDataFrame(rows, "game_id long, nfl_id long, tick int, t double, speed double, travel double, rest double").repartition(3)
    got = timeseries.facing_from_motion(df, ["game_id", "nfl_id"], "tick", "rest", block=block).collect()
    assert {(r["nfl_id"], r["tick"]): (round(r["facing"], 6), r["facing_source"]) for r in got} == want
