"""Greedy choices in rounds against a plain greedy pass."""

import itertools
import math
import random

from snapspan.catalog import load
from snapspan.operators import pairs, roster
from snapspan.plans.choice import refused


def test_refused_equals_a_greedy_pass(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)} | {(i, i + 1) for i in range(200, 260)})
    out = set()
    for b in sorted({x for e in edges for x in e}):
        if any(e[1] == b and e[0] not in out for e in edges):
            out.add(b)
    got = refused(spark.createDataFrame(edges, "before long, after long"))
    assert sorted(r["node"] for r in got.collect()) == sorted(out)
    assert refused(spark.createDataFrame([], "before long, after long")).count() == 0


def test_folded_duplicates_equal_a_greedy_pass(spark):
    rng = random.Random(4)
    lives = {(p, i): rng.randint(1, 6) for p in range(4) for i in range(14)}
    close = [(1, p, a, b) for p in range(4) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.25]
    want = []
    for p in range(4):
        rows = []
        for _, q, a, b in close:
            if q == p:
                w, l = (a, b) if (-lives[p, a], a) < (-lives[p, b], b) else (b, a)
                rows.append((-lives[p, w], w, -lives[p, l], l))
        gone = set()
        for _, w, _, l in sorted(rows):
            if w not in gone and l not in gone:
                gone.add(l)
                want.append((p, l, w))
    pr = spark.createDataFrame(close, "game_id long, play_id long, a long, b long")
    lf = spark.createDataFrame([(1, p, i, n) for (p, i), n in lives.items()], "game_id long, play_id long, nfl_id long, life long")
    assert sorted((r["play_id"], r["loser"], r["winner"]) for r in roster.fold_duplicates(pr, lf, "nfl_id").collect()) == sorted(want)


def test_duplicate_pairs_at_the_thresholds(spark):
    """Four shared frames and three of five close are enough; three shared or half close are not."""
    rows = []
    for f in range(5):
        rows += [(1, 1, f, 1, "A", 10.0, 10.0), (1, 1, f, 2, "A", 10.0 + (0.75 if f < 3 else 5.0), 10.0), (1, 1, f, 3, "B", 10.0, 10.0)]
        if f < 4:
            rows.append((1, 1, f, 4, "A", 10.0, 40.0 if f < 2 else 10.4))
        if f < 3:
            rows.append((1, 1, f, 5, "A", 9.5, 10.0))
    df = spark.createDataFrame(rows, "game_id long, play_id long, frame_id int, nfl_id long, club string, x double, y double")
    got = {(r["a"], r["b"]): (r["shared"], r["close"]) for r in pairs.duplicate_pairs(df, "nfl_id", "club", 0.9, 0.6, 4).collect()}
    assert got == {(1, 2): (5, 3)}


def test_duplicate_pairs_equal_all_pairs_on_odd_rows(rows):
    """Equal places, repeated rows, missing places, teams and frames: counted as a join of all rows with all rows of their frame would."""
    rng = random.Random(23)
    data = [(1, p, rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice(["A", "A", "B", None]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, float("nan"), 0.0, -0.0, 10.0, 10.9, 10.9, 10.95, 11.8]), rng.choice([5.0, 5.0, 5.5]))
            for p in (1, 2) for _ in range(150)]
    want = {}
    for (g, p, f, team, a, x, y), (g2, p2, f2, team2, b, x2, y2) in itertools.product(data, data):
        if None not in (f, team, a, b) and (g, p, f, team) == (g2, p2, f2, team2) and a < b:
            of = want.setdefault((p, team, a, b), [0, 0])
            of[0] += 1
            of[1] += None not in (x, x2) and math.sqrt((x - x2) ** 2 + (y - y2) ** 2) <= 0.9
    df = rows(data, "game_id long, play_id long, frame_id int, club string, nfl_id long, x double, y double")
    got = {(r["play_id"], r["club"], r["a"], r["b"]): [r["shared"], r["close"]] for r in pairs.duplicate_pairs(df, "nfl_id", "club", 0.9, 0.2, 2).collect()}
    assert got and got == {k: v for k, v in want.items() if v[0] >= 2 and v[1] / v[0] >= 0.2}


def test_consolidated_samples_are_read_once_after_the_tracks(spark):
    """Twins and tracks come from written rows; the last plan scans the tracking table once and sorts it once."""
    plan = load().QUERIES["consolidated_samples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("tracking_") == 1 and "ShuffledHashJoin" in plan
