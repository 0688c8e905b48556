from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapspan.operators import matching as mt
from snapspan.plans.sequences import span


def brute(left, right, cost):
    """Most pairs first, then least cost, over every one-to-one choice."""
    ls, rs = sorted(set(left)), sorted(set(right))
    at = {(a, b): c for a, b, c in zip(left, right, cost)}
    small, big, flip = (ls, rs, False) if len(ls) <= len(rs) else (rs, ls, True)
    best = None
    for p in permutations(big, len(small)):
        pairs = [(b, a) if flip else (a, b) for a, b in zip(small, p)]
        got = [at[k] for k in pairs if k in at]
        key = (-len(got), sum(got))
        best = key if best is None or key < best else best
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.floats(0, 3)), min_size=1, max_size=16, unique_by=lambda t: t[:2]))
def test_choose_edges_is_optimal(edges):
    left, right, cost = (list(v) for v in zip(*edges))
    codes = lambda v: np.unique(v, return_inverse=True)[1]
    got = mt.choose_edges(codes(left), codes(right), np.array(cost))
    assert len({left[i] for i in got}) == len(got) == len({right[i] for i in got})
    want = brute(left, right, cost)
    assert -len(got) == want[0]
    assert sum(cost[i] for i in got) == pytest.approx(want[1], abs=1e-9)


def test_matching_survives_a_crowded_frame(rows):
    rng = np.random.default_rng(3)
    t = [(1, 1, f, i, float(x), float(y)) for f in range(6) for i, (x, y) in enumerate(rng.uniform(0, 8, (7, 2)))]
    p = [(1, 1, f, 50 + i, float(x), float(y)) for f in range(6) for i, (x, y) in enumerate(rng.uniform(0, 8, (6, 2)))]
    schema = "game_id long, play_id long, frame_id int, id long, x double, y double"
    keys = ["game_id", "play_id", "frame_id"]
    got = mt.match_frames(rows(t, schema), rows(p, schema), keys, "id", "id", gate=3.0).collect()
    for f in range(6):
        a, b = [r for r in t if r[2] == f], [r for r in p if r[2] == f]
        e = [(r[3], q[3], float(np.hypot(r[4] - q[4], r[5] - q[5]))) for r in a for q in b]
        e = [k for k in e if k[2] <= 3.0]
        want = brute(*[list(v) for v in zip(*e)])
        mine = [r for r in got if r["frame_id"] == f]
        assert (-len(mine), pytest.approx(sum(r["d"] for r in mine))) == want


def test_one_box_serves_one_player(rows):
    keys = ["game_id", "play_id", "frame_id"]
    k = "game_id long, play_id long, frame_id int, "
    pts = rows([(1, 1, 1, 1, 50.0, 99.0), (1, 1, 1, 2, 52.0, 90.0), (1, 1, 1, 3, 300.0, 90.0)], k + "pid long, px double, py double")
    box = rows([(1, 1, 1, 7, 45.0, 60.0, 56.0, 100.0)], k + "box long, x1 double, y1 double, x2 double, y2 double")
    got = {r["pid"]: (r["state"], r["miss"]) for r in mt.claim_boxes(pts, box, keys, "pid", "box").collect()}
    assert got[1][0] == "matched" and got[2][0] == "duplicate" and got[3] == ("stray", 244.0)


def test_overlap_suppression_keeps_the_second_behind_a_dropped_one(rows):
    k = "game_id long, play_id long, frame_id int, box long, x1 double, y1 double, x2 double, y2 double, score double"
    b = rows([(1, 1, 1, 1, 0.0, 0.0, 100.0, 10.0, 0.9), (1, 1, 1, 2, 20.0, 0.0, 120.0, 10.0, 0.8),
              (1, 1, 1, 3, 40.0, 0.0, 140.0, 10.0, 0.7), (1, 1, 1, 4, 500.0, 0.0, 510.0, 10.0, 0.1)], k)
    kept = mt.suppress_overlaps(b, ["game_id", "play_id", "frame_id"], "box", 0.55)
    assert sorted(r["box"] for r in kept.collect()) == [1, 3, 4]


def test_switch_is_counted_once(rows):
    m = rows([(1, f, 1, 10 if f < 3 else 11) for f in range(6)], "play long, frame_id int, truth_id long, pred_id long")
    assert mt.switches(m, span(["play", "truth_id"], "frame_id")).agg({"switch": "sum"}).first()[0] == 1


def test_overlap_suppression_is_greedy_in_every_frame_and_keeps_what_has_no_place(spark, rows):
    rng = np.random.default_rng(5)
    made = [(1, p, 1, i, float(x), float(y), float(x + w), float(y + 10), float(s)) for p in range(6) for i, (x, y, w, s) in enumerate(zip(
        rng.integers(0, 60, 30), rng.integers(0, 6, 30), rng.integers(8, 20, 30), rng.integers(0, 5, 30)))]
    k = "game_id long, play_id long, frame_id int, box long, x1 double, y1 double, x2 double, y2 double, score double"
    odd = [(1, 0, 1, 90, None, 0.0, 9.0, 9.0, 9.0), (1, 0, 1, 91, 0.0, 0.0, 60.0, 10.0, None)]
    b = rows(made + odd, k)

    def iou(a, c):
        w, h = max(min(a[6], c[6]) - max(a[4], c[4]), 0), max(min(a[7], c[7]) - max(a[5], c[5]), 0)
        return w * h / ((a[6] - a[4]) * (a[7] - a[5]) + (c[6] - c[4]) * (c[7] - c[5]) - w * h)

    want = {(0, 90), (0, 91)}
    for p in range(6):
        kept = []
        for r in sorted((r for r in made if r[1] == p), key=lambda r: (-r[8], r[3])):
            if all(iou(r, o) < 0.4 for o in kept):
                kept.append(r)
        want |= {(p, r[3]) for r in kept}
    got = mt.suppress_overlaps(b, ["game_id", "play_id", "frame_id"], "box", 0.4)
    assert got.columns == b.columns and {(r["play_id"], r["box"]) for r in got.collect()} == want and got.count() == len(want)


def test_overlap_suppression_shuffles_no_box(spark):
    from snapspan.catalog.q_quality import stacked
    from snapspan.catalog.registry import Tables
    kept = mt.suppress_overlaps(stacked(Tables(spark, "/root/testdata/sf0.001")), ["game_id", "play_id", "frame_id"], "box")
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()


def test_verdicts_shuffle_neither_players_nor_boxes(spark):
    from snapspan.catalog.q_verify import rows as verdicts
    from snapspan.catalog.registry import Tables
    assert "Exchange hashpartitioning" not in verdicts(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()


def test_duplicate_tracks_are_found_without_a_shuffle_of_samples(spark):
    from snapspan.catalog.q_quality import video_tracks
    from snapspan.catalog.registry import Tables
    from snapspan.operators.pairs import duplicate_pairs
    pairs = duplicate_pairs(video_tracks(Tables(spark, "/root/testdata/sf0.001")), "nfl_id", "club", 0.9, 0.6, 4)
    assert "Exchange hashpartitioning" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_overlap_suppression_equals_a_plain_pass_in_crowds_and_odd_boxes(spark, rows):
    """Frames over several batches, one of them a crowd; boxes turned inside out, without a number or score, of text ids; nothing of a row changes on the way."""
    rng = np.random.default_rng(8)
    nan = float("nan")
    made = []
    for f in range(40):
        for i in range(400 if f == 7 else 30):
            x, y, w, h = rng.integers(0, 90), rng.integers(0, 9), rng.integers(-2, 25), rng.integers(4, 12)
            made.append((1, 1, f, f"b{i:03d}", float(x), float(y), float(x + w), float(y + h), float(rng.integers(0, 6)), [i, None], 2**60 + i))
    made += [(1, 1, 3, "nan", nan, 0.0, 50.0, 9.0, 9.0, [], 1), (1, 1, 3, "none", None, 0.0, 50.0, 9.0, 9.0, None, None), (1, 1, 3, "best", 0.0, 0.0, 40.0, 9.0, nan, None, 5), (1, 1, 3, "bare", 0.0, 0.0, 40.0, 9.0, None, None, 6)]

    def over(a, b):
        w, h = max(min(a[6], b[6]) - max(a[4], b[4]), 0), max(min(a[7], b[7]) - max(a[5], b[5]), 0)
        union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h
        return union > 0 and w * h / union >= 0.4

    want = {(3, "nan"), (3, "none"), (3, "bare")}
    for f in range(40):
        kept = []
        for r in sorted((r for r in made if r[2] == f and (f, r[3]) not in want), key=lambda r: (r[8] == r[8], -r[8], r[3])):
            if not any(over(k, r) for k in kept):
                kept.append(r)
        want |= {(f, r[3]) for r in kept}
    k = "game_id long, play_id long, frame_id int, box string, x1 double, y1 double, x2 double, y2 double, score double, more array<long>, big long"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = mt.suppress_overlaps(rows(made, k), ["game_id", "play_id", "frame_id"], "box", 0.4)
        assert got.schema == rows(made, k).schema
        rest = {(r["frame_id"], r["box"]): (r["more"], r["big"]) for r in got.collect()}
        assert rest.keys() == want and all(rest[r[2], r[3]] == (r[9], r[10]) for r in made if (r[2], r[3]) in want)
        assert mt.suppress_overlaps(rows([], k), ["game_id", "play_id", "frame_id"], "box").count() == 0
        whole = rows([(1, 1, 1, 5, 0, 0, 10, 10, 1), (1, 1, 1, 4, 0, 0, 10, 9, 1)], "game_id long, play_id long, frame_id int, box int, x1 int, y1 int, x2 int, y2 int, score int")
        assert [r["box"] for r in mt.suppress_overlaps(whole, ["game_id", "play_id", "frame_id"], "box").collect()] == [4]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_overlap_suppression_sorts_rows_once_and_makes_no_lists(spark):
    from snapspan.catalog.q_quality import stacked
    from snapspan.catalog.registry import Tables
    plan = mt.suppress_overlaps(stacked(Tables(spark, "/root/testdata/sf0.001")), ["game_id", "play_id", "frame_id"], "box")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1 and "collect_list" not in plan
