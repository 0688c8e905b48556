"""Blocked windows must equal plain ones whatever the block size."""

import random

import pytest
from pyspark.sql import functions as F

from snapspan.plans import sequences as sq
from snapspan.plans.ranking import global_rank, ntile
from snapspan.operators import timeseries as ts


@pytest.fixture
def series(rows):
    rng = random.Random(5)
    data = []
    for key, n in ((1, 60), (2, 7), (3, 1)):
        for f in sorted(rng.sample(range(200), n)):
            data.append((key, f, rng.uniform(0, 100), rng.uniform(0, 50), rng.choice([None, rng.random()])))
    return rows(data, "k long, f int, x double, y double, v double")


def same(a, b, cols):
    key = lambda r: (r["k"], r["f"])
    for p, q in zip(sorted(a.collect(), key=key), sorted(b.collect(), key=key), strict=True):
        for c in cols:
            assert (p[c] is None) == (q[c] is None)
            assert p[c] is None or p[c] == pytest.approx(q[c]), (p, q, c)


@pytest.mark.parametrize("size", [1, 3, 16, 500])
def test_blocked_equals_plain(series, size):
    plain, cut = sq.span(["k"], "f"), sq.span(["k"], "f", f"floor(f / {size})")

    def run(sp):
        d = sq.shift(series, sp, {"a": "x"}, -1)
        d = sq.shift(d, sp, {"b": "x", "c": "y"}, 2)
        d = sq.running_sum(d, sp, F.round(F.col("x")), "s")
        d = sq.running(d, sp, F.col("y"), "m", "max")
        d = sq.last_known(d, sp, F.col("v"), "l")
        d = sq.last_known(d, sp, F.col("v"), "p", include_self=False)
        return sq.position(d, sp, "n")

    same(run(plain), run(cut), ["a", "b", "c", "s", "m", "l", "p", "n"])


@pytest.mark.parametrize("size", [5, 40])
def test_blocked_smoothing_and_kinematics(series, size):
    plain, cut = sq.span(["k"], "f"), sq.span(["k"], "f", f"floor(f / {size})")

    def run(sp):
        d = ts.smooth(series.withColumn("t", F.col("f") / 10), sp, {"sx": "x"})
        return ts.held_direction(ts.kinematics(d, sp), sp)

    same(run(plain), run(cut), ["sx", "vx", "speed", "accel", "step", "travel"])


def test_global_rank_with_a_hot_value(rows):
    rng = random.Random(1)
    data = [(i, 5.0 if rng.random() < 0.5 else round(rng.uniform(0, 10), 1)) for i in range(500)]
    got = global_rank(rows(data, "id long, v double"), "v", "id", "r", "n", parts=8)
    got = got.withColumn("tile", ntile(F.col("r"), F.col("n"), 7))
    rows_ = {r["id"]: r for r in got.collect()}
    order = sorted(data, key=lambda d: (d[1], d[0]))
    sizes = [500 // 7 + (1 if i < 500 % 7 else 0) for i in range(7)]
    tiles = [i + 1 for i, s in enumerate(sizes) for _ in range(s)]
    assert [rows_[i]["r"] for i, _ in order] == list(range(1, 501))
    assert [rows_[i]["tile"] for i, _ in order] == tiles
