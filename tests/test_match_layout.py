"""Frame matching leaves the rows of a play where they lie."""

import os

import numpy as np
import pytest

from snapspan.catalog import load
from snapspan.operators import matching as mt

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["tracking_score", "player_score"])
def test_scores_are_counted_where_the_matches_lie(spark, name, capsys):
    load().QUERIES[name](spark, SF).explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


def test_ids_of_any_kind_and_equal_costs(rows):
    schema = "game_id long, play_id long, frame_id int, truth_id string, pred_id string, cost double, note string"
    c = [(1, 1, f, a, b, 1.0, f"{a}{b}") for f in (1, 2, 300) for a in ("u", "v") for b in ("x", "y")]
    got = mt.solve(rows(c[::-1], schema), ["game_id", "play_id", "frame_id"], "truth_id", "pred_id", "cost")
    assert got.columns == [d.split()[0] for d in schema.split(", ")]
    assert sorted((r["frame_id"], r["note"]) for r in got.collect()) == [(f, n) for f in (1, 2, 300) for n in ("ux", "vy")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["tracking_score", "player_score", "condition_summary"])
def test_matches_bring_the_errors_along(spark, name):
    """Truth and prediction are read to be matched and to be counted, and not joined with their matches again."""
    plan = load().QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet spark_catalog.default.tracking_") <= 4 and "array_sort" not in plan


def test_scores_are_the_same_from_bare_matches(spark):
    from snapspan.catalog import q_quality as q
    from snapspan.catalog.registry import Tables
    from snapspan.operators import quality as ql

    t = Tables(spark, SF)
    told = q.matched(t)
    bare = told.drop(*ql.pair_errors()["told"])
    one, other = ({(r["game_id"], r["play_id"]): r.asDict() for r in ql.tracking_score(t.men, q.recovered(t), m).collect()} for m in (told, bare))
    assert one.keys() == other.keys() and all(one[k][c] == pytest.approx(other[k][c], rel=1e-9) for k in one for c in one[k])


def test_grids_solved_together_are_solved_as_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(300):
        rows = int(rng.integers(1, 8))
        shape = (4, rows, int(rng.integers(rows, 8)))
        grids = rng.integers(0, 4, shape).astype(float) if rng.random() < 0.5 else rng.random(shape)
        grids[rng.random(shape) < 0.2] = mt.FAR
        for together, one in zip(mt._all_least(grids), grids):
            assert list(enumerate(together.tolist())) == sorted(mt.least_cost(one))
