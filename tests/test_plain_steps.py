"""Steps over every sample run in compiled code, not in folds and value counts that are interpreted."""

import os

import pytest

from snapspan.catalog import load
from snapspan.operators import quality as ql
from snapspan.plans.sequences import span

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name, slow", [("track_to_contract", "aggregate("), ("smoothed_path", "aggregate("), ("angle_conventions", "percentile(")])
def test_no_interpreted_step(spark, name, slow, capsys):
    load().QUERIES[name](spark, SF).explain()
    assert slow not in capsys.readouterr().out


def test_medians_of_even_and_odd_counts(rows):
    k = "game_id long, play_id long, nfl_id long, frame_id int, x double, y double, dir double"
    data = [(1, p, 1, f, float(f), 0.0, d) for p, n in ((1, 3), (2, 4)) for f, d in enumerate([0.0, 91.0, 93.0, 98.0, 100.0][: n + 1])]
    got = {(r["play_id"], r["reading"]): r["median_error"] for r in ql.angle_conventions(rows(data, k), span(["game_id", "play_id", "nfl_id"], "frame_id")).collect()}
    assert got[1, "compass_cw_from_y"] == 3.0 and got[2, "compass_cw_from_y"] == 5.5 and len(got) == 8
