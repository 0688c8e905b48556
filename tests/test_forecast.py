"""Boosted forecasts: what they learn, and that no fold sees its own labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapspan.operators import forecast
from snapspan.schema import FORECAST_FEATURES


def test_boost_learns_an_interaction_and_falls_back_to_the_mean():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = np.where((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3), 4.0, -1.0)
    model = forecast.boost(x[:2000], y[:2000], 60, 0.2, 3)
    assert np.abs(model.predict(x[2000:]) - y[2000:]).mean() < 0.3
    flat = forecast.boost(x[:10], y[:10], 5, 0.2, 3)
    assert np.allclose(flat.predict(x), y[:10].mean()) and forecast.boost(x[:0], y[:0], 5, 0.2, 3).predict(x[:2]).tolist() == [0.0, 0.0]


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(2)
    rows = [(g, p, i, g % 3, 10.0, 20.0, 2.0 + (100.0 if g % 3 == 1 else 0.0), -3.0, *map(float, rng.random(len(FORECAST_FEATURES)))) for g in range(9) for p in range(4) for i in range(10)]
    rows.append((20, 1, 1, 0, 1.0, 1.0, None, None, *[float("nan")] * len(FORECAST_FEATURES)))
    return spark.createDataFrame(rows, "game_id long, play_id long, nfl_id long, week int, x double, y double, tx double, ty double, " + ", ".join(f"{c} double" for c in FORECAST_FEATURES)).repartition(4)


def test_a_fold_never_sees_its_own_labels(samples):
    """Week 1 alone moves by 102: its own forecast is that of the others, and theirs a mixture with it."""
    out = forecast.cross_fit(samples, rounds=3, depth=2)
    assert out.count() == samples.count() and "_own" not in out.columns
    got = {r["week"]: (r["lo"], r["hi"]) for r in out.filter("game_id < 9").groupBy("week").agg(F.min("px").alias("lo"), F.max("px").alias("hi")).collect()}
    assert got[1] == pytest.approx((12.0, 12.0)) and got[0][0] > 15 and out.filter("game_id < 9 and abs(py - 17) > 1e-9").count() == 0


def test_more_folds_than_models(samples):
    out = forecast.cross_fit(samples, rounds=2, depth=2, fold="game_id", most_folds=4)
    assert out.count() == samples.count() and out.filter("px is null").count() == 0
    with pytest.raises(ValueError):
        forecast.cross_fit(samples.filter("game_id = 3"), rounds=1)


def test_fit_and_predict_do_not_depend_on_partitions(samples):
    a, b = (sorted(tuple(r) for r in forecast.predict(forecast.fit(s, rounds=5, depth=2), s).select("game_id", "play_id", "nfl_id", "px").filter("game_id < 9").collect()) for s in (samples, samples.repartition(7)))
    assert a == b
