"""Boosted-tree forecasts of where players are at the catch.

Trees are fitted on a bounded sample of labelled players (``sample`` rows, in the order of a hash), one model for each axis of the displacement and, in cross-fitting, for each fold; all
these fits run side by side, each in a task of its own. Every row is predicted. Features are cut into at most 64 bins by quantiles; trees grow level by level on sums per bin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapspan.plans.session import cut_lineage
from snapspan.schema import FORECAST_FEATURES

AXES = {"mx": "tx", "my": "ty"}
BINS, LEAST = 64, 20


@dataclass
class Trees:
    """Full trees of one depth: per tree the feature and the bin edge of each inner node, and the value of each leaf."""

    base: float
    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        out = np.full(len(x), self.base)
        depth = self.value.shape[1].bit_length() - 1
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (bins[rows, f[at]] > c[at])
            out += v[node]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1).astype(np.int64)


def boost(x: np.ndarray, y: np.ndarray, rounds: int, step: float, depth: int) -> Trees:
    """Least-squares boosting; a node that no cut improves sends all its rows left."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for c in x.T]
    bins, n_f = binned(x, edges), x.shape[1]
    place = bins + np.arange(n_f) * BINS
    base = float(y.mean()) if len(y) else 0.0
    left_over = y - base
    feature, cut, value = [], [], []
    for _ in range(rounds if len(y) else 0):
        node, fs, cs = np.zeros(len(y), np.int64), [], []
        weight = np.repeat(left_over, n_f)
        for level in range(depth):
            width = 1 << level
            key = (node[:, None] * (n_f * BINS) + place).ravel()
            n = np.bincount(key, minlength=width * n_f * BINS).reshape(width, n_f, BINS).cumsum(2).astype(float)
            s = np.bincount(key, weight, width * n_f * BINS).reshape(width, n_f, BINS).cumsum(2)
            all_n, all_s = n[:, :, -1:], s[:, :, -1:]
            right = all_n - n
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s * s / n + (all_s - s) ** 2 / right - all_s * all_s / all_n
            gain[(n < LEAST) | (right < LEAST)] = 0.0
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            useful = flat[np.arange(width), best] > 1e-9
            f, c = np.where(useful, best // BINS, 0), np.where(useful, best % BINS, BINS)
            fs.append(f)
            cs.append(c)
            node = 2 * node + (bins[np.arange(len(y)), f[node]] > c[node])
        leaves = 1 << depth
        n = np.bincount(node, minlength=leaves)
        v = step * np.bincount(node, left_over, leaves) / np.maximum(n, 1)
        left_over = left_over - v[node]
        feature.append(np.concatenate(fs))
        cut.append(np.concatenate(cs))
        value.append(v)
    shape = (0, (1 << depth) - 1)
    return Trees(base, edges, np.array(feature, np.int64).reshape(shape if not feature else (len(feature), -1)), np.array(cut, np.int64).reshape(shape if not cut else (len(cut), -1)),
                 np.array(value, float).reshape((0, 1 << depth) if not value else (len(value), -1)))


def _fit_all(rows: DataFrame, rounds: int, step: float, depth: int) -> dict:
    """(fold, axis) -> model, from rows with ``_fold`` (the fold a model is for, never one of its own rows)."""
    import pickle

    labels = list(AXES.items())
    each = rows.select("_fold", *FORECAST_FEATURES, F.explode(F.array(*[F.struct(F.lit(out).alias("axis"), F.col(label).alias("label")) for out, label in labels])).alias("l"))
    each = each.select("_fold", *FORECAST_FEATURES, "l.*").repartition("_fold", "axis")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*FORECAST_FEATURES, "label"])  # the same trees whatever the order of rows
        model = boost(pdf[FORECAST_FEATURES].to_numpy(float), pdf["label"].to_numpy(float), rounds, step, depth)
        return pd.DataFrame({"_fold": [key[0]], "axis": [key[1]], "model": [pickle.dumps(model)]})

    made = each.groupBy("_fold", "axis").applyInPandas(run, "_fold long, axis string, model binary").collect()
    return {(r["_fold"], r["axis"]): pickle.loads(r["model"]) for r in made}


def _number(c: str) -> Column:
    return F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: _number(c) for c in FORECAST_FEATURES})


def _labelled(samples: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows with a label, those with the least hashes (and their ties)."""
    rows = _filled(samples.filter("tx is not null and ty is not null")).withColumn("_h", F.xxhash64("game_id", "play_id", "nfl_id"))
    least = rows.select("_h").orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    return rows.filter(F.col("_h") <= F.lit(least if least is not None else 0)).drop("_h")


def fit(samples: DataFrame, rounds: int = 300, step: float = 0.08, depth: int = 5, sample: int = 20_000) -> dict:
    """One model for each axis of the displacement, for :func:`predict`."""
    return _fit_all(_labelled(samples, sample).withColumn("_fold", F.lit(0).cast("long")), rounds, step, depth)


def predict(models: dict, samples: DataFrame, fold: str | None = None) -> DataFrame:
    """Forecast position = state at the throw plus predicted displacement. ``fold`` names a column with the model's fold."""
    models = samples.sparkSession.sparkContext.broadcast(models)
    at = F.col(fold).cast("long") if fold else F.lit(0).cast("long")

    @F.pandas_udf("struct<mx double, my double>")
    def moved(which: pd.Series, *features: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(float) for c in features], 1)
        out = np.zeros((len(x), 2))
        for k in which.unique():
            own = (which == k).to_numpy()
            for j, axis in enumerate(AXES):
                out[own, j] = models.value[k, axis].predict(x[own])
        return pd.DataFrame(out, columns=list(AXES))

    out = samples.withColumn("_m", moved(at, *[_number(c) for c in FORECAST_FEATURES]))
    return out.withColumns({"px": F.col("x") + F.col("_m.mx"), "py": F.col("y") + F.col("_m.my")}).drop("_m")


def cross_fit(samples: DataFrame, rounds: int = 300, fold: str | None = None, step: float = 0.08, depth: int = 5, sample: int = 20_000, most_folds: int = 32) -> DataFrame:
    """Every row predicted by models that never saw its fold.

    ``fold`` names the column of the folds; by default the week, or the game where there is one week only. More than ``most_folds`` values share folds by a hash, so the number of models is bounded; each
    value is whole in one fold. All folds learn from one sample of at most ``sample`` rows, each without its own.
    """
    samples = cut_lineage(samples)
    column = fold or ("week" if samples.select("week").distinct().limit(2).count() > 1 else "game_id")
    if samples.select(column).distinct().limit(2).count() < 2:
        raise ValueError("need at least two weeks or games to hold one out")
    few = [r[0] for r in samples.select(column).distinct().orderBy(column).limit(most_folds + 1).collect()]
    if len(few) <= most_folds:
        number = F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(few)])
    else:
        number = F.pmod(F.xxhash64(column), F.lit(most_folds))
    samples = samples.withColumn("_own", number.cast("long"))
    folds = [r[0] for r in samples.select("_own").distinct().collect()]
    learn = cut_lineage(_labelled(samples, sample)).withColumn("_fold", F.explode(F.array(*[F.lit(f).cast("long") for f in folds]))).filter("_fold <> _own")
    return predict(_fit_all(learn, rounds, step, depth), samples, "_own").drop("_own")
