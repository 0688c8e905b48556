"""Shot segmentation and the census over frame descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapspan.plans.sequences import Span, islands, running_sum, shift


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms, each with its own mass."""
    mass = lambda h: F.aggregate(h, F.lit(0.0), lambda s, v: s + v)
    cross = F.aggregate(F.zip_with(a, b, lambda p, q: F.sqrt(p * q)), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(mass(a) * mass(b))
    return F.sqrt(F.greatest(1.0 - F.when(norm > 0, cross / norm).otherwise(F.lit(0.0)), F.lit(0.0)))


def segment(frames: DataFrame, sp: Span, cut: float = 0.35, min_frames: int = 8) -> DataFrame:
    """Shots between cuts, with their means. ``sp`` orders descriptors of one clip by frame."""
    at = sp.order[0]
    f = shift(frames, sp, {"_h": "hist", "_prev": at}, -1)
    f = f.withColumn("jump", F.when(F.col("_h").isNotNull(), bhattacharyya(F.col("_h"), F.col("hist"))))
    f = f.withColumn("is_cut", F.coalesce(F.col("jump") >= cut, F.lit(False)))
    f = islands(f, sp, F.col("is_cut") | F.col("_prev").isNull(), "shot")
    first = F.col("is_cut") | F.col("_prev").isNull()
    g = f.groupBy(*sp.keys, "shot").agg(
        F.min(at).alias("start_frame"), F.max(at).alias("end_frame"), F.avg("turf").alias("turf"), F.stddev_pop("turf").alias("turf_sd"),
        F.avg("grid").alias("grid"), F.avg("blob").alias("blob"), F.avg("bright").alias("brightness"),
        F.coalesce(F.avg(F.when(~first, F.col("motion"))), F.lit(0.0)).alias("motion"),
        F.coalesce(F.max(F.when(F.col("is_cut"), F.col("jump"))), F.lit(0.0)).alias("cut_in"))
    return g.filter(F.col("end_frame") - F.col("start_frame") + 1 >= min_frames)


def _ramp(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))


def playlike(shots: DataFrame, fps: float) -> DataFrame:
    """Geometric mean of four clipped features; 0 when any of them is."""
    secs = (F.col("end_frame") - F.col("start_frame") + 1) / F.lit(fps)
    parts = [_ramp((F.col("grid") - 0.55) / 0.2), _ramp((0.45 - F.col("blob")) / 0.2), _ramp(F.col("motion") / 0.04),
             _ramp((secs - 2.0) / 2.0) * _ramp((60.0 - secs) / 20.0)]
    low = F.least(*parts)
    mean = F.exp((F.log(parts[0]) + F.log(parts[1]) + F.log(parts[2]) + F.log(parts[3])) / 4.0)
    return shots.withColumns({"seconds": secs, "score": F.when(low <= 0, 0.0).otherwise(mean)})


def census(shots: DataFrame, threshold: float = 0.35) -> DataFrame:
    hit = F.col("score") >= threshold
    return shots.agg(F.count(F.lit(1)).alias("shots"), (F.sum("seconds") / 60).alias("minutes"), F.percentile(F.round("seconds", 6), F.lit(0.5)).alias("median_seconds"),
                     F.count_if(hit).alias("candidates"), (F.sum(F.when(hit, F.col("seconds")).otherwise(0.0)) / F.sum("seconds")).alias("candidate_share"),
                     F.count_if(F.col("turf") > 0.4).alias("on_grass"))


def best_shots(shots: DataFrame, n: int = 12, threshold: float = 0.35) -> DataFrame:
    return shots.filter(F.col("score") >= threshold).orderBy(F.desc("score"), *[c for c in shots.columns if c in ("clip", "start_frame")]).limit(n)


def snap_sample(signal: DataFrame, sp: Span, value: str) -> DataFrame:
    """Sample after the sharpest rise of a five-sample average, 0 for a signal shorter than 12.

    The average is padded with zeros at both ends.
    """
    s = signal
    for k in (1, 2):
        s = shift(s, sp, {f"_b{k}": value}, -k)
        s = shift(s, sp, {f"_f{k}": value}, k)
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = s.withColumn("_avg", (z("_b2") + z("_b1") + F.col(value) + z("_f1") + z("_f2")) / 5)
    s = running_sum(s, sp, F.lit(1), "_k")
    s = shift(s, sp, {"_next": "_avg"}, 1)
    rise = F.round(F.col("_next") - F.col("_avg"), 12)
    g = s.groupBy(*sp.keys).agg(F.count(F.lit(1)).alias("n"), F.min_by("_k", F.when(rise.isNotNull(), F.struct(-rise, "_k"))).alias("_at"))
    return g.select(*sp.keys, F.when(F.col("n") < 12, 0).otherwise(F.col("_at")).cast("int").alias("snap_sample"))
