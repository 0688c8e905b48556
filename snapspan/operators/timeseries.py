"""Per-entity sequence operators. Samples are rows; a missing sample is a missing row."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapspan.functions.angles import heading, turn_deg
from snapspan.plans.sequences import Span, around, last_known, shift

SLOW = 0.6
MAX_TURN = 250.0


def _slope(f0, fb, fa, hb, ha) -> Column:
    """Central difference with both gaps; one-sided at an end; 0 for a lone sample."""
    both = (hb * hb * fa + (ha * ha - hb * hb) * f0 - ha * ha * fb) / (hb * ha * (ha + hb))
    return (F.when(fb.isNotNull() & fa.isNotNull(), both).when(fa.isNotNull(), (fa - f0) / ha)
            .when(fb.isNotNull(), (f0 - fb) / hb).otherwise(F.lit(0.0)))


def kinematics(df: DataFrame, sp: Span, t: str = "t") -> DataFrame:
    """Velocity, speed, step distance and absolute acceleration from positions."""
    df = shift(df, sp, {"_tb": t, "_xb": "x", "_yb": "y"}, -1)
    df = shift(df, sp, {"_ta": t, "_xa": "x", "_ya": "y"}, 1)
    hb, ha = F.col(t) - F.col("_tb"), F.col("_ta") - F.col(t)
    df = df.withColumns({"vx": _slope(F.col("x"), F.col("_xb"), F.col("_xa"), hb, ha),
                         "vy": _slope(F.col("y"), F.col("_yb"), F.col("_ya"), hb, ha)})
    df = df.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    dx, dy = F.col("x") - F.col("_xb"), F.col("y") - F.col("_yb")
    df = df.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    df = shift(df, sp, {"_sb": "speed"}, -1)
    df = shift(df, sp, {"_sa": "speed"}, 1)
    df = df.withColumn("accel", F.abs(_slope(F.col("speed"), F.col("_sb"), F.col("_sa"), hb, ha)))
    return df.drop("_tb", "_xb", "_yb", "_ta", "_xa", "_ya", "_sb", "_sa")


def held_direction(df: DataFrame, sp: Span) -> DataFrame:
    """Direction of travel, kept through near-stillness.

    0 before the first movement; a track that never moves points along its net displacement.
    """
    df = df.withColumn("_own", F.when(F.round("speed", 9) > SLOW, heading(F.col("vx"), F.col("vy"))))
    df = last_known(df, sp, F.col("_own"), "_held")
    order = F.struct(*sp.order)
    net = df.groupBy(*sp.keys).agg(
        F.count("_own").alias("_moves"), F.min_by("x", order).alias("_x0"), F.min_by("y", order).alias("_y0"),
        F.max_by("x", order).alias("_x1"), F.max_by("y", order).alias("_y1"))
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    net = net.withColumn("_net", F.when((F.col("_moves") == 0) & (F.sqrt(dx * dx + dy * dy) > 1e-6), heading(dx, dy)))
    df = df.join(net.select(*sp.keys, "_net"), list(sp.keys), "left")
    return df.withColumn("travel", F.coalesce("_net", "_held", F.lit(0.0))).drop("_own", "_held", "_net")


def _fit(w: int) -> np.ndarray:
    """Rows of the least-squares parabola fitted through ``w`` equally spaced points."""
    i = np.arange(w, dtype=float)
    a = np.column_stack([np.ones(w), i, i * i])
    return a @ np.linalg.inv(a.T @ a) @ a.T


def smooth_weights(w: int) -> list[list[float]]:
    return [[float(v) for v in row] for row in _fit(w)]


def smooth(df: DataFrame, sp: Span, cols: dict[str, str]) -> DataFrame:
    """Parabola smoothing over 7 samples (5 when a track has 5 or 6, none below 5).

    Rows near an end take the parabola of the first or last window. ``cols`` maps output
    to source column. Each row needs its 6 neighbours on both sides and no more.
    """
    sources = list(dict.fromkeys(cols.values()))
    if sp.block is None:
        w, every = sp.window(), Window.partitionBy(*sp.keys)
        df = df.withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(every),
                             **{f"_{k}_{c}": F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) for c in sources for k in range(-6, 7) if k}})
        df = df.withColumns({"_b": F.least(F.col("_k") - 1, F.lit(6)), "_f": F.least(F.col("_n") - F.col("_k"), F.lit(6))})
    else:
        df = around(df.withColumn("_p", F.struct(*sources)), sp, F.col("_p"), 6, "_back", "_fore")
        df = df.withColumns({"_b": F.size("_back"), "_f": F.size("_fore"), **{
            f"_{k}_{c}": (F.get("_back", F.size("_back") + k) if k < 0 else F.get("_fore", F.lit(k - 1)))[c] for c in sources for k in range(-6, 7) if k}})
    back, fore = F.col("_b"), F.col("_f")
    n = back + fore + 1

    def fitted(w: int, source: str) -> Column:
        h, half = smooth_weights(w), w // 2

        def row(i: int) -> Column:
            """Sample ``i`` of the window that is used, in its order."""
            values = [F.col(source if k == i else f"_{k - i}_{source}") for k in range(w)]
            return reduce(lambda total, vc: total + vc[0] * vc[1], zip(values, h[i]), F.lit(0.0))

        out = F.when((back >= half) & (fore >= half), row(half))
        for i in range(half):
            out = out.when(back == i, row(i))
        for i in range(half):
            out = out.when(fore == i, row(w - 1 - i))
        return out

    df = df.withColumns({out: F.when(n >= 7, fitted(7, src)).when(n >= 5, fitted(5, src)).otherwise(F.col(src))
                         for out, src in cols.items()})
    return df.drop("_p", "_back", "_fore", "_k", "_n", "_b", "_f", *[f"_{k}_{c}" for c in sources for k in range(-6, 7)])


def acceleration(df: DataFrame, sp: Span, t: str = "t", central: bool = True) -> DataFrame:
    """Acceleration from a speed column: central and 0 at ends, or backward difference."""
    df = shift(df, sp, {"_sb": "s", "_tb": t}, -1)
    df = shift(df, sp, {"_sa": "s", "_ta": t}, 1)
    if central:
        gap = F.col("_ta") - F.col("_tb")
        a = F.when(gap > 0, F.abs((F.col("_sa") - F.col("_sb")) / gap)).otherwise(0.0)
    else:
        a = F.coalesce(F.abs(F.col("s") - F.col("_sb")) * 10, F.abs(F.col("_sa") - F.col("s")) * 10, F.lit(0.0))
    return df.withColumn("accel", a).drop("_sb", "_tb", "_sa", "_ta")


def resample(df: DataFrame, sp: Span, cols: list[str], dt: float, t: str = "t") -> DataFrame:
    """Linear interpolation onto multiples of ``dt`` inside each entity's own span."""
    df = shift(df, sp, {"_t1": t, **{f"_n_{c}": c for c in cols}}, 1)
    low = F.ceil(F.round(F.col(t) / dt, 6)).cast("bigint")
    last = F.col("_t1").isNull()
    high = F.when(last, F.floor(F.round(F.col(t) / dt, 6))).otherwise(
        F.ceil(F.round(F.col("_t1") / dt, 6)) - 1).cast("bigint")
    grid = df.filter(high >= low).withColumn("tick", F.explode(F.sequence(low, high)))
    u = F.when(last, 0.0).otherwise((F.col("tick") * dt - F.col(t)) / (F.col("_t1") - F.col(t)))
    out = grid.withColumn("_u", u)
    return out.select(*sp.keys, "tick", F.round(F.col("tick") * dt, 6).alias("t"),
                      *[(F.col(c) + F.coalesce(F.col(f"_n_{c}") - F.col(c), F.lit(0.0)) * F.col("_u")).alias(c) for c in cols])


def cubic_path(df: DataFrame, sp: Span, cols: list[str], per: int, t: str = "t") -> DataFrame:
    """Catmull-Rom points, ``per`` to each pair of neighbours; end neighbours are clamped."""
    df = shift(df, sp, {"_t1": t, **{f"_a_{c}": c for c in cols}}, 1)
    df = shift(df, sp, {f"_b_{c}": c for c in cols}, -1)
    df = shift(df, sp, {f"_c_{c}": c for c in cols}, 2)
    seg = df.filter(F.col("_t1").isNotNull()).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    u = F.col("part") / per

    def value(c: str) -> Column:
        p1, p2 = F.col(c), F.col(f"_a_{c}")
        p0, p3 = F.coalesce(f"_b_{c}", c), F.coalesce(f"_c_{c}", f"_a_{c}")
        return 0.5 * (2 * p1 + (p2 - p0) * u + (2 * p0 - 5 * p1 + 4 * p2 - p3) * u * u
                      + (3 * p1 - p0 - 3 * p2 + p3) * u * u * u)

    return seg.select(*sp.keys, *sp.order, "part", (F.col(t) + (F.col("_t1") - F.col(t)) * u).alias("at"),
                      *[value(c).alias(c) for c in cols])


def fill_gaps(grid: DataFrame, samples: DataFrame, sp: Span, cols: list[str]) -> DataFrame:
    """Every grid row gets a sample: the last one held, or the first one before any."""
    keys = [*sp.keys, *sp.order]
    g = grid.join(samples.select(*keys, *cols), keys, "left").withColumn("observed", F.col(cols[0]).isNotNull())
    pack = F.when(F.col("observed"), F.struct(*cols))
    g = last_known(g, sp, pack, "_held")
    first = samples.groupBy(*sp.keys).agg(F.min_by(F.struct(*cols), F.struct(*sp.order)).alias("_first"))
    g = g.join(first, list(sp.keys), "left")
    have = F.coalesce("_held", "_first")
    return g.withColumns({c: have[c] for c in cols}).drop("_held", "_first")


def last_state(df: DataFrame, at: DataFrame, keys: list[str], entity: str, frame: str = "frame_id") -> DataFrame:
    """Each player's last sample at or before the play's instant ``at``."""
    rest = [c for c in df.columns if c not in (*keys, entity)]
    known = df.join(at.select(*keys, F.col("at").alias("_at")), keys).filter(F.col(frame) <= F.col("_at"))
    best = known.groupBy(*keys, entity).agg(F.max_by(F.struct(*rest), frame).alias("_s"))
    return best.select(*keys, entity, "_s.*")


def turn_rate(df: DataFrame, sp: Span, angle: str, t: str = "t") -> DataFrame:
    """Turn since the previous sample, and degrees per second."""
    df = shift(df, sp, {"_ab": angle, "_tb": t}, -1)
    turn = turn_deg(F.col("_ab"), F.col(angle))
    return df.withColumns({"turn": turn, "turn_rate": F.abs(turn) / (F.col(t) - F.col("_tb"))}).drop("_ab", "_tb")


def facing_from_motion(df: DataFrame, keys: list[str], frame: str, resting: str, block: int = 256) -> DataFrame:
    """Facing from travel: velocity, held, or the resting angle, turning 250 degrees a second at most.

    The cap works on the angle of the previous output: the narrow samples of a track are one list, and the tracks of a batch are stepped through side by side.
    ``block`` has no effect any more; a call that names it still holds.
    """
    num = lambda c: F.col(c).cast("double").alias(c)
    moving = F.coalesce(F.round(F.col("speed").cast("double"), 9) > SLOW, F.lit(False)).alias("moving")
    slim = df.select(*keys, F.struct(F.col(frame), num("t"), moving, num("travel"), F.col(resting).cast("double").alias("rest")).alias("_r"))
    tracks = slim.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    of = lambda name: F.transform("_rows", lambda r: r[name])
    turned = F.arrow_udf(_capped, "array<struct<facing:double,led:boolean>>")
    out = tracks.withColumn("_out", turned(of("t"), of("moving"), of("travel"), of("rest")))
    out = out.select(*keys, F.inline(F.arrays_zip(of(frame).alias(frame), "_out")))
    return out.select(*keys, frame, F.col("_out.facing").alias("facing"), F.when(F.col("_out.led"), "from_velocity").otherwise("assumed").alias("facing_source"))


def _capped(t: pa.Array, moving: pa.Array, travel: pa.Array, rest: pa.Array) -> pa.Array:
    """Facing of the samples of each list, in order; all tracks of a batch are stepped through side by side."""
    starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    t, travel, rest = (c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (t, travel, rest))
    moving = moving.flatten().to_numpy(zero_copy_only=False).astype(bool)
    facing, led = np.empty(len(t)), np.empty(len(t), bool)
    wrap = lambda a: np.where((r := np.fmod(a, 360.0)) < 0, np.fmod(r + 360.0, 360.0), r)
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    first, size = starts[:-1][order], size[order]
    for k in range(int(size[0]) if len(size) else 0):
        at = first[: np.searchsorted(-size, -k)] + k  # tracks with more than k samples
        was = facing[at - 1] if k else np.full(len(at), np.nan)
        new = np.isnan(was)
        target = np.where(moving[at], travel[at], np.where(new, rest[at], was))
        delta = wrap(target - was)
        delta = np.where(delta >= 180.0000000005, delta - 360.0, delta)  # half a turn, to nine digits, goes left
        cap = MAX_TURN * np.fmax(t[at] - t[at - 1], 1e-6)
        out = np.where(new, target, was + np.fmax(-cap, np.fmin(cap, delta)))
        led[at] = moving[at] | ~new
        out = wrap(out)
        facing[at] = np.where(out >= 360.0, 0.0, out)
    rows = pa.StructArray.from_arrays([pa.array(facing, mask=np.isnan(facing)), pa.array(led)], names=["facing", "led"])
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), rows)


def resting_angle(side: Column) -> Column:
    return F.when(F.lower(side).startswith("def"), 180.0).otherwise(0.0)
