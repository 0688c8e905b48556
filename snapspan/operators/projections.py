"""Row-level operators built from the column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapspan.functions.coding import facing, player_key, position_code
from snapspan.schema import PLAY

SYNTHETIC_BASE = 900_000


def stable_ids(roster: DataFrame, pid: str = "player_id") -> DataFrame:
    """Integer ids for a roster: real ones stay, others count up from 900001 in id order per play.

    The roster has one row per player of a play, so a play's window holds its players only.
    """
    n = F.col(pid).try_cast("bigint")
    real = n.isNotNull() & (n > 0) & (n < SYNTHETIC_BASE)
    w = Window.partitionBy(*PLAY, "_real").orderBy(pid)
    out = roster.withColumn("_real", F.coalesce(real, F.lit(False)))
    out = out.withColumn("nfl_number", F.when(F.col("_real"), n).otherwise(SYNTHETIC_BASE + F.row_number().over(w)))
    return out.drop("_real")


def velocity(df: DataFrame, seconds: Column | float | None = None) -> DataFrame:
    """Speed and facing split into components; ``dir`` and ``o`` are compass bearings."""
    cols = {
        "vx": F.col("s") * F.sin(F.radians("dir")), "vy": F.col("s") * F.cos(F.radians("dir")),
        "ox": F.sin(F.radians("o")), "oy": F.cos(F.radians("o")),
    }
    if seconds is not None:
        cols["cv_dx"], cols["cv_dy"] = cols["vx"] * seconds, cols["vy"] * seconds
    return df.withColumns(cols)


def to_contract(df: DataFrame) -> DataFrame:
    """Mirrored release rows to contract rows: player key, angles, provenance."""
    o, source = facing(F.col("o"), F.col("dir"))
    turn = lambda a: F.pmod(90.0 - a, F.lit(360.0))
    return df.withColumns({
        "player_id": player_key(F.col("nfl_id")), "o_source": source,
        "o": F.when(source == "assumed", 0.0).otherwise(turn(o)),
        "dir": F.coalesce(turn(F.col("dir")), F.lit(0.0)),
    })


def coded(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", position_code(F.col("position")))


def forecast_steps(state: DataFrame, plays: DataFrame, strict: bool = False) -> DataFrame:
    """One row per player per step 1..n, with play inputs; refused plays keep a problem text.

    A play is refused when it has no landing point or yardline, no horizon of at least one
    step, or no known direction. With ``strict`` a refusal raises instead.
    """
    ok_dir = F.lower("play_direction").isin("left", "right")
    problem = (F.when(F.col("ball_land_x").isNull() | F.col("ball_land_y").isNull() | F.col("yardline").isNull(),
                      "missing play state")
               .when(F.col("frames_output").isNull(), "no horizon")
               .when(F.col("frames_output") < 1, "horizon below 1")
               .when(~F.coalesce(ok_dir, F.lit(False)), "unknown direction"))
    known = plays.withColumn("problem", problem)
    if strict:
        bad = known.filter(F.col("problem").isNotNull()).select(*PLAY, "problem").head(5)
        if bad:
            raise ValueError(f"cannot forecast these plays: {bad}")
    usable = known.filter(F.col("problem").isNull()).withColumn(
        "play_direction_code", F.when(F.lower("play_direction") == "right", 1.0).otherwise(-1.0))
    rows = state.join(usable.select(*PLAY, "ball_land_x", "ball_land_y", "yardline", "frames_output",
                                    "play_direction_code"), PLAY)
    rows = rows.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.col("frames_output").cast("int"))))
    return rows.withColumns({"vx": F.col("s") * F.sin(F.radians("dir")), "vy": F.col("s") * F.cos(F.radians("dir"))})


def attach_play_state(plays: DataFrame, supplied: DataFrame) -> DataFrame:
    """Put caller-supplied situation beside plays and say where it came from."""
    out = plays.join(supplied, PLAY, "left")
    return out.withColumn("play_state_source", F.when(F.col("ball_land_x").isNotNull(), "supplied"))


def training_boxes(labels: DataFrame) -> DataFrame:
    """Normalised centre and size text per labelled frame; empty where there is no ball."""
    num = "%.6f"
    line = F.format_string(f"0 {num} {num} {num} {num}", F.col("x") / F.col("width"), F.col("y") / F.col("height"),
                           F.col("size") / F.col("width"), F.col("size") / F.col("height"))
    none = F.col("x").isNull() | F.col("y").isNull()
    return labels.withColumn("line", F.when(none, "").otherwise(line))


def reviewable(plays: DataFrame) -> DataFrame:
    """Real plays with a passing result; simulated plays and clips are left out."""
    simulated = F.coalesce(F.col("simulated"), F.lit(False))
    clip = F.coalesce(F.col("source") == "clip", F.lit(False))
    return plays.filter(~simulated & ~clip & F.col("pass_result").isin("C", "I", "IN"))


def timeline_row(df: DataFrame, sources: list[str]) -> DataFrame:
    """Compact sample arrays: position, speed and the ordinal of the angle source."""
    at = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("o_source")) - 1
    return df.withColumn("sample", F.array(F.round("x", 2), F.round("y", 2), F.round("s", 2), at.cast("double")))
