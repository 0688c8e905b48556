"""Field, projective and box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapspan.functions.angles import wrap_deg
from snapspan.schema import CONTRACT_WIDTH, FIELD_LENGTH, GOAL_X


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def is_left(direction: Column) -> Column:
    return F.lower(direction.cast("string")) == "left"


def face_right(df: DataFrame, width: float = CONTRACT_WIDTH, angles=("o", "dir")) -> DataFrame:
    """Turn plays that run left so the offense attacks +x. Applied twice it restores the input.

    ``play_direction`` keeps saying what the source said; ``mirrored`` says what was done.
    """
    left = F.coalesce(is_left(F.col("play_direction")), F.lit(False))
    cols = {
        "x": F.when(left, FIELD_LENGTH - F.col("x")).otherwise(F.col("x")),
        "y": F.when(left, width - F.col("y")).otherwise(F.col("y")),
        "mirrored": left,
    }
    for a in angles:
        if a in df.columns:
            cols[a] = F.when(left, F.pmod(F.col(a) + 180.0, F.lit(360.0))).otherwise(F.col(a))
    return df.withColumns(cols)


def unmirror(x: Column, y: Column, left: Column, width: float) -> tuple[Column, Column]:
    return (F.when(left, FIELD_LENGTH - x).otherwise(x), F.when(left, width - y).otherwise(y))


def release_angle(contract: Column, left: Column) -> Column:
    """Contract angle of a mirrored play back to the compass bearing the release used."""
    return wrap_deg(90.0 - F.when(left, contract + 180.0).otherwise(contract))


def scrimmage_x(yardline: Column, left: Column) -> Column:
    return F.when(left, FIELD_LENGTH - yardline).otherwise(yardline)


def first_down_x(los: Column, to_go: Column) -> Column:
    return F.least(los + to_go, F.lit(GOAL_X))


def on_field(x: Column, y: Column, margin: float = 0.0, width: float = CONTRACT_WIDTH) -> Column:
    good = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return good & x.between(-margin, FIELD_LENGTH + margin) & y.between(-margin, width + margin)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(v, F.lit(high)), F.lit(low))


def project(h: Column, x: Column, y: Column) -> Column:
    """Apply a 3x3 matrix held row by row in a 9-array; NaN on the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    flat = F.abs(w) < 1e-9
    nan = F.lit(float("nan"))
    return F.struct(F.when(flat, nan).otherwise((h[0] * x + h[1] * y + h[2]) / w).alias("x"),
                    F.when(flat, nan).otherwise((h[3] * x + h[4] * y + h[5]) / w).alias("y"))


def invert3(h: Column) -> Column:
    """Inverse of a 3x3 by cofactors."""
    c = [h[4] * h[8] - h[5] * h[7], h[2] * h[7] - h[1] * h[8], h[1] * h[5] - h[2] * h[4],
         h[5] * h[6] - h[3] * h[8], h[0] * h[8] - h[2] * h[6], h[2] * h[3] - h[0] * h[5],
         h[3] * h[7] - h[4] * h[6], h[1] * h[6] - h[0] * h[7], h[0] * h[4] - h[1] * h[3]]
    det = h[0] * c[0] + h[1] * c[3] + h[2] * c[6]
    return F.array(*[k / det for k in c])


def box_measures(df: DataFrame) -> DataFrame:
    """Size, centre and anchor of detections; a helmet is anchored at its centre, a body at its feet."""
    cx = (F.col("x1") + F.col("x2")) / 2
    cy = (F.col("y1") + F.col("y2")) / 2
    return df.withColumns({
        "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1"), "cx": cx, "cy": cy,
        "anchor_x": cx, "anchor_y": F.when(F.col("kind") == "body", F.col("y2")).otherwise(cy),
    })


def iou(a: str, b: str) -> Column:
    """Overlap of two boxes held in columns ``{a}x1..`` and ``{b}x1..``."""
    sides = lambda p: {k: F.col(f"{p}{k}") for k in ("x1", "y1", "x2", "y2")}
    return iou_of(sides(a), sides(b))


def iou_of(a, b) -> Column:
    """Overlap of two boxes whose sides are taken by name: structs, or columns by name."""
    iw = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    ih = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    inter = iw * ih
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_gap(px: Column, py: Column, box=None) -> Column:
    """Distance from a point to the box in columns x1..y2, or in a struct of these, 0 inside."""
    b = {k: F.col(k) for k in ("x1", "y1", "x2", "y2")} if box is None else box
    dx = F.greatest(b["x1"] - px, F.lit(0.0), px - b["x2"])
    dy = F.greatest(b["y1"] - py, F.lit(0.0), py - b["y2"])
    return F.sqrt(dx * dx + dy * dy)


def in_box(px: Column, py: Column, pad: Column | float = 0.0) -> Column:
    return px.between(F.col("x1") - pad, F.col("x2") + pad) & py.between(F.col("y1") - pad, F.col("y2") + pad)


def painted_number(x: Column) -> Column:
    """The number painted on the yard line at x; both sides of midfield count up to 50."""
    return F.round(50.0 - F.abs(x - 60.0)).cast("int")


# Lanes across the field (fixed ids); hash rows are an inset from each sideline.
LANES = ["sideline_y0", "hash_y0", "hash_ymax", "sideline_ymax"]


def line_id(x: Column) -> Column:
    n = painted_number(x)
    return (F.when(x == 10, "goalA").when(x == 110, "goalB").when(x == 0, "backA").when(x == 120, "backB")
            .when(n == 50, "y50").otherwise(F.concat(F.lit("y"), n, F.when(x < 60, "A").otherwise("B"))))


def landmarks(spark: SparkSession, width: float = CONTRACT_WIDTH, hash_inset: float = 23.58) -> DataFrame:
    """Every five-yard line, goal line and back line crossed with the lanes."""
    lane_y = {"sideline_y0": 0.0, "hash_y0": hash_inset, "hash_ymax": width - hash_inset, "sideline_ymax": width}
    lane_rows = F.array(*[F.struct(F.lit(n).alias("lane"), F.lit(lane_y[n]).alias("y")) for n in LANES])
    grid = spark.range(0, 121, 5).select(F.col("id").cast("double").alias("x"))
    grid = grid.filter(F.col("x").isin(0.0, 120.0) | F.col("x").between(10, 110))
    out = grid.select("x", F.explode(lane_rows).alias("l")).select("x", "l.lane", "l.y")
    # The back lines carry no hash marks.
    out = out.filter(~(F.col("x").isin(0.0, 120.0) & F.col("lane").startswith("hash")))
    return out.select(F.concat(line_id(F.col("x")), F.lit("/"), F.col("lane")).alias("landmark_id"),
                      "x", "y", "lane", painted_number(F.col("x")).alias("painted"))
