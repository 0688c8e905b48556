"""User-supplied detectors over a table of frames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Box kinds and where each is anchored (fixed values).
BOX_KINDS = ["body", "helmet", "torso"]
DETECTION = "clip string, frame int, x1 double, y1 double, x2 double, y2 double, score double, kind string, label string, team string"


def detect(frames: DataFrame, detector: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Boxes from ``detector``, which gets a batch of frames and returns detection rows."""
    boxes = frames.mapInPandas(lambda batches: map(detector, batches), schema=DETECTION)
    known = F.col("kind").isin(*BOX_KINDS)
    return boxes.withColumn("problem", F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown box kind "), F.coalesce("kind", F.lit("null")))))
