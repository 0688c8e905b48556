"""Live versions of the batch rules in Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from snapspan.operators.trackers import ball_candidates, ball_step, new_ball, new_clip, plain, track_step
from snapspan.plans.sequences import Span, islands, shift

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(df: DataFrame, keys: list[str], ts: str, gap_seconds: float, tie: str, block: str | None = None) -> DataFrame:
    """Batch sessions: rows of a key no more than ``gap_seconds`` apart. ``block`` splits hot keys."""
    sp = Span(tuple(keys), (ts, tie), block)
    s = shift(df, sp, {"_prev": ts}, -1)
    apart = F.timestamp_diff("MICROSECOND", F.col("_prev"), F.col(ts)) >= int(gap_seconds * 1_000_000)
    s = islands(s, sp, F.col("_prev").isNull() | apart, "session")
    return s.groupBy(*keys, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))


def live_sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, watermark: str) -> DataFrame:
    """Streaming sessions; rows older than the watermark are dropped."""
    w = F.session_window(ts, gap).alias("w")
    return (stream.withWatermark(ts, watermark).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
            .select(*keys, F.col("w.start").alias("start"), "last", "n"))


class _KeyedJson(StatefulProcessor):
    """One JSON state per key. Frames of a batch are put in order; a frame not after the last is late and dropped.

    A row with a negative frame says that the clip is finished: its state goes, and later rows start anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", StructType([StructField("value", StringType())]))

    def close(self) -> None:
        pass

    def fresh(self) -> dict:
        raise NotImplementedError

    def advance(self, state: dict, row: dict) -> list[dict]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.memory.get()[0]) if self.memory.exists() else {"last": None, "s": self.fresh()}
        # A key's rows of one micro-batch; the batch size is bounded by the source's options.
        got = pd.concat(list(rows))
        ended, got = (got["frame"] < 0).any(), got[got["frame"] >= 0].sort_values("frame")
        out = []
        for row in got.to_dict("records"):
            if state["last"] is not None and row["frame"] <= state["last"]:
                continue
            state["last"] = int(row["frame"])
            out.extend({"clip": key[0], "frame": int(row["frame"]), **g} for g in self.advance(state["s"], row))
        state["s"] = plain(state["s"])
        if ended:
            self.memory.clear()
        else:
            self.memory.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out)


def _points(v) -> list[dict]:
    return [] if v is None else [p if isinstance(p, dict) else p.asDict() for p in v]


class PlayerTracker(_KeyedJson):
    """A track is told from its ``min_hits``-th sighting on."""

    def __init__(self, min_hits: int = 3):
        self.min_hits = min_hits

    def fresh(self) -> dict:
        return new_clip()

    def advance(self, state: dict, row: dict) -> list[dict]:
        return [g for g in track_step(state, int(row["frame"]), _points(row["points"])) if g["hits"] >= self.min_hits]


class BallTracker(_KeyedJson):
    def fresh(self) -> dict:
        return new_ball()

    def advance(self, state: dict, row: dict) -> list[dict]:
        return [ball_step(state, int(row["frame"]), _points(row["cand"]))]


class CutFinder(_KeyedJson):
    """Keeps the last histogram of a clip and reports the distance to the next one."""

    def fresh(self) -> dict:
        return {"hist": None}

    def advance(self, state: dict, row: dict) -> list[dict]:
        h = [float(v) for v in row["hist"]]
        jump = None
        if state["hist"] is not None:
            mass = (sum(h) * sum(state["hist"])) ** 0.5
            cross = sum((a * b) ** 0.5 for a, b in zip(h, state["hist"]))
            jump = max(1.0 - (cross / mass if mass > 0 else 0.0), 0.0) ** 0.5
        state["hist"] = h
        return [{"jump": jump}]


def _keyed(stream: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "append") -> DataFrame:
    return stream.groupBy("clip").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="None")


def live_players(frames: DataFrame, min_hits: int = 3) -> DataFrame:
    """``frames``: clip, frame, points (one row per frame). Rows of confirmed tracks, from the confirming sighting on."""
    return _keyed(frames, PlayerTracker(min_hits), "clip bigint, frame bigint, track bigint, x double, y double, hits bigint, team string")


def live_balls(frames: DataFrame) -> DataFrame:
    """``frames``: clip, frame, cand, men (one row per frame)."""
    return _keyed(frames.withColumn("cand", ball_candidates("cand", "men")).drop("men"), BallTracker(), "clip bigint, frame bigint, x double, y double, source string, confidence double")


def live_cuts(frames: DataFrame) -> DataFrame:
    """``frames``: clip, frame, hist."""
    return _keyed(frames, CutFinder(), "clip bigint, frame bigint, jump double")


def use_rocksdb(spark) -> None:
    """Keyed state needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
