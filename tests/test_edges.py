"""Readers, writers and live rules at the edges."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from snapspan.operators import plugins, shots as sh
from snapspan.plans.joins import in_interval, nearest_in_time
from snapspan.sources import readers as rd, writers as wr
from snapspan.streaming import live


def test_bad_index_is_skipped_not_fatal(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schemaVersion":1,"gameId":1,"plays":[{"id":"1_2","gameId":1,"playId":2}]}')
    (tmp_path / "b.json").write_text('{"schemaVersion":1,"gameId":2,"plays":[{"gameId":2}]}')
    (tmp_path / "c.json").write_text("{broken")
    good, bad = rd.load_index(spark, str(tmp_path))
    assert [r["gameId"] for r in good.collect()] == [1] and bad.count() == 2


def test_partition_upsert_leaves_other_partitions(spark, tmp_path):
    out = str(tmp_path / "sims")
    wr.upsert_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "play_id long, v string"), out, "play_id")
    wr.upsert_partitions(spark.createDataFrame([(2, "c")], "play_id long, v string"), out, "play_id")
    assert {r["play_id"]: r["v"] for r in spark.read.parquet(out).collect()} == {1: "a", 2: "c"}


def test_leaderboard_and_training_text(spark, tmp_path):
    row = spark.createDataFrame([("x", 1.0)], "condition string, median double")
    for _ in range(2):
        wr.append_leaderboard(row, str(tmp_path / "board"))
    assert spark.read.parquet(str(tmp_path / "board")).count() == 2
    wr.write_training_text(spark.createDataFrame([("val", "0 1"), ("train", "")], "split string, line string"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).filter("split = 'val'").first()["value"] == "0 1"


def test_live_sessions_drop_late_rows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    schema = "pair long, ts timestamp"
    parts = ([(1, at(0)), (1, at(0.2))], [(1, at(60))], [(1, at(0.3)), (1, at(120))], [(1, at(300))])
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    q = live.live_sessions(src, ["pair"], "ts", "1 second", "2 seconds").writeStream.format("memory").queryName("sess").outputMode(
        "append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
            q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["start"], r["n"]) for r in spark.table("sess").collect())
    assert got[0] == (at(0), 2) and (at(60), 1) in got


def test_live_cuts_equal_batch_distance(spark, tmp_path):
    live.use_rocksdb(spark)
    rows = [(1, f, [1.0, 9.0] if f < 3 else [9.0, 1.0]) for f in range(6)]
    df = spark.createDataFrame(rows, "clip long, frame long, hist array<double>")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live.live_cuts(src).writeStream.format("memory").queryName("cuts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    jump = {r["frame"]: r["jump"] for r in spark.table("cuts").collect()}
    a, b = F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(9.0), F.lit(1.0))
    want = spark.range(1).select(sh.bhattacharyya(a, b)).first()[0]
    assert jump[3] == pytest.approx(want) and jump[2] == pytest.approx(0.0) and pd.isna(jump[0])


def test_detector_plug_in_names_unknown_kinds(spark):
    frames = spark.createDataFrame([("c", 1), ("c", 2)], "clip string, frame int")

    def find(pdf):
        return pdf.assign(x1=0.0, y1=0.0, x2=1.0, y2=2.0, score=0.5, kind=["body" if f == 1 else "foot" for f in pdf["frame"]], label=None, team=None)

    got = {r["frame"]: r["problem"] for r in plugins.detect(frames, find).collect()}
    assert got == {1: None, 2: "unknown box kind foot"}


def test_tolerance_join_keeps_every_left_row(spark):
    left = spark.createDataFrame([("c", 0.0), ("c", 0.0), ("c", 5.0), ("c", None), (None, 1.0)], "k string, t double")
    right = spark.createDataFrame([("c", 0.04, 1), ("c", -0.04, 2), (None, 1.0, 3)], "k string, u double, v int")
    got = sorted(((r["k"], r["t"], r["r_v"]) for r in nearest_in_time(left, right, ["k"], "t", "u", 0.05, ["v"]).collect()), key=str)
    assert got == sorted([("c", 0.0, 2), ("c", 0.0, 2), ("c", 5.0, None), ("c", None, None), (None, 1.0, 3)], key=str)


def test_interval_lookup_keeps_repeated_rows(spark):
    rows = spark.createDataFrame([("c", 3), ("c", 3), ("c", 99)], "k string, f int")
    spans = spark.createDataFrame([("c", 1, 4, "a", 1), ("c", 2, 40, "b", 2)], "k string, s int, e int, phase string, o int")
    got = sorted(((r["f"], r["phase"]) for r in in_interval(rows, spans, ["k"], "f", "s", "e", ["phase"], 16, "o").collect()), key=str)
    assert got == [(3, "a"), (3, "a"), (99, None)]


def test_release_rows_become_a_track(rows):
    """The caller's direction wins, missing columns are said, and plays without players or direction are refused."""
    from snapspan.operators.tracks import release_to_track
    from snapspan.plans.sequences import span

    schema = ("game_id long, play_id long, frame_id int, nfl_id long, club string, position string, jersey int, x double, y double, s double, a double, dir double, o double, "
              "play_direction string, event string")
    data = [(1, 7, f, 99, "HOM", "WR", 9, 20.0 + f, 10.0, 3.0 + f, None, 36.87, None, "right", "ball_snap" if f == 3 else None) for f in range(1, 6)]
    data += [(1, 7, f, None, "ball", None, None, 30.0, 20.0, None, None, None, None, "right", None) for f in range(1, 6)]
    data += [(1, 8, 1, None, "ball", None, None, 30.0, 20.0, None, None, None, None, "right", None), (1, 9, 1, 99, "HOM", "WR", 9, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None, None)]
    sp = span(["game_id", "play_id", "nfl_id"], "frame_id")
    got = release_to_track(rows(data, schema), sp)
    assert {(r["play_id"], r["problem"]) for r in got["problems"].collect()} == {(8, "no player rows"), (9, "no play direction")}
    meta = got["meta"].collect()
    assert len(meta) == 1 and (meta[0]["orientation_measured"], meta[0]["acceleration_measured"], meta[0]["snap"]) == (False, False, 3)
    right = {r["frame_id"]: r for r in got["samples"].collect()}
    assert right[3]["t"] == 0.0 and right[3]["dir"] == pytest.approx(53.13) and right[3]["o_source"] == "from_dir" and right[3]["a"] == pytest.approx(10.0)
    assert got["ball"].count() == 5 and [r["events"] for r in got["events"].collect()] == [["ball_snap"]]
    told = release_to_track(rows(data, schema), sp, rows([(1, 7, "left")], "game_id long, play_id long, direction string"))
    left = {r["frame_id"]: r for r in told["samples"].filter("play_id = 7").collect()}
    assert left[3]["x"] == pytest.approx(120.0 - right[3]["x"]) and left[3]["y"] == pytest.approx(53.3 - right[3]["y"]) and left[3]["dir"] == pytest.approx(233.13)
    assert told["meta"].filter("play_id = 7").first()["play_direction_source"] == "caller"
