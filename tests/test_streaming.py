"""Streams must give what the batch folds give."""

import json

from pyspark.sql import functions as F

from snapspan.operators import trackers as tk
from snapspan.streaming import live, store


def points():
    out = []
    for f in range(1, 13):
        for i in range(3):
            if (f + i) % 6:
                out.append((1, f, 10.0 + 0.4 * f + 8 * i, 20.0 + 0.2 * f))
    return out


def drain(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_player_tracks_stream_equals_batch(spark, tmp_path):
    live.use_rocksdb(spark)
    df = spark.createDataFrame(points(), "clip long, frame long, x double, y double")
    frames = tk.frames_of_points(df, ["clip"], "frame")
    for n, (lo, hi) in enumerate(((1, 6), (7, 12))):
        frames.filter(F.col("frame").between(lo, hi)).coalesce(1).write.parquet(f"{tmp_path}/in/p{n}")
    src = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    drain(live.live_players(src).writeStream.format("memory").queryName("tracks").outputMode("append")
          .option("checkpointLocation", f"{tmp_path}/ck").start())
    got = sorted((r.frame, r.track, round(r.x, 6), round(r.y, 6)) for r in spark.table("tracks").collect())
    batch = tk.track_players(df, ["clip"], "frame").filter("hits >= 3")
    want = sorted((r["frame"], r["track"], round(r["x"], 6), round(r["y"], 6)) for r in batch.collect())
    assert got == want and len({r[1] for r in got}) == 3


def test_label_upserts_and_snapshots(spark, tmp_path):
    root = str(tmp_path / "labels")
    write = store.label_writer(root)
    write(spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "key string, x double, at long"), 0)
    write(spark.createDataFrame([("a", 9.0, 2)], "key string, x double, at long"), 1)
    assert {r["key"]: r["x"] for r in store.current(spark, root).collect()} == {"a": 9.0, "b": 2.0}
    write(spark.createDataFrame([("a", 9.0, 2)], "key string, x double, at long"), 1)
    assert store.current(spark, root).count() == 2
    out = str(tmp_path / "snap")
    assert store.publish(spark.range(3), out, "now") == 1 and store.publish(spark.range(5), out, "now") == 2
    try:
        store.publish(spark.range(2).select(F.raise_error(F.lit("no")).alias("id")), out, "now")
    except Exception:  # noqa: BLE001
        pass
    assert spark.table("now").count() == 5 and store.current(spark, out).count() == 5


def test_tracker_state_can_be_stored_as_text():
    s = tk.new_clip()
    tk.track_step(s, 1, [{"x": 1.0, "y": 1.0, "team": "A"}])
    json.dumps(tk.plain(s))


def test_ball_coasts_then_goes_unknown():
    s = tk.new_ball()
    spot = lambda x, y, c, man: {"x": x, "y": y, "doubt": -c, "man": man}
    assert tk.ball_step(s, 1, [spot(10.0, 10.0, 0.5, 0.0)])["source"] == "detected"
    assert tk.ball_step(s, 2, [spot(60.0, 40.0, 0.9, 58.3)])["source"] == "coasted"
    got = [tk.ball_step(s, f, [])["source"] for f in range(3, 12)]
    assert got[:7] == ["coasted"] * 7 and got[7:] == ["none"] * 2
    assert tk.ball_step(s, 12, [], (5.0, 5.0))["source"] == "carrier"


def test_a_runner_keeps_his_track_over_empty_frames(rows):
    """8 yards a second, nobody seen for four frames: still one track."""
    pts = rows([(1, f, 10.0 + 0.8 * f, 20.0) for f in [*range(1, 13), *range(17, 25)]], "clip long, frame long, x double, y double")
    got = tk.track_players(pts, ["clip"], "frame").collect()
    assert len(got) == 20 and {r["track"] for r in got} == {0}
    late = rows([(1, f, 10.0, 20.0) for f in (1, 2, 3, 20, 21, 22)], "clip long, frame long, x double, y double")
    assert {r["track"] for r in tk.track_players(late, ["clip"], "frame").collect()} == {0, 1}


def test_ball_stream_equals_batch(spark, tmp_path):
    live.use_rocksdb(spark)
    c = spark.createDataFrame([(1, f, 10.0 + 0.5 * f, 20.0, 0.9) for f in range(1, 12) if f % 4] + [(1, 3, 50.0, 50.0, 0.99)], "clip long, frame long, x double, y double, confidence double")
    m = spark.createDataFrame([(1, f, 10.0 + 0.5 * f, 20.5) for f in range(1, 12)], "clip long, frame long, x double, y double")
    want = sorted((r["frame"], round(r["x"], 6), r["source"]) for r in tk.track_balls(c, m, m, ["clip"], "frame").collect())
    frames = m.groupBy("clip", "frame").agg(F.collect_list(F.struct("x", "y")).alias("men")).join(
        c.groupBy("clip", "frame").agg(F.collect_list(F.struct("x", "y", "confidence")).alias("cand")), ["clip", "frame"], "left").select("clip", "frame", "cand", "men")
    frames.coalesce(1).write.parquet(f"{tmp_path}/in/p0")
    src = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in/*")
    drain(live.live_balls(src).writeStream.format("memory").queryName("balls").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start())
    got = sorted((r["frame"], round(r["x"], 6), r["source"]) for r in spark.table("balls").collect())
    assert got == want and {w[2] for w in want} == {"detected", "coasted"}
