"""Plays lie like the tracking table, and documents are made once."""

import os

import pytest

from snapspan.catalog import load
from snapspan.catalog.q_library import documents
from snapspan.catalog.q_suggested import payloads
from snapspan.catalog.registry import Tables
from snapspan.plans.session import settle
from snapspan.sources import writers as wr

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("made", [documents, payloads])
def test_a_join_with_plays_moves_no_samples(spark, made, capsys):
    settle(spark)
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made(Tables(spark, SF)).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    moved = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("hashpartitioning(k#" in line or "REPARTITION_BY_NUM" in line for line in moved)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_documents_are_made_once(spark, capsys):
    load().QUERIES["play_documents"](spark, SF).explain()
    assert capsys.readouterr().out.count("FileScan parquet spark_catalog.default.tracking") <= 9  # once for each of its parts, not for each table read back


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_doubled_tracks_stay_in_their_buckets(spark, capsys):
    load().QUERIES["duplicate_tracks"](spark, SF).explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


def test_frames_without_samples_and_plays_without_frames(rows):
    k = "game_id long, play_id long, "
    one = rows([(1, 1, 2, None, 7, 1.0, 2.0, 3.0, 4.0, 5.0, "measured")], k + "frame_id int, event string, nfl_id long, x double, y double, o double, dir double, s double, o_source string")
    ball = rows([(1, 1, 1, 9.0, 9.0), (1, 1, 2, 8.0, 8.0), (1, 2, 1, 7.0, 7.0)], k + "frame_id int, x double, y double")
    plays = rows([(1, p, 1, 1, 10, "d") for p in (1, 2, 3)], k + "snap int, down int, yards_to_go int, description string")
    roster = rows([(1, 1, 7, "n", 1, "c", "p", "s")], k + "nfl_id long, name string, jersey int, club string, position string, side string")
    got = {r["play_id"]: r["value"] for r in wr.play_documents(one, roster, plays, ball).collect()}
    assert sorted(got) == [1, 2]
    assert got[1].index('"frameId":1,') < got[1].index('"frameId":2,') and '"lineOfScrimmage":9.0' in got[1]
    assert got[2].count('"frameId"') == 1 and '"lineOfScrimmage":7.0' in got[2] and '"players":[]' in got[2]
