"""What every query on the derived tracking table shares."""

import os

import pytest

from snapspan.catalog import load
from snapspan.catalog.registry import Tables

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.codegen.hugeMethodLimit"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_methods_too_long_to_compile_are_not_made(spark):
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.unset(LIMIT)
        load().QUERIES["play_type"](spark, SF)
        assert spark.conf.get(LIMIT) == "8000"
        spark.conf.set(LIMIT, "5000")
        load().QUERIES["play_type"](spark, SF)
        assert spark.conf.get(LIMIT) == "5000"
    finally:
        spark.conf.set(LIMIT, before)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["frame_matches", "identity_switches", "nearest_opponent"])
def test_what_is_keyed_on_the_play_is_not_shuffled(spark, name, capsys):
    df = load().QUERIES[name](spark, SF)
    df.explain()
    assert "Exchange hashpartitioning" not in capsys.readouterr().out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_tracks_are_folded_once(spark, capsys):
    load().QUERIES["player_tracks"](spark, SF).explain()
    assert capsys.readouterr().out.count("MapInPandas") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_equal_rows_meet_across_a_union_of_buckets(spark):
    rows = Tables(spark, SF).trk.select("game_id", "play_id", "frame_id", "event")
    assert rows.unionByName(rows).distinct().count() == rows.distinct().count() == 1500
    assert load().QUERIES["deduplicated_rows"](spark, SF).count() == 1500
