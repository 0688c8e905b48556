"""Every registered query builds, and has the columns of its statement."""

import os
import sys

import duckdb
import pytest

from snapspan.catalog import load

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_every_query_builds(spark, monkeypatch):
    registry = load()
    # plans are only built, so nothing needs to be written in between
    for name, module in list(sys.modules.items()):
        if name.startswith("snapspan.operators") and hasattr(module, "cut_lineage"):
            monkeypatch.setattr(module, "cut_lineage", lambda df: df)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    wrong = []
    for name, build in registry.QUERIES.items():
        try:
            columns = build(spark, SF).columns
            if name in registry.ORACLES and sorted(columns) != sorted(con.sql(registry.ORACLES[name]).columns):
                wrong.append((name, "columns differ"))
        except Exception as e:  # noqa: BLE001
            wrong.append((name, f"{type(e).__name__}: {str(e)[:200]}"))
    assert not wrong
