import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p3_found", "p5_found", "weekly_top_n"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_flagship_query(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["event_id", "impact_score", "loaded_day"] and rows.count() > 0
