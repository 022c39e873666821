"""Every registered stack query against its SQL."""

import pytest
from helpers import DATA, rows

from stackwise.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_linear_correction_of_whole_frames(spark):
    """The query, which its SQL checks row by row, returns all eight rows of each frame."""
    frames = QUERIES["correct_linear_defects"](spark, DATA).groupBy("frame_id").count().collect()
    assert frames and all(r["count"] == 64 for r in frames)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 640
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
