"""Every registered query against its SQL counterpart on the smallest data folder."""

import pytest
from check_against_sql import compare, connect

from gridspark.registry import ORACLE, QUERIES

# Model fits are tested in test_ml.py on one fit instead of once per query.
SLOW = ("g2_", "g3_", "g7_", "g8_", "i3_incident_stream")


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(SLOW)])
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) == ""
    else:
        assert df.count() > 0


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert df.count() == 10
    assert "outages_within_radius" in df.columns
