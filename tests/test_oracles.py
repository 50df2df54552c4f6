"""Every registered query against its SQL oracle on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from checks.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_fixture_distribution(spark):
    from checks.binding import Data

    levels = {r.risk_level: r["count"] for r in Data(spark, SF_DIR).scored.groupBy("risk_level").count().collect()}
    assert levels == {"High": 32, "Medium": 93, "Low": 25}
