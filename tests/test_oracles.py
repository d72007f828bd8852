"""Every query with an oracle agrees with DuckDB at the smallest scale."""

import oracle
import pytest

from turnstile import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], con) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["min_from_ko", "comments", "avg_sentiment"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_daily_mean_that_falls_on_a_tie(spark):
    """320 comments of 2024-01-28 at sf0.01 have the mean 0.0230625, whatever pieces they come in."""
    sf = "/root/testdata/sf0.01"
    assert oracle.differences(registry.QUERIES["daily_mean"](spark, sf), registry.ORACLES["daily_mean"], oracle.connect(sf)) == []
