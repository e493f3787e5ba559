"""Every registered query with SQL agrees with DuckDB on the smallest scale."""

import oracle
import pytest
from helpers import SMALL

import __spark_entry__ as entry

SQL = entry.oracle_sql()
# Slow to run once more here; the driver and tests/oracle.py check them at a larger scale.
ELSEWHERE = {"live_beaconing", "live_ingest", "alert_snapshots", "cascade_nodes", "path_edges"}


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", [n for n in SQL if n not in ELSEWHERE])
def test_query_matches_sql(spark, duck, name):
    problem, _ = oracle.compare(entry.queries()[name](spark, SMALL), duck, SQL[name])
    assert not problem


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["source_asset", "band", "events", "worst"] and df.count() > 0


def test_names_are_consistent():
    assert set(SQL) <= set(entry.queries())
