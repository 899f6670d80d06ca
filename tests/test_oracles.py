"""Every registered query with an oracle agrees with DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, oracle_connection
from trajecta.plans.catalog import ORACLES, QUERIES

ROWS_ONLY = {"kmeans_archetypes", "stability_draws", "file_fingerprints"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, entry.queries()[name], ORACLES[name], sf_dir) == ""


def test_only_fits_and_files_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def test_no_result_is_empty_by_accident(spark, sf_dir):
    for name in ("kmeans_archetypes", "file_fingerprints"):
        assert entry.queries()[name](spark, sf_dir).take(1)


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "entity", "grp", "peak_period", "strong_width", "strong_runs", "concentration",
        "recency", "start_period", "end_period", "asymmetry", "ongoing",
    ]
    assert df.count() > 0
