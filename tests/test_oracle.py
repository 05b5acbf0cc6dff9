"""Every registered query against its oracle SQL, on all rows of the smallest tables."""

import os

import pytest
from compare import compare, oracle_connection

from meterlight.plans import catalog

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


# A single day; at the smallest scale nothing may have run on it. All others have rows.
MAY_BE_EMPTY = {"quota_usage_map"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, con, name):
    diff = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], SF_DIR)
    if name in MAY_BE_EMPTY and SF_DIR.endswith("sf0.001") and diff == "no rows on either side":
        return
    assert diff is None, diff


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
