"""Registered queries against their SQL on the smallest tables.

``python -m checks.compare`` runs all of them.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, open_tables

SAMPLE = ("prepare_subset", "cleaning_report", "structural_gaps", "flag_outliers",
          "build_features", "daily_sales_ma", "product_metrics", "event_analysis",
          "price_profile", "describe_measures", "chronological_split", "rejected_requests")


@pytest.fixture(scope="module")
def con(sf):
    return open_tables(sf)


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    got = entry(spark)
    assert got.columns == ["date", "total_units", "ma_7", "ma_30"]
    assert got.count() > 2000


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, con, sf, name):
    assert compare(spark, con, sf, name) is None
