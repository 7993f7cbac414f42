"""Every engine query equals its DuckDB twin."""

from __future__ import annotations

import oracle
import pytest

from lakeloom.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert oracle.differences(df, con, catalogue.ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
