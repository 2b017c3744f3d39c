"""Driver contract: entry smoke, registry shape, and every oracle-checked
query against DuckDB at sf0.001."""

import pytest

import __spark_entry__ as E
from tablesight.plans.verify import compare, oracle_connection

from .conftest import SF_SMALL


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1 and "duplicate_rows" in df.columns


def test_registry_shape():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_match(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), con, E.oracle_sql()[name])
    assert ok, msg
