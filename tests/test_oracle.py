"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_point
from registered.queries import QUERIES

from .oracle import compare, connect

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    sql = entry_point.oracle_sql()[name]
    assert compare(spark, con, sf_dir, name, entry_point.queries()[name], sql) is None


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert df.columns == ["company_id", "email", "source", "source_details", "confidence"]
