"""Every registered query beside its SQL on the small tables."""

import pytest

import __spark_entry__ as entry_points
from tools.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    row = entry_points.entry(spark).first()
    assert row.total_tickets == row.auto_routed_count + row.human_review_count > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, con, SQL[name]).startswith("ok")
    else:
        assert df.collect()
