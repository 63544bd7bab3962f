"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, SQL.get(name)) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["exp_code", "cell_idx", "total", "layer_pos", "prev_quantity", "price"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
