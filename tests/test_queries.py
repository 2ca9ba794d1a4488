"""Every registered query with SQL gives the same rows as that SQL on another engine."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from tollgate.plans import catalog

pytest.importorskip("duckdb")

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, small_dir, name):
    result, _ = compare(spark, con, name, entry.queries()[name], ORACLES[name], small_dir)
    assert result.startswith("ok"), result


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "type", "row_count", "fraud_count", "fraud_percentage"]
    assert df.count() == 15


def test_every_query_has_sql_or_fits_a_model():
    """The corpus queries are held to brute force and round trips in their own tests."""
    rest = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert all(n.startswith(("f", "h6")) for n in rest), rest
