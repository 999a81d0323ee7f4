"""Every registered query against its SQL twin; queries without one must give rows."""
import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf):
    if SQL.get(name) is None:
        assert len(QUERIES[name](spark, sf).head(1)) == 1
        return
    text, ok, _ = oracle.compare(spark, duck, QUERIES[name], SQL[name], sf)
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
