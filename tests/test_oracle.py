"""Every SQL-checkable query equals its independent DuckDB statement (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import duck, rows_of

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    c1, r1 = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(SQL[name])
    c2, r2 = rows_of([d[0] for d in res.description], res.fetchall())
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_every_sql_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["site", "Year", "n", "r2", "rmse", "mae"]
