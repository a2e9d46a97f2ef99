"""Every query with an oracle gives the same values as DuckDB; the others give rows."""

import pytest
from conftest import SF
from oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert difference(ours, duck.execute(ORACLES[name]).df()) is None
    else:
        assert len(ours.columns) > 0
