"""Every catalog query against its DuckDB SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cyclelens.catalog import QUERIES
from oracles import ORACLES
from tests.compare import connect, differences
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, name, SF, QUERIES, ORACLES) is None


def test_entry(spark):
    assert entry(spark).count() > 0
