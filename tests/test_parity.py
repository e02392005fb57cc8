"""Every query with SQL gives exactly the rows DuckDB gives."""

import pytest

from cardwatch.plans.catalogue import QUERIES
from cardwatch.plans.oracle import ORACLE
from tests.parity import check, connect


def test_every_statement_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_parity(spark, con, sf, name):
    found, rows = check(spark, con, name, sf)
    assert not found and rows > 0
