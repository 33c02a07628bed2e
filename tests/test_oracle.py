"""Every query that has an SQL twin agrees with it on the smallest tables."""

import pytest
from compare import connect, difference

from slicelens.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, folder, name):
    assert difference(QUERIES[name](spark, folder), con, ORACLES[name]) is None


def test_every_twin_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()
