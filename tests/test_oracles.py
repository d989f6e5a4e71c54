"""Every screen query that SQL can express equals its oracle, exactly."""

import pytest

from loomscreen.plans import catalog

from .oracle import connect, oracle, ours, same

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(D)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = ours(catalog.QUERIES[name](spark, D))
    if name in catalog.ORACLES:
        assert not same(got, oracle(duck, catalog.ORACLES[name]))
