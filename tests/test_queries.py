"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from check_queries import compare, connect
from hearthbook.catalogue import load

SF = "/root/testdata/sf0.001"
REGISTRY = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    text, ok = compare(spark, con, SF, REGISTRY[name])
    assert ok, text
