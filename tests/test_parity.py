"""Every registered query against its DuckDB twin at sf0.001."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from callsift.workload.queries import ORACLES, QUERIES
from tests.parity import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    problem = difference(spark, duck, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem in (None, "no rows on either side")


def test_entry(spark):
    assert entry(spark).count() > 0
