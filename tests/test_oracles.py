"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from pagefacts.checks import load

SF = "/root/testdata/sf0.001"
NAMES = sorted(load().QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, con, name):
    rows, problem = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert problem is None
    assert rows > 0 or name == "a8_training_set"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
