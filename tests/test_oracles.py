"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    problem, rows, _, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert not problem
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
