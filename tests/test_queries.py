"""Every registered query against its SQL on the smallest tables."""

import pytest

from pagestrata import plans
from tests.oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in plans.QUERIES if n in plans.SQL])
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note
