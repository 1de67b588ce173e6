"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import pytest

from caseweave.checks.compare import compare, connect
from caseweave.checks.oracles import ORACLES
from caseweave.checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    n, problem = compare(spark, duck, SF_DIR, QUERIES[name], ORACLES[name])
    assert problem is None and n > 0
