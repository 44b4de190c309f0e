"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from tests.compare import compare, duck
from tests.conftest import SF
from textloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    said, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert said.startswith(("ok", "rows")), said


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
