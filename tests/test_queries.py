"""Every registered query runs, and equals its SQL, on the smallest tables."""

import os
from pathlib import Path

import pytest

import compare
from topicloom import catalog

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.duck(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = compare.spark_result(QUERIES[name](spark, FOLDER))
    if name in ORACLES:
        assert compare.difference(got, compare.duck_result(con, ORACLES[name])) is None
    else:
        assert got[1]
