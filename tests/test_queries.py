"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from workload import catalog
from workload.check import ROOT, compare, database

SF_DIR = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog()))
def test_query(spark, con, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    assert compare(ours, con.execute(entry.oracle_sql()[name]).fetchdf()) == "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
