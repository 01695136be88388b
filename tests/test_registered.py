"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from check import compare, duck
from pactframe.plans import load
from pactframe.plans.registry import PLANS

FOLDER = "/root/testdata/sf0.001"
load()
QUERIES = sorted(PLANS)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_flagship(spark):
    assert entry.entry(spark).count() == 31


def test_every_oracle_has_a_query():
    assert set(PLANS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    diff, _, rows, _ = compare(spark, con, name, FOLDER)
    assert diff is None, diff
    assert rows > 0 or name in ("p7_furniture",)
