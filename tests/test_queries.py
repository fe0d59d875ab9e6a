"""Every named query runs at the smallest scale and equals its SQL twin where it has one."""

import pytest

import __spark_entry__ as entry
from metricloom.plans import load_all
from metricloom.plans.catalog import ORACLES, QUERIES
from oracle import compare, connect

D = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, D)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
