"""Every query of this package at the smallest scale, against its SQL twin where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from metricloom.llm.queries import ORACLES, QUERIES  # noqa: E402
from oracle import compare, connect  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [x for x in QUERIES if x != "pipeline"])
def test_query(spark, name):
    df = QUERIES[name](spark, D)
    if name in ORACLES:
        assert compare(df, connect(D), ORACLES[name]) is None
    else:
        assert df.columns and (df.count() > 0 or name == "op5_decontamination")
