"""Replays of scored windows stage what the windows are counted from, no key that nothing reads."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.plans import flows
from metricloom.plans.catalog import QUERIES
from metricloom.streaming.stateful import Panes


class Staged(Exception):
    pass


@pytest.mark.parametrize("name", ["stream_alert_counts", "stream_divergence", "stream_divergence_minute"])
def test_only_read_columns_are_staged(spark, monkeypatch, name):
    def replayed(points, *_):
        raise Staged(points.columns)

    monkeypatch.setattr(flows, "replayed", replayed)
    with pytest.raises(Staged) as seen:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert set(seen.value.args[0]) == {"family_id", "ts", "source", "value", "line_length", "tags"}


def test_closing_row_comes_from_the_staged_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(flows, "closing", lambda points: seen.append(points) or points.limit(1))
    flows.replayed(spark.range(3).withColumn("ts", F.col("id")), "staged-once", lambda stream: None)
    files = seen[0].inputFiles()
    assert files and all("/step=1/" in name for name in files)


def test_pieces_of_panes_keep_every_value():
    rows = pd.DataFrame({"pane": [60, 60, 120, 180], "value": pd.Series(["a", None, "", "é😀"], dtype=object), "n": [1, 2, 1 << 40, 3]})
    back = Panes.unpack(bytearray(Panes.pack(rows)))
    assert back.to_dict("list") == rows.to_dict("list")
