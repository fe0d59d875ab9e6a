"""Draws reach all values of a family, whatever their number."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from metricloom.functions import sqlnames
from metricloom.functions.draws import uniform
from metricloom.operators import synth

POINTS = "p01 double, p05 double, p50 double, p95 double, p99 double"


def families(spark, rows):
    return spark.createDataFrame(
        [(f, "m", False, 1.0, 2.0, 3.0, 4.0, 5.0, keys, patterns) for f, keys, patterns in rows],
        f"family_id string, metric string, is_delta boolean, {POINTS}, tag_keys array<struct<key:string,presence:double>>, source_patterns array<struct<value:string,weight:double,cum:double>>",
    )


def test_five_thousand_sources_in_proportion(spark):
    n = 5000
    counts = [("f", "source", f"s{i}", 1 + (i % 10 == 0) * 9) for i in range(n)] + [("f", "tag:k", f"v{i}", 1) for i in range(300)] + [("f", "tag:k", "big", 300)]
    counts = spark.createDataFrame(counts, "family_id string, dim string, value string, n bigint")
    budget = spark.createDataFrame([("f", m, 2000) for m in range(50)], "family_id string, mod bigint, rows bigint")
    made = synth.points(budget, families(spark, [("f", [("k", 0.5)], None)]), counts, ["family_id"], 5, 0).select("source", F.col("tags")["k"].alias("k"), "ts", "value").collect()
    assert len(made) == 100_000
    sources = Counter(r["source"] for r in made)
    heavy = sum(c for s, c in sources.items() if int(s[1:]) % 10 == 0)
    assert len(sources) > 4990 and heavy / len(made) == pytest.approx(10 / 19, abs=0.01)
    tags = Counter(r["k"] for r in made)
    assert tags[None] / len(made) == pytest.approx(0.5, abs=0.01)
    assert tags["big"] / (len(made) - tags[None]) == pytest.approx(0.5, abs=0.02) and len(tags) == 302
    assert all(0 <= r["ts"] < 3000 and 1 <= r["value"] <= 5 for r in made)


def test_families_without_values_fall_back(spark):
    none = spark.createDataFrame([], "family_id string, dim string, value string, n bigint")
    budget = spark.createDataFrame([("p", 0, 20), ("h", 0, 20)], "family_id string, mod bigint, rows bigint")
    pattern = [("web-\\d{3}", 1.0, 1.0)]
    made = synth.points(budget, families(spark, [("p", [("env", 1.0)], pattern), ("h", None, None)]), none, ["family_id"], 5, 0)
    rows = made.collect()
    assert len(rows) == 40
    assert all(__import__("re").fullmatch(r"web-\d{3}", r["source"]) and r["tags"]["env"] in synth.ENVIRONMENTS for r in rows if r["family_id"] == "p")
    assert all(r["source"].startswith("host-") and not r["tags"] for r in rows if r["family_id"] == "h")


def test_every_value_is_met_once(spark):
    counts = [("a", f"v{i}", 1 if i % 3 else 500) for i in range(400)] + [("b", "only", 7)]
    frame = spark.createDataFrame(counts, "key string, value string, n bigint")
    rows = spark.createDataFrame([("a", i / 20000) for i in range(20000)] + [("b", 0.0), ("b", 0.999999), ("c", 0.5)], "key string, u double")
    got = synth.draw_values(rows, frame, ["key"], "value", "u", "out").groupBy("key", "out").count().collect()
    assert sum(r["count"] for r in got) == 20002
    total = sum(n for k, _, n in counts if k == "a")
    for r in got:
        if r["key"] == "a":
            n = dict((v, n) for k, v, n in counts if k == "a")[r["out"]]
            assert abs(r["count"] - 20000 * n / total) <= 1
    left = synth.draw_values(rows, frame, ["key"], "value", "u", "out", "left").where("key = 'c'").collect()
    assert [r["out"] for r in left] == [None]


def test_sql_draws_equal_column_draws(spark):
    sqlnames.register(spark)
    rows = spark.range(50).select(F.col("id").cast("string").alias("row"))
    both = rows.select(uniform(7, F.col("row"), "source").alias("a"), F.expr("telemetry_uniform('7', row, 'source')").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)
