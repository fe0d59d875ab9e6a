"""A recipe with every optional block, its contract check and its JSON round trip; recipes from days."""

import json

import pytest
from pyspark.sql import functions as F

from metricloom.functions.keys import family_id
from metricloom.functions.lines import parse_lines
from metricloom.operators import quality
from metricloom.plans import recipe
from metricloom.schemas import TAGS
from metricloom.session import work_dir
from metricloom.sources import recipes as store
from metricloom.sources import tables as t

D = "/root/testdata/sf0.001"


def test_full_recipe(spark):
    li = t.table(spark, D, "lineitem")
    points = t.with_line_length(
        li.select(
            F.lit("sales.quantity").alias("metric"), F.col("l_quantity").alias("value"),
            (t.epoch(F.col("l_shipdate")) + t.EPOCH_SHIFT).alias("ts"), F.concat(F.lit("flag-"), "l_returnflag").alias("source"),
            F.create_map().cast(TAGS).alias("tags"), F.lit(False).alias("is_delta"),
        ).withColumn("family_id", family_id(F.col("metric"), F.col("tags")))
    )
    cut = F.lit(t.EPOCH_SHIFT + 883612800)
    errors = quality.error_rates(parse_lines(t.bad_lines(spark, D)))
    full = recipe.assemble(points, cut, t.histograms(spark, D), errors)
    path = work_dir(spark, "test-recipe")
    store.sink_recipes(full, path, as_json=True)
    back = store.scan_recipes(spark, path, as_json=True)
    r = back.first()
    assert r.schema["has_histogram"] and r.statistics.histogram_distribution.granularities == {"D": 1.0}
    assert 0 < r.validation.coverage < 1 and r.validation.drop_reasons["invalid_tag"] > 0
    assert abs(r.payload.error_rate - (1 - r.validation.coverage)) < 1e-9
    assert len(r.temporal.intensity_curve) == 1440 and abs(sum(r.temporal.intensity_curve) - 1440) < 1e-6
    assert r.statistics.parametric.type in ("normal", "log_normal", "exponential", "gamma")
    assert r.patterns.source_patterns[0].pattern == "[a-z]+-[A-Z]+"
    assert recipe.validate(back).count() == 0
    broken = back.withColumn("version", F.lit("2"))
    assert "version" in {x.rule for x in recipe.validate(broken).collect()}


def near(a, b):
    if isinstance(a, dict):
        assert a.keys() == b.keys()
        for k in a:
            near(a[k], b[k])
    elif isinstance(a, list):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            near(x, y)
    else:
        assert a == (pytest.approx(b, abs=1e-9, rel=1e-9) if isinstance(b, float) else b)


def test_days_one_by_one_equal_one_run(spark):
    """Whole recipes, every leaf; the second day comes in two parts, one of them late."""
    points = t.points(spark, D)
    cut, path = t.split_epoch(), work_dir(spark, "days")
    late = (F.col("row_id") % 5 == 0) & (F.col("ts") < cut)
    for part in (F.col("ts") < cut - 3 * recipe.DAY, F.col("ts") >= cut + 86400 * 2, (F.col("ts") >= cut - 3 * recipe.DAY) & (F.col("ts") < cut + 86400 * 2)):
        recipe.add_day(points.filter(part & ~late), path)
    recipe.add_day(points.filter(late), path)

    def rows(df):
        return {r["family_id"]: json.loads(r["j"]) for r in df.drop("created_at").select("family_id", F.to_json(F.struct("*")).alias("j")).collect()}

    one, many = rows(recipe.assemble(points, cut)), rows(recipe.from_days(recipe.stored_days(spark, path), cut))
    assert one.keys() == many.keys() and len(one) == 10
    for family in one:
        near(one[family], many[family])


def test_points_are_scanned_once(spark):
    plan = recipe.day_counts(t.points(spark, D))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1


def test_blocks_read_their_own_rows(spark):
    """Points are scanned and shuffled once into totals; the parser of tag sets meets no source or number."""
    rows = recipe.totals(recipe.long_points(t.points(spark, D)), t.split_epoch())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1
    combos = recipe.of_part(recipe.stored_totals(rows), "combo")
    assert "(part" in combos._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert {r.dim for r in combos.select("dim").distinct().collect()} == {"combo"}


def test_values_are_generalised_once(spark, monkeypatch):
    calls = []
    real = recipe.patterns.generalize
    monkeypatch.setattr(recipe.patterns, "generalize", lambda text: calls.append(1) or real(text))
    dims = spark.createDataFrame([("f", "source", "ab-1", 2), ("f", "source", "", 1), ("f", "source", "é😀", 3)], "family_id string, dim string, value string, n bigint")
    shapes = {p.pattern: p for p in recipe.pattern_structs(dims).first().patterns}
    assert len(calls) == 1
    assert shapes["[a-z]+-\\d+"].char_distributions.bigrams == {"ab": 1 / 3, "b-": 1 / 3, "-1": 1 / 3}
    assert shapes["é😀"].char_distributions.unigrams == {"é": 0.5, "😀": 0.5} and shapes["é😀"].char_distributions.trigrams is None
    assert shapes[""].length_distribution.max == 0 and shapes[""].char_distributions.unigrams is None


def test_halves_of_one_table_score_like_two_tables(spark):
    schema = "family_id string, dim string, value string, before bigint, after bigint"
    rows = [("a", "source", "x", 3, 1), ("a", "source", "y", None, 2), ("a", "tag:k", "1", 4, None), ("a", "tag:z", "1", None, 4), ("b", "source", "x", None, 5), ("c", "source", "x", None, None)]
    both = spark.createDataFrame(rows, schema)
    keys = ["family_id"]

    def half(name):
        return both.filter(F.col(name).isNotNull()).select("family_id", "dim", "value", F.col(name).alias("n"))

    two = sorted(recipe.V.js_scores(half("before"), half("after"), keys).collect())
    one = sorted(recipe.V.js_halves(both, keys, "before", "after").collect())
    assert len(one) == 2
    for x, y in zip(one, two, strict=True):
        near(x.asDict(), y.asDict())
