"""Golden values of series spaces and repeatable strings, and determinism of synthesis."""

import re

from pyspark.sql import functions as F

from metricloom.functions.draws import uniform
from metricloom.functions.keys import deterministic_string, fnv1a, levelled_suffix
from metricloom.operators import series
from metricloom.plans import comparison, synthesis
from metricloom.sources import tables as t

D = "/root/testdata/sf0.001"


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def test_repeatable_strings(spark):
    seed = F.lit("seed")
    s40, s41, other = one(spark, deterministic_string(seed, 40), deterministic_string(seed, 41), deterministic_string(seed, 40, "12345"))
    assert s40 == "Wz9JJ3zRVx4rZKKRDu50PFzH6J1ux9NS9AbrNVzd"
    assert len(s41) == 41 and s41.startswith(s40) and other != s40


def test_levelled_suffix_shapes(spark):
    x = "[A-Za-z0-9]"
    for (levels, length), shape in {
        (0, 0): rf"m\.1\.{x}{{8}}",
        (4, 0): rf"m\.1\.{x}{{8}}\.{x}{{8}}",
        (0, 30): rf"m\.1\.{x}{{26}}",
        (4, 30): rf"m\.1\.{x}{{8}}\.{x}{{17}}",
        (2, 5): rf"m\.1\.{x}{{8}}",
    }.items():
        got = one(spark, levelled_suffix(F.lit("m.1"), levels, length))[0]
        assert re.fullmatch(shape, got), (levels, length, got)


def test_fnv1a(spark):
    assert one(spark, fnv1a(F.lit("")), fnv1a(F.lit("a")), fnv1a(F.lit("foobar"))) == [-2128831035, -468965076, -1080231576]


def test_weighted_dims(spark):
    golden = [(((1, 1), 100), [10, 10]), (((2, 2), 1000), [32, 32]), (((3, 1), 100), [17, 6]),
              (((3, 1), 1000), [55, 18]), (((3, 2, 1), 1000), [17, 11, 6])]
    for (weights, target), want in golden:
        assert one(spark, *series.weighted_dims([F.lit(w) for w in weights], F.lit(target))) == want


def test_pegged_dims(spark):
    for (pegs, target), want in [(((5, 0), 100), [5, 20]), (((5, 0, 0), 100), [5, 4, 4]), (((5, 0, 0), 1000), [5, 14, 14])]:
        assert one(spark, *series.pegged_dims([F.lit(p) for p in pegs], F.lit(target))) == want


def test_draws_do_not_depend_on_partitioning(spark):
    one_way = spark.range(0, 1000, 1, 1).select("id", uniform(1, F.col("id"), "x").alias("u"))
    other = spark.range(0, 1000, 1, 13).repartition(5).select("id", uniform(1, F.col("id"), "x").alias("u"))
    assert one_way.exceptAll(other).count() == 0


def test_synthetic_table_is_close_to_its_source(spark):
    """Profile, synthesise the same volume, compare: volume within 5 %, categories and values close."""
    p = t.points(spark, D).filter(F.col("is_delta"))
    days = p.select(F.countDistinct(F.floor(F.col("ts") / 86400))).first()[0]
    s = synthesis.synth.points(synthesis.day_budget(p, days * 20.0), *synthesis.family_samplers(p), ["family_id"], 9, synthesis.DAY0)
    made = t.with_line_length(s.withColumn("row_id", F.lit(0)))
    fam = ["family_id"]
    assert abs(made.count() / (p.count() * 20) - 1) < 0.05
    js = comparison.V.js_scores(comparison.D.dim_counts(p, fam), comparison.D.dim_counts(made, fam), fam).collect()
    assert all(r.js_categorical < 0.05 for r in js)
    q = [comparison.C.exact_quantiles(comparison.C.value_counts(x, fam, "value"), fam, "value") for x in (p, made)]
    assert all(r.wasserstein < 0.05 for r in comparison.V.wasserstein(q[0], q[1], fam).collect())
