"""Counting operators against brute force, with one key holding a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.operators import counts as C
from metricloom.operators import dims, fit, patterns, synth, temporal

PROBS = [0.01, 0.05, 0.5, 0.95, 0.99]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 6000
    key = np.where(rng.random(n) < 0.34, "hot", np.char.add("k", rng.integers(0, 20, n).astype(str)))
    value = np.round(rng.normal(0, 50, n), 2)
    value[:200] = 0.0
    ts = 1_700_000_000 + rng.integers(0, 50_000, n)
    rows = [(int(i), str(k), float(v), int(x)) for i, (k, v, x) in enumerate(zip(key, value, ts))]
    return rows, spark.createDataFrame(rows, "id bigint, k string, v double, ts bigint").repartition(8)


def groups(rows, i=2):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r[i])
    return out


def test_exact_quantiles(skewed):
    rows, df = skewed
    got = {r.k: r for r in C.exact_quantiles(C.value_counts(df, ["k"], "v"), ["k"], "v", total="n").collect()}
    for k, vs in groups(rows).items():
        want = np.percentile(vs, [p * 100 for p in PROBS])
        assert got[k].n == len(vs)
        assert np.allclose([got[k][p] for p in C.PROBS], want, atol=1e-9)


def test_order_bucket_is_monotone(spark):
    vals = sorted([-1e300, -5.5, -5.4, -1e-300, 0.0, 1e-300, 0.1, 0.1000001, 1.0, 2.0, 1e300])
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(C.order_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def test_cumulative_counts(skewed):
    rows, df = skewed
    out = C.cumulative_counts(C.value_counts(df, ["k"], "v"), ["k"], "v").collect()
    by = groups(rows)
    for r in out[::17]:
        assert r.cum == sum(v <= r.v for v in by[r.k]) and r.total == len(by[r.k])


def test_moments_and_entropy(skewed):
    rows, df = skewed
    m = {r.k: r for r in C.moments(C.value_counts(df, ["k"], "v"), ["k"], "v").collect()}
    e = {r.k: r for r in C.entropy_stats(C.value_counts(df, ["k"], "v"), ["k"]).collect()}
    for k, vs in groups(rows).items():
        assert np.isclose(m[k].mean, np.mean(vs)) and np.isclose(m[k].stddev, np.std(vs, ddof=1))
        p = np.unique(vs, return_counts=True)[1] / len(vs)
        assert np.isclose(e[k].entropy, -(p * np.log2(p)).sum()) and e[k].distinct_count == len(p)


def test_newest_per_group_keeps_exactly_the_newest(skewed):
    rows, df = skewed
    got = {}
    for r in C.newest_per_group(df, ["k"], [F.desc("ts"), F.desc("id")], 50, F.col("id")).collect():
        got.setdefault(r.k, []).append((r.rank, r.id))
    by = {}
    for i, k, _v, x in rows:
        by.setdefault(k, []).append((x, i))
    for k, items in by.items():
        assert [i for _, i in sorted(got[k])] == [i for _, i in sorted(items, reverse=True)[:50]]


def test_gaps_across_time_buckets(skewed):
    rows, df = skewed
    gaps = temporal.gap_counts(df, ["k"], bucket_seconds=1000).collect()
    got = {}
    for r in gaps:
        got.setdefault(r.k, []).extend([r.gap] * r.n)
    for k, ts in groups(rows, 3).items():
        assert sorted(got.get(k, [])) == sorted(np.diff(sorted(ts)).tolist())


def test_spread_sequence_is_complete(spark):
    df = spark.createDataFrame([("a", 25_003), ("b", 0), ("c", 1)], "k string, n bigint")
    out = C.spread_sequence(df, ["k"], "n", "i", chunk=1000)
    assert {(r.k, r.c, r.lo, r.hi) for r in out.groupBy("k").agg(F.countDistinct("i").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi")).collect()} == {
        ("a", 25_003, 0, 25_002), ("c", 1, 0, 0)}


def test_histogram_bins_keep_every_row(skewed):
    rows, df = skewed
    counts = C.value_counts(df, ["k"], "v")
    q = C.exact_quantiles(counts, ["k"], "v")
    dense = C.dense_bins(C.histogram_bins(counts, q, ["k"], "v"), q, ["k"])
    got = {r.k: (r.n, r.bins) for r in dense.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("bins")).collect()}
    assert got == {k: (len(v), 32) for k, v in groups(rows).items()}


def test_ks_of_a_fitted_exponential_is_small(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), (-F.ln(1 - (F.col("id") + 0.5) / 20_000) * 3).alias("v"))
    counts = C.value_counts(df, ["k"], "v")
    params = fit.parameters(counts, ["k"], "v")
    ks = fit.ks_statistics(counts, params, ["k"], value="v")
    best = fit.best_fit(params, ks, ["k"]).first()
    assert best.type in ("exponential", "gamma") and best.ks_statistic < 0.01 and best.ks_p_value > 0.5
    assert ks.first().ks_gamma < 0.01


def test_match_globs(spark):
    names = spark.createDataFrame([("app.click",), ("app.view",), ("sys.cpu",)], "name string")
    globs = spark.createDataFrame([("app.*",), ("*.cpu",), ("app.vie?",), ("*",), ("app.click",), ("app.x*",)], "g string")
    got = {(r.name, r.g) for r in synth.match_globs(names, "name", globs, "g").collect()}
    assert got == {("app.click", "app.*"), ("app.view", "app.*"), ("sys.cpu", "*.cpu"), ("app.view", "app.vie?"),
                   ("app.click", "*"), ("app.view", "*"), ("sys.cpu", "*"), ("app.click", "app.click")}


def test_generalize(spark):
    df = spark.createDataFrame([("Host-12ab_Xd9",)], "s string")
    assert df.select(patterns.generalize(F.col("s"))).first()[0] == r"[A-Z]+[a-z]+-\d+[a-z]+_[A-Z]+[a-z]+\d+"


def test_tag_types(spark):
    rows = []
    for i in range(40):
        rows.append({"num": str(i), "uid": f"svc-{i % 3}x", "txt": f"t{i}", "cat": "ab"[i % 2]})
    df = spark.createDataFrame([("f", "s", r) for r in rows], "family_id string, source string, tags map<string,string>")
    fam = df.groupBy("family_id").agg(F.count("*").alias("samples"))
    got = {r.key: r.type for r in dims.tag_schema(dims.dim_counts(df, ["family_id"]), fam, ["family_id"]).collect()}
    assert got == {"num": "numeric", "uid": "identifier", "txt": "text", "cat": "categorical"}
