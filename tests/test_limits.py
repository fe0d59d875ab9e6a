"""Nothing is cut, capped or dropped: probes at the edges of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions.formats import fmt_value
from metricloom.functions.lines import parse_lines
from metricloom.operators import counts as C
from metricloom.operators import dims, fit, patterns, synth, temporal
from metricloom.plans import flows
from metricloom.sources import captures
from metricloom.sources import tables as t
from metricloom.streaming import jobs

D = "/root/testdata/sf0.001"


def parsed(spark, *lines):
    return parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()


def test_long_count_tokens_and_error_lines(spark):
    hist = parsed(spark, f"!M 1493773500 #{'0' * 110}5 30 name source=a")[0]
    assert hist.record_type == "histogram" and hist.centroids[0]["count"] == 5
    bad = "bad name " + "x" * 500
    assert parsed(spark, bad)[0].error_text == bad


def test_very_large_values(spark):
    rows = spark.createDataFrame([(1e40,), (-1e38,), (1e36,), (1.7e308,)], "v double").select(fmt_value(F.col("v")).alias("x")).collect()
    assert [float(r.x) for r in rows] == [1e40, -1e38, 1e36, 1.7e308]


def test_tag_types_follow_the_number_rule(spark):
    rows = [("f", "tag:a", v, 1) for v in ("5d", "12f", "NaN", "7x")] + [("f", "tag:b", v, 1) for v in ("5", "1.5", "-2e3")]
    counts = spark.createDataFrame(rows, "family_id string, dim string, value string, n bigint")
    samples = spark.createDataFrame([("f", 10)], "family_id string, samples bigint")
    got = {r.key: r.numeric_share for r in dims.tag_schema(counts, samples, ["family_id"]).collect()}
    assert got == {"a": 0.0, "b": 1.0}


def test_patterns_match_their_own_text(spark):
    texts = ["web(1", "a.b", "x[9]{2}", "c:\\d\\e", "a+b*c?", "^p|q$", "host-7_Z", ""]
    df = spark.createDataFrame([(x,) for x in texts], "text string").withColumn("pattern", patterns.generalize(F.col("text")))
    made = df.withColumn("made", synth.expand_pattern(F.col("pattern"), 3, F.lit(1))).selectExpr(
        "text", "text RLIKE concat('^', pattern, '$') AS own", "made RLIKE concat('^', pattern, '$') AS drawn"
    )
    assert all(r.own and r.drawn for r in made.collect())
    assert not df.where("text = 'a.b'").selectExpr("'aXb' RLIKE concat('^', pattern, '$') AS x").first().x


def test_draws_reach_every_value(spark):
    n = 700
    counts = spark.range(n).selectExpr("'k' AS key", "concat('v', id) AS value", "CAST(1 + id % 3 AS BIGINT) AS n")
    rows = spark.range(40000).selectExpr("id", "'k' AS key", "id / 40000.0D AS u")
    got = synth.draw_values(rows, counts, ["key"], "value", "u", "out").groupBy("out").count().collect()
    weight = {f"v{i}": 1 + i % 3 for i in range(n)}
    assert len(got) == n and sum(r["count"] for r in got) == 40000
    assert all(abs(r["count"] - 40000 * weight[r.out] / sum(weight.values())) <= 1.001 for r in got)


def test_fit_far_from_zero(spark):
    counts = spark.range(7).selectExpr("'k' AS key", "1.7e9D + id AS value", "CAST(100 AS BIGINT) AS n")
    got = fit.parameters(counts, ["key"]).first()
    assert abs(got["std"] - 2.0) < 1e-6 and got["shape"] > 1e17


@pytest.mark.parametrize("shape", [1, 2, 7, 1000, 9999, 10000, 50000])
def test_gamma_against_poisson_sums(shape):
    x = shape * np.array([0.9, 0.99, 1.0, 1.0005, 1.01, 1.1])
    k = np.arange(shape)
    logs = np.array([math.lgamma(i + 1) for i in k])
    want = [1 - np.exp(-v + k * math.log(v) - logs).sum() for v in x]
    assert np.allclose(fit.gamma_cdf_values(np.full(6, float(shape)), x), want, atol=1e-8)


def test_gamma_at_its_shape():
    big = np.array([1e5, 1e6, 1e12])
    assert np.allclose(fit.gamma_cdf_values(big, big), 0.5 + 1 / (3 * np.sqrt(2 * np.pi * big)), atol=1e-9)


@pytest.mark.parametrize("files", [1, 4, 16])
def test_replayed_streams_lose_nothing(spark, files):
    p = t.with_series(t.points(spark, D)).repartition(files)
    out = flows.replayed_table(p, f"tumbling-{files}", jobs.tumbling_counts).where("family_id <> 'flush'")
    assert out.agg(F.sum("lines")).first()[0] == p.count()


def test_stream_resumes(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for step in range(3):
        spark.range(step * 10, step * 10 + 10).selectExpr("CAST(id AS STRING) AS value").coalesce(1).write.mode("append").text(source)
        lines = jobs.stream_lines(spark, source, "part-*")
        table, _ = jobs.run_to_table(lines, "resume", path=out, checkpoint=checkpoint)
        assert sorted(int(r.value) for r in table.collect()) == list(range(step * 10 + 10))


def test_counts_survive_crowded_values(spark):
    values = [1e9 + i * 1e-3 for i in range(500)]
    counts = C.value_counts(spark.createDataFrame([("k", v) for v in values], "key string, value double"), ["key"], "value")
    got = C.exact_quantiles(counts, ["key"], "value").first()
    assert abs(got.p50 - float(np.quantile(values, 0.5))) < 1e-6


def test_a_hot_place_is_spread_and_its_files_are_bounded(spark, tmp_path):
    lines = spark.range(20000).selectExpr(
        "concat('line ', id, sha2(cast(id AS string), 512)) AS value", "'2024-01-01' AS dt", "'m' AS mig", "if(id % 100 = 0, 'b', 'a') AS instance"
    )
    with jobs.settings(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k"}):
        captures.sink_capture(lines.repartition(16), str(tmp_path / "x"), lines_per_file=3000)
    back = captures.scan_layout(spark, str(tmp_path / "x"))
    files = back.where("instance = 'a'").groupBy("file_path").count().collect()
    tasks = {f.file_path.split("part-")[1].split("-")[0] for f in files}
    assert back.count() == 20000 and max(f["count"] for f in files) <= 3000 and len(tasks) >= 4


def test_rows_without_time_are_kept(spark):
    rows = [("k", 100), ("k", None), ("k", 130), ("k", 9000), ("k", None)]
    df = spark.createDataFrame(rows, "key string, ts bigint")
    got = temporal.previous_in_series(df, ["key"], "ts", ["ts"]).collect()
    assert sorted((r.ts or 0, r.prev_ts or 0) for r in got) == [(0, 0), (0, 0), (100, 0), (130, 100), (9000, 130)]


def test_globs_with_leading_wildcards(spark):
    import fnmatch

    names = ["app.cpu", "app.cpu.x", "sys.x", "x", "", "a?b", "app"]
    globs = ["*.x", "app*", "*", "app.*.x", "?", "*cpu*", "app.cpu", "s*x", "a??"]
    left = spark.createDataFrame([(x,) for x in names], "name string")
    right = spark.createDataFrame([(x,) for x in globs], "glob string")
    got = {tuple(r) for r in synth.match_globs(left, "name", right, "glob").collect()}
    assert got == {(n, g) for n in names for g in globs if fnmatch.fnmatchcase(n, g)}
    assert synth.match_globs(left, "name", right.limit(0), "glob").count() == 0
