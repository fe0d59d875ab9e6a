"""Parsing: edge lines, round trips and text forms."""

from pyspark.sql import functions as F

from metricloom.functions import formats, sqlnames
from metricloom.functions.lines import parse_lines
from metricloom.sources.captures import pair_two_line_histograms

METRIC = {
    '"my name" 1.5 source=a': ("my name", 1.5, None, "a", {}, False),
    "∆foo 2 1600000000 source=a k=v": ("foo", 2.0, 1600000000, "a", {"k": "v"}, True),
    "Δfoo 2 source=a": ("foo", 2.0, None, "a", {}, True),
    '"∆foo" 2 source=a': ("foo", 2.0, None, "a", {}, True),
    '"Δfoo" 2 source=a': ("foo", 2.0, None, "a", {}, True),
    "a.b 3 source=x k=1234567890": ("a.b", 3.0, None, "x", {"k": "1234567890"}, False),
    "a 1 host=h k=a k=b": ("a", 1.0, None, "h", {"k": "b"}, False),
    "a 1 source=s host=h": ("a", 1.0, None, "s", {"host": "h"}, False),
    'a -1e3 source="x y" t="q\\"u\\\\o"': ("a", -1000.0, None, "x y", {"t": 'q"u\\o'}, False),
    "a 1 source=s label.x/y=1": ("a", 1.0, None, "s", {"label.x/y": "1"}, False),
}
ERRORS = {
    "a 1": "too_few_fields",
    "foo@bar 1 source=x": "bad_name",
    'a 1 source="x': "bad_name",
    "a NaN source=x": "invalid_value",
    "a 1e999 source=x": "invalid_value",
    "a one source=x": "invalid_value",
    "a 1 k=v": "missing_source",
    "a 1 source=x k==v": "invalid_tag",
    "a 1 source=x k=": "invalid_tag",
    "a 1 123 source=x": "invalid_tag",
    "!D #3 1 2.0 1 3.5 n source=s": "bad_histogram",
    "!M 1600000000 #2 1.5 #1 2": "bad_histogram",
    "op source=s k=v abc": "bad_span",
}
HISTOGRAMS = {
    "!M #3 1 2.0 2 3.5": (None, None, 3, [(1, 2.0), (2, 3.5)]),
    "!H 1600000000 #2 1.5 #1 2 name source=s x=y": ("name", 1600000000, 3, [(2, 1.5), (1, 2.0)]),
    "!D 1600000000 #3 1 2.0 2 3.5\nname source=s": ("name", 1600000000, 3, [(1, 2.0), (2, 3.5)]),
}
SPANS = {
    "op source=s 1533531013000 343500.7": ("op", "s", {}, 1533531013000, 343500),
    'op source=s k="a b" 1533531013000 3435': ("op", "s", {"k": "a b"}, 1533531013000, 3435),
}


def parsed(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return {lines[r.i]: r for r in parse_lines(df).collect()}


def test_metric_lines(spark):
    out = parsed(spark, list(METRIC))
    for line, want in METRIC.items():
        r = out[line]
        assert r.record_type == "metric", (line, r.drop_reason)
        assert (r.metric, r.value, r.ts, r.source, r.tags, r.is_delta) == want, line


def test_errors_keep_their_reason(spark):
    out = parsed(spark, list(ERRORS))
    assert {x: r.drop_reason for x, r in out.items()} == ERRORS
    assert all(r.record_type == "error" and r.error_text == x[:100] for x, r in out.items())


def test_histograms_and_spans(spark):
    out = parsed(spark, [*HISTOGRAMS, *SPANS])
    for line, (metric, ts, n, cents) in HISTOGRAMS.items():
        r = out[line]
        assert (r.record_type, r.metric, r.ts, r.hist_count) == ("histogram", metric, ts, n), (line, r.drop_reason)
        assert [(x["count"], x["value"]) for x in r.centroids] == cents
        assert r.granularity == line[1]
    for line, want in SPANS.items():
        r = out[line]
        assert (r.operation, r.source, r.tags, r.start_ms, r.duration_ms) == want


def test_blank_and_comment_lines_are_skipped(spark):
    assert set(parsed(spark, ["# note", "   ", "", "a 1 source=x"])) == {"a 1 source=x"}


def test_long_token(spark):
    line = "a 1 source=s z=" + "x" * 200_000
    assert parsed(spark, [line])[line].line_length == len(line)


def test_filters_on_parsed_columns(spark):
    df = spark.createDataFrame([(x,) for x in [*METRIC, *ERRORS]], "value string")
    kept = parse_lines(df).filter((F.col("record_type") == "metric") & (F.size("tags") > 0))
    assert kept.select(F.explode("tags")).count() == sum(len(v[4]) for v in METRIC.values())


def test_round_trip_with_quoting(spark):
    rows = [
        ("plain", 1.25, 1600000000, "s", {"k": "v"}, False),
        ('na"me\\ x', -2.5, 1600000001, 'so "u" rce', {"a": "x=y", "b": "back\\ slash", "c": 'q"q'}, True),
        ("ünï", 0.1, None, "s\\s", {}, False),
    ]
    df = spark.createDataFrame(rows, "metric string, value double, ts bigint, source string, tags map<string,string>, is_delta boolean")
    c = F.col
    text = formats.fmt_metric_line(c("metric"), c("value").cast("string"), c("ts"), c("source"), c("tags"), c("is_delta"))
    back = parse_lines(df.select(text.alias("value"))).collect()
    got = {(r.metric, r.value, r.ts, r.source, tuple(sorted(r.tags.items())), r.is_delta) for r in back}
    assert got == {(m, v, ts, s, tuple(sorted(t.items())), d) for m, v, ts, s, t, d in rows}


def test_two_line_histograms_pair_across_blocks(spark):
    lines = ["a 1 source=s", "!M 1600000000 #3 1 2.0 2 3.5", "h source=s k=v", "b 2 source=s", "!H #1 1 9", "c 3 source=s"]
    rows = [("f", i // 2, i, x) for i, x in enumerate(lines)]
    df = spark.createDataFrame(rows, "file_path string, block_start bigint, line_no bigint, value string")
    out = parse_lines(pair_two_line_histograms(df).select("value")).collect()
    kinds = sorted((r.record_type, r.metric or "") for r in out)
    assert kinds == [("histogram", ""), ("histogram", "h"), ("metric", "a"), ("metric", "b"), ("metric", "c")]


def test_fmt_value_rounds_like_exact_binary(spark):
    values = [2.25, 0.15, 12.35, 999.95, 0.0005, 0.0004995, 0.1235, -3.25, 1234.5, 1235.5, float("nan"), float("inf"), 0.0]

    def want(v):
        if v != v or v in (float("inf"), float("-inf")):
            return "0"
        a = abs(v)
        return f"{v:.6f}" if a < 0.001 else f"{v:.3f}" if a < 1 else f"{v:.1f}" if a < 1000 else f"{v:.0f}"

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(formats.fmt_value(F.col("v"))).collect()]
    assert got == [want(v) for v in values]


def test_fmt_value_keeps_the_sign_of_minus_zero(spark):
    values = [-0.0, 0.0, 0.0 * -1e-6, -1e-9, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(formats.fmt_value(F.col("v"))).collect()] == [f"{v:.6f}" for v in values]


def test_sql_functions(spark):
    assert set(sqlnames.register(spark)) >= {"family_id", "series_id"}
    df = spark.createDataFrame([("a 1 source=s z=1 b=2",)], "value string")
    sqlnames.parsed_view(df, "parsed_lines")
    row = spark.sql("SELECT family_id, family_id(metric, tags) AS again, minute_of_day(86460) AS m FROM parsed_lines").first()
    assert row.family_id == row.again and row.m == 1
