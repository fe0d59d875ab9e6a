"""Queries: filters, projections and grouped aggregations."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.draws import uniform
from metricloom.functions.keys import span_family_id
from metricloom.functions.lines import parse_lines
from metricloom.operators import counts as C
from metricloom.operators import dims as D
from metricloom.operators import quality, temporal
from metricloom.operators.divergence import shares
from metricloom.operators.synth import match_globs
from metricloom.plans.catalog import query, u
from metricloom.session import work_dir
from metricloom.sources import recipes
from metricloom.sources import tables as t

c = F.col
FAM = ["family_id"]


@query(
    "flagship_family_profile",
    """SELECT family_id, metric, count(*) AS samples, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.05), 6) AS p05,
         round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
       FROM points GROUP BY ALL""",
)
def _(spark, d):
    """Lines to families: samples and value quantiles per family."""
    parsed = parse_lines(t.metric_lines(spark, d)).filter(c("record_type") == "metric")
    values = parsed.groupBy("family_id", "metric", "value").agg(F.count("*").alias("n"))
    return C.exact_quantiles(values, ["family_id", "metric"], "value", total="samples")


# --- projections and filters ------------------------------------------------------------------


@query(
    "split_by_type",
    """SELECT 'metric' AS record_type, family_id, count(*) AS n FROM (SELECT family_id FROM points UNION ALL SELECT family_id FROM sales) GROUP BY ALL
       UNION ALL SELECT 'histogram', family_id, count(*) FROM hists GROUP BY ALL
       UNION ALL SELECT 'span', family_id, count(*) FROM spans GROUP BY ALL""",
)
def _(spark, d):
    parsed = parse_lines(t.mixed_lines(spark, d))
    return parsed.filter(c("record_type").isin("metric", "histogram", "span")).groupBy("record_type", "family_id").agg(F.count("*").alias("n"))


@query("project_tag", "SELECT row_id, k, env FROM points")
def _(spark, d):
    return t.points(spark, d).select(
        "row_id", F.try_element_at("tags", F.lit("k")).alias("k"), F.try_element_at("tags", F.lit("env")).alias("env")
    )


@query("explode_tags", "SELECT row_id, key, value FROM ptags")
def _(spark, d):
    return D.explode_tags(t.points(spark, d), "row_id")


@query("filter_has_ts", "SELECT row_id, ts FROM points WHERE row_id % 3 <> 0")
def _(spark, d):
    p = t.points(spark, d).withColumn("ts", F.when(c("row_id") % 3 != 0, c("ts")))
    return p.filter(c("ts").isNotNull()).select("row_id", "ts")


@query("filter_delta", "SELECT family_id, count(*) AS n FROM points WHERE is_delta GROUP BY family_id")
def _(spark, d):
    return t.points(spark, d).filter("is_delta").groupBy("family_id").agg(F.count("*").alias("n"))


@query(
    "filter_family",
    "SELECT row_id, value FROM points WHERE family_id = sha1('app.click|env,k')",
)
def _(spark, d):
    """From rows stored by family: the scan reads the folder of the family's prefix only."""
    path = work_dir(spark, "by-family")
    recipes.sink_by_family(t.points(spark, d).select("row_id", "value", "ts", "source", "family_id"), path)
    stored = spark.read.schema("row_id bigint, value double, family_id string, prefix string").parquet(path)
    return recipes.filter_family(stored, hashlib.sha1(b"app.click|env,k").hexdigest()).select("row_id", "value")


@query("filter_min_samples", "SELECT family_id, n FROM famcounts WHERE n >= 10")
def _(spark, d):
    return t.points(spark, d).groupBy("family_id").agg(F.count("*").alias("n")).filter(c("n") >= 10)


@query(
    "filter_scenario_families",
    """SELECT DISTINCT family_id, pattern FROM famcounts JOIN
         (SELECT DISTINCT 'app.' || substr(event_type, 1, 1) || '*' AS pattern FROM events UNION SELECT DISTINCT 'app.' || event_type FROM events UNION SELECT '*.click') g
         ON regexp_full_match(metric, replace(replace(pattern, '.', '\\.'), '*', '.*'))""",
)
def _(spark, d):
    e = t.table(spark, d, "events")
    globs = e.select(
        F.explode(
            F.array(F.concat(F.lit("app."), F.substring("event_type", 1, 1), F.lit("*")), F.concat(F.lit("app."), "event_type"), F.lit("*.click"))
        ).alias("pattern")
    ).distinct()
    families = t.points(spark, d).select("family_id", "metric").distinct()
    return match_globs(families, "metric", globs, "pattern").select("family_id", "pattern").distinct()


@query(
    "filter_known_noise",
    "SELECT metric, count(*) AS n FROM points WHERE metric NOT IN (SELECT DISTINCT 'app.' || event_type FROM events WHERE event_type LIKE 'e%') GROUP BY metric",
)
def _(spark, d):
    noise = t.table(spark, d, "events").filter(c("event_type").startswith("e")).select(F.concat(F.lit("app."), "event_type").alias("metric")).distinct()
    return t.points(spark, d).join(noise, "metric", "left_anti").groupBy("metric").agg(F.count("*").alias("n"))


@query("sample_rows", f"SELECT row_id FROM points WHERE {u('row_id', 'sample', 3)} < 0.1")
def _(spark, d):
    """Repeatable Bernoulli sample."""
    return t.points(spark, d).filter(uniform(3, c("row_id"), "sample") < 0.1).select("row_id")


# --- aggregations -----------------------------------------------------------------------------


@query("agg_family_counts", "SELECT family_id, metric, n FROM famcounts")
def _(spark, d):
    return t.points(spark, d).groupBy("family_id", "metric").agg(F.count("*").alias("n"))


@query(
    "agg_capture_window",
    "SELECT family_id, min(ts) AS t0, max(ts) AS t1, count(ts) AS n, round((max(ts) - min(ts)) / 3600.0, 6) AS duration_hours FROM points GROUP BY family_id",
)
def _(spark, d):
    return t.points(spark, d).groupBy("family_id").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("ts").alias("n"),
        ((F.max("ts") - F.min("ts")) / 3600.0).alias("duration_hours"),
    )


TYPE_SQL = """
    SELECT family_id, key, count(*) AS rows, count(DISTINCT value) AS cardinality,
      avg(CASE WHEN try_cast(value AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) AS numeric_share,
      avg(CASE WHEN regexp_full_match(lower(value), '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')
        OR regexp_full_match(value, '[A-Za-z0-9]{20,}') OR regexp_full_match(value, '[A-Za-z]+-[A-Za-z0-9-]+') THEN 1.0 ELSE 0 END) AS identifier_share
    FROM ptags GROUP BY ALL"""


def tag_schema(spark, d) -> DataFrame:
    p = t.points(spark, d)
    families = p.groupBy("family_id").agg(F.count("*").alias("samples"))
    return D.tag_schema(D.dim_counts(p, FAM), families, FAM)


@query(
    "agg_tag_schema",
    """SELECT family_id, key, rows, cardinality, round(rows / n, 6) AS presence FROM
         (SELECT family_id, key, count(*) AS rows, count(DISTINCT value) AS cardinality FROM ptags GROUP BY ALL)
         JOIN famcounts USING (family_id)""",
)
def _(spark, d):
    return tag_schema(spark, d).select("family_id", "key", "rows", "cardinality", "presence")


@query(
    "agg_tag_type",
    f"""SELECT family_id, key, round(numeric_share, 6) AS numeric_share, round(identifier_share, 6) AS identifier_share,
         CASE WHEN numeric_share > 0.8 THEN 'numeric' WHEN identifier_share > 0.5 THEN 'identifier'
           WHEN cardinality / rows > 0.8 THEN 'text' ELSE 'categorical' END AS type FROM ({TYPE_SQL})""",
)
def _(spark, d):
    return tag_schema(spark, d).select("family_id", "key", "numeric_share", "identifier_share", "type")


@query(
    "agg_schema_flags",
    """SELECT family_id, bool_or(is_delta) AS is_delta, family_id IN (SELECT family_id FROM hists) AS has_histogram
       FROM (SELECT family_id, is_delta FROM points UNION ALL SELECT sha1('sales.quantity|'), false FROM lineitem) GROUP BY family_id""",
)
def _(spark, d):
    """Quantity points share their family with the quantity histograms."""
    p = t.points(spark, d).select("family_id", "is_delta")
    q = t.table(spark, d, "lineitem").select(F.sha1(F.lit("sales.quantity|")).alias("family_id"), F.lit(False).alias("is_delta"))
    flags = p.unionByName(q).groupBy("family_id").agg(F.bool_or("is_delta").alias("is_delta"))
    with_hist = t.histograms(spark, d).select("family_id").distinct().withColumn("_h", F.lit(True))
    return flags.join(with_hist, "family_id", "left").select("family_id", "is_delta", F.coalesce("_h", F.lit(False)).alias("has_histogram"))


@query("agg_distinct_sources", "SELECT family_id, count(DISTINCT source) AS sources FROM points GROUP BY family_id")
def _(spark, d):
    return C.value_counts(t.points(spark, d), FAM, "source").groupBy("family_id").agg(F.count("*").alias("sources"))


@query(
    "agg_rate_per_source",
    """SELECT family_id, round(quantile_cont(n, 0.01), 6) AS p01, round(quantile_cont(n, 0.05), 6) AS p05, round(quantile_cont(n, 0.5), 6) AS p50,
         round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99
       FROM (SELECT family_id, source, CAST(count(*) AS DOUBLE) AS n FROM points GROUP BY ALL) GROUP BY family_id""",
)
def _(spark, d):
    per_source = C.value_counts(t.points(spark, d), FAM, "source").withColumnRenamed("n", "rate")
    return C.exact_quantiles(C.value_counts(per_source, FAM, "rate"), FAM, "rate")


@query("agg_minute_counts", "SELECT family_id, minute, n FROM minutes")
def _(spark, d):
    return temporal.minute_counts(t.points(spark, d), FAM)


DELTA_SQL = "SELECT series_id, ts // 60 * 60 AS minute, round(sum(value), 6) AS delta_sum, count(*) AS n FROM points WHERE is_delta GROUP BY ALL"


@query("agg_delta_minute_bin", DELTA_SQL)
def _(spark, d):
    p = t.with_series(t.points(spark, d).filter("is_delta"))
    return p.groupBy("series_id", (F.floor(c("ts") / 60) * 60).alias("minute")).agg(
        F.sum("value").alias("delta_sum"), F.count("*").alias("n")
    )


@query(
    "agg_histogram_granularity",
    """SELECT family_id, granularity, n, round(n / sum(n) OVER (PARTITION BY family_id), 6) AS share FROM
         (SELECT family_id, CASE WHEN ts // 86400 % 5 = 0 THEN 'H' WHEN ts // 86400 % 5 = 1 THEN 'M' ELSE 'D' END AS granularity, count(*) AS n FROM hists GROUP BY ALL)""",
)
def _(spark, d):
    """Granularity letters vary by day so that all three occur."""
    day = F.pmod(F.floor(c("ts") / 86400), F.lit(5))
    h = t.histograms(spark, d).withColumn("granularity", F.when(day == 0, "H").when(day == 1, "M").otherwise("D"))
    return shares(C.value_counts(h, FAM, "granularity"), FAM).select("family_id", "granularity", "n", c("p").alias("share"))


@query(
    "agg_histogram_merge",
    """SELECT source, period, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95
       FROM (SELECT 'flag-' || l_returnflag AS source, (CAST(epoch(l_shipdate) AS BIGINT) // 86400 * 86400 + 946684800) // 2592000 AS period, l_quantity AS v FROM lineitem)
       GROUP BY ALL""",
)
def _(spark, d):
    """Daily histograms merged into 30-day periods; quantiles come from the centroid counts."""
    keys = ["source", "period"]
    merged = (
        t.histograms(spark, d)
        .select("source", F.floor(c("ts") / 2592000).alias("period"), F.inline("centroids"))
        .groupBy(*keys, "value")
        .agg(F.sum("count").alias("n"))
    )
    totals = merged.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(c("value") * c("n")) / F.sum("n")).alias("mean")
    )
    return totals.join(C.exact_quantiles(merged, keys, "value", {"p50": 0.5, "p95": 0.95}), keys)


@query(
    "agg_span_stats",
    """SELECT family_id, operation, count(*) AS n, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.99), 6) AS p99,
         round(avg(duration_ms), 6) AS mean, round(stddev_samp(duration_ms), 6) AS stddev FROM (SELECT * REPLACE (CAST(duration_ms AS DOUBLE) AS duration_ms) FROM spans) GROUP BY ALL""",
)
def _(spark, d):
    keys = ["family_id", "operation"]
    s = t.spans(spark, d).withColumn("family_id", span_family_id(c("operation")))
    counts = C.value_counts(s, keys, "duration_ms")
    return C.moments(counts, keys, "duration_ms").join(
        C.exact_quantiles(counts, keys, "duration_ms", {"p50": 0.5, "p99": 0.99}), keys
    ).select(*keys, "n", "p50", "p99", "mean", "stddev")


@query(
    "agg_error_rate",
    "SELECT coalesce(drop_reason, 'ok') AS reason, count(*) AS lines, round(count(*) * 1.0 / (SELECT count(*) FROM badparsed), 6) AS share FROM badparsed GROUP BY 1",
)
def _(spark, d):
    return quality.error_rates(parse_lines(t.bad_lines(spark, d)))


@query(
    "agg_family_coverage",
    "SELECT count(*) AS total_families, round(avg(n), 6) AS avg_samples_per_family, min(n) AS min_samples, max(n) AS max_samples FROM famcounts",
)
def _(spark, d):
    return quality.family_coverage(t.points(spark, d))


@query(
    "agg_data_quality",
    """SELECT round(avg(CASE WHEN drop_reason IS NULL THEN 1.0 ELSE 0 END), 6) AS score, count(drop_reason) AS parse_errors,
         count(*) FILTER (drop_reason IS NULL AND NOT regexp_full_match(coalesce(tok[3], ''), '\\d{10}')) AS missing_timestamps,
         count(*) FILTER (drop_reason = 'missing_source') AS missing_sources FROM badparsed""",
)
def _(spark, d):
    return quality.qa_report(parse_lines(t.bad_lines(spark, d))).select(
        "score", "parse_errors", "missing_timestamps", "missing_sources"
    )


@query(
    "agg_processing_summary",
    """SELECT (SELECT count(*) FROM alllines) AS total_lines, (SELECT count(*) FROM points) + (SELECT count(*) FROM sales) AS total_metrics,
         (SELECT count(*) FROM hists) AS total_histograms, (SELECT count(*) FROM spans) AS total_spans, 0::BIGINT AS parse_errors""",
)
def _(spark, d):
    return quality.qa_report(parse_lines(t.mixed_lines(spark, d))).select(
        "total_lines", "total_metrics", "total_histograms", "total_spans", "parse_errors"
    )


@query("agg_bytes_by_family", "SELECT family_id, count(*) AS lines, CAST(sum(line_length) AS BIGINT) AS bytes FROM points GROUP BY family_id")
def _(spark, d):
    return t.points(spark, d).groupBy("family_id").agg(F.count("*").alias("lines"), F.sum("line_length").alias("bytes"))


@query(
    "agg_recipe_coverage",
    """SELECT count(*) AS families, count(r.family_id) AS with_recipe, round(count(r.family_id) / count(*), 6) AS coverage
       FROM famcounts f LEFT JOIN (SELECT DISTINCT family_id FROM refs WHERE env IS NOT NULL OR is_delta) r USING (family_id)""",
)
def _(spark, d):
    """Recipes exist for the reference period's delta families and those with an env tag."""
    ref, _cur = t.reference_and_current(spark, d)
    have = ref.filter(F.map_contains_key("tags", "env") | c("is_delta")).select("family_id").distinct().withColumn("_r", F.lit(1))
    families = t.points(spark, d).select("family_id").distinct()
    return families.join(have, "family_id", "left").agg(
        F.count("*").alias("families"), F.count("_r").alias("with_recipe"), (F.count("_r") / F.count("*")).alias("coverage")
    )
