"""Queries: line parsing, keys and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions import formats, keys, lines
from metricloom.functions.lines import parse_lines
from metricloom.plans.catalog import query
from metricloom.session import work_dir
from metricloom.sources import captures
from metricloom.sources import tables as t

c = F.col


def tag(name: str):
    return F.try_element_at("tags", F.lit(name))


def parsed_points(spark, d) -> DataFrame:
    return parse_lines(t.metric_lines(spark, d))


@query("parse_skip_blank_comment", "SELECT line AS value FROM alllines")
def _(spark, d):
    return lines.skip_blank_and_comments(t.mixed_lines(spark, d))


@query("parse_classify", "SELECT kind AS record_type, count(*) AS n FROM alllines GROUP BY kind")
def _(spark, d):
    return parse_lines(t.mixed_lines(spark, d)).groupBy("record_type").agg(F.count("*").alias("n"))


@query(
    "parse_metric",
    "SELECT row_id, metric, value, ts, source, k, env, is_delta, family_id FROM points",
)
def _(spark, d):
    return parsed_points(spark, d).select(
        "row_id", "metric", "value", "ts", "source", tag("k").alias("k"), tag("env").alias("env"), "is_delta", "family_id"
    )


@query(
    "parse_metric_name",
    "SELECT metric, count(*) AS n FROM (SELECT metric FROM points UNION ALL SELECT 'sales.price' FROM lineitem) GROUP BY metric",
)
def _(spark, d):
    both = t.metric_lines(spark, d).select("value").unionByName(t.sales_lines(spark, d).select("value"))
    return parse_lines(both).groupBy("metric").agg(F.count("*").alias("n"))


@query("parse_delta", "SELECT is_delta, metric, count(*) AS n FROM points GROUP BY ALL")
def _(spark, d):
    return parsed_points(spark, d).groupBy("is_delta", "metric").agg(F.count("*").alias("n"))


@query(
    "parse_timestamp",
    "SELECT row_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE ts END AS ts FROM points",
)
def _(spark, d):
    """Every third line goes without its timestamp."""
    ls = t.metric_lines(spark, d).withColumn(
        "value", F.when(c("row_id") % 3 == 0, F.regexp_replace("value", r" \d{10} source", " source")).otherwise(c("value"))
    )
    return parse_lines(ls).select("row_id", "ts")


@query("parse_source", "SELECT source, count(*) AS n FROM points GROUP BY source")
def _(spark, d):
    """Odd rows name their source ``host``."""
    ls = t.metric_lines(spark, d).withColumn(
        "value", F.when(c("row_id") % 2 == 1, F.replace("value", F.lit(" source="), F.lit(" host="))).otherwise(c("value"))
    )
    return parse_lines(ls).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "parse_tags",
    """SELECT key, value, count(*) AS n FROM (
         SELECT key, value FROM ptags
         UNION ALL SELECT 'returnflag', returnflag FROM sales UNION ALL SELECT 'linestatus', linestatus FROM sales)
       GROUP BY ALL""",
)
def _(spark, d):
    both = t.metric_lines(spark, d).select("value").unionByName(t.sales_lines(spark, d).select("value"))
    return (
        parse_lines(both).select(F.explode("tags").alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
    )


HIST_SQL = """
    SELECT {source} AS source, ts, 'D' AS granularity, CAST(sum(n) AS BIGINT) AS hist_count,
      count(*) AS centroids, {metric} AS metric, round(sum(n * v), 6) AS mass
    FROM hcent GROUP BY hcent.source, ts"""


def histogram_columns(parsed: DataFrame) -> DataFrame:
    return parsed.filter(c("record_type") == "histogram").select(
        "source", "ts", "granularity", "hist_count", F.size("centroids").alias("centroids"), "metric",
        F.aggregate("centroids", F.lit(0.0), lambda a, x: a + x["count"] * x["value"]).alias("mass"),
    )


@query("parse_histogram_counted", HIST_SQL.format(source="CAST(NULL AS VARCHAR)", metric="CAST(NULL AS VARCHAR)"))
def _(spark, d):
    return histogram_columns(parse_lines(t.histogram_lines(spark, d, "counted").select("value")))


@query("parse_histogram_inline", HIST_SQL.format(source="hcent.source", metric="'sales.quantity'"))
def _(spark, d):
    return histogram_columns(parse_lines(t.histogram_lines(spark, d, "inline").select("value")))


@query("parse_histogram_two_line", HIST_SQL.format(source="hcent.source", metric="'sales.quantity'"))
def _(spark, d):
    """Header and owner as separate lines of capture files, paired while the files are read."""
    path = work_dir(spark, "two-line")
    captures.sink_lines_text(t.histogram_lines(spark, d, "joined"), path)
    return histogram_columns(parse_lines(captures.scan_paired_lines(spark, path, "part-*").select("value")))


@query(
    "parse_span",
    "SELECT row_id, operation, source, priority, start_ms, duration_ms, family_id FROM spans",
)
def _(spark, d):
    return parse_lines(t.span_lines(spark, d)).select(
        "row_id", "operation", "source", tag("priority").alias("priority"), "start_ms", "duration_ms", "family_id"
    )


@query(
    "parse_errors",
    "SELECT row_id, drop_reason, trim(value) AS error_text FROM badparsed WHERE drop_reason IS NOT NULL",
)
def _(spark, d):
    return parse_lines(t.bad_lines(spark, d)).filter(c("record_type") == "error").select("row_id", "drop_reason", "error_text")


@query(
    "parse_line_length",
    "SELECT row_id, line_length FROM points",
)
def _(spark, d):
    return parsed_points(spark, d).select("row_id", "line_length")


# --- keys -------------------------------------------------------------------------------------


@query("family_id", "SELECT DISTINCT metric, family_id FROM points")
def _(spark, d):
    return t.points(spark, d).select("metric", "family_id").distinct()


@query("span_family_id", "SELECT DISTINCT operation, family_id FROM spans")
def _(spark, d):
    return t.spans(spark, d).select("operation", keys.span_family_id(c("operation")).alias("family_id")).distinct()


@query("series_id", "SELECT series_id, count(*) AS n FROM points GROUP BY series_id")
def _(spark, d):
    return t.with_series(t.points(spark, d)).groupBy("series_id").agg(F.count("*").alias("n"))


@query("crc32_checksum")
def _(spark, d):
    return t.metric_lines(spark, d).select("row_id", F.crc32(F.encode("value", "UTF-8")).alias("crc32"))


@query(
    "fnv1a_hash",
    """SELECT source, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS BIGINT) AS hash FROM (
         SELECT source, list_reduce(list_prepend(CAST(2166136261 AS BIGINT),
             list_transform(range(length(hex(source)) // 2), lambda i: CAST(('0x' || substr(hex(source), 2 * i + 1, 2))::UBIGINT AS BIGINT))),
           lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h
         FROM (SELECT DISTINCT source FROM points))""",
)
def _(spark, d):
    return t.points(spark, d).select("source").distinct().select("source", keys.fnv1a(c("source")).alias("hash"))


ALPHA = keys.ALPHABET


@query(
    "deterministic_string",
    f"""SELECT source, array_to_string(list_transform(range(20), lambda i:
          substr('{ALPHA}', CAST(('0x' || substr(sha1('' || source), 2 * i + 1, 2))::UBIGINT % 62 + 1 AS BIGINT), 1)), '') AS text
        FROM (SELECT DISTINCT source FROM points)""",
)
def _(spark, d):
    return t.points(spark, d).select("source").distinct().select(
        "source", keys.deterministic_string(c("source"), 20).alias("text")
    )


@query(
    "levelled_suffix",
    f"""SELECT metric, metric || '.' || array_to_string(list_transform(range(8), lambda i:
          substr('{ALPHA}', CAST(('0x' || substr(sha1(metric), 2 * i + 1, 2))::UBIGINT % 62 + 1 AS BIGINT), 1)), '') AS short,
          60::BIGINT AS long_length, 4::BIGINT AS long_levels
        FROM (SELECT DISTINCT metric FROM points)""",
)
def _(spark, d):
    long = keys.levelled_suffix(c("metric"), 4, 60)
    return t.points(spark, d).select("metric").distinct().select(
        "metric",
        keys.levelled_suffix(c("metric")).alias("short"),
        F.length(long).alias("long_length"),
        (F.length(long) - F.length(F.replace(long, F.lit("."), F.lit(""))) + 1).alias("long_levels"),
    )


# --- text forms -------------------------------------------------------------------------------


@query("fmt_metric_line", "SELECT row_id, line FROM points")
def _(spark, d):
    return t.metric_lines(spark, d).select("row_id", c("value").alias("line"))


@query(
    "fmt_metric_line_rounded",
    """SELECT row_id, metric || ' ' || CAST(floor(value + 0.5) AS BIGINT) || ' ' || ts || ' host=' || source
         || coalesce(' env=' || env, '') || ' k=' || k AS line FROM points""",
)
def _(spark, d):
    line = formats.fmt_metric_line_rounded(c("metric"), c("value"), c("ts") * 1000 + 7, c("source"), c("tags"))
    return t.points(spark, d).select("row_id", line.alias("line"))


@query("fmt_histogram_inline", "SELECT source, ts, line FROM hists")
def _(spark, d):
    return t.histogram_lines(spark, d, "inline").select("source", "ts", c("value").alias("line"))


@query(
    "fmt_histogram_two_line",
    "SELECT source, ts, header || chr(10) || 'sales.quantity source=' || source AS line FROM hists",
)
def _(spark, d):
    return t.histogram_lines(spark, d, "joined").select("source", "ts", c("value").alias("line"))


@query("fmt_span_line", "SELECT row_id, line FROM spans")
def _(spark, d):
    return t.span_lines(spark, d).select("row_id", c("value").alias("line"))


@query(
    "fmt_opentsdb",
    """SELECT row_id, 'put ' || metric || ' ' || ts || ' ' || CAST(value AS VARCHAR) || ' host=' || source
         || coalesce(' env=' || env, '') || ' k=' || k AS line FROM points""",
)
def _(spark, d):
    line = formats.fmt_opentsdb(c("metric"), c("value"), c("ts"), c("source"), c("tags"))
    return t.points(spark, d).select("row_id", line.alias("line"))


@query(
    "fmt_value",
    """SELECT row_id, scale, CASE WHEN abs(v) < 0.001 THEN printf('%.6f', v) WHEN abs(v) < 1 THEN printf('%.3f', v)
         WHEN abs(v) < 1000 THEN printf('%.1f', v) ELSE printf('%.0f', v) END AS text
       FROM (SELECT row_id, scale, value * scale AS v FROM points, (VALUES (1.0::DOUBLE), (0.001::DOUBLE), (-0.000001::DOUBLE), (1000.0::DOUBLE)) s(scale))""",
)
def _(spark, d):
    scales = F.explode(F.array(*[F.lit(x) for x in (1.0, 0.001, -0.000001, 1000.0)]))
    return t.points(spark, d).select("row_id", "value", scales.alias("scale")).select(
        "row_id", "scale", formats.fmt_value(c("value") * c("scale")).alias("text")
    )


@query(
    "quote_name",
    r"""SELECT operation, CASE WHEN regexp_full_match(operation, '[a-zA-Z0-9._-]+') THEN operation
         ELSE '"' || replace(replace(operation, '\', '\\'), '"', '\"') || '"' END AS quoted
       FROM (SELECT DISTINCT 'op ' || o_orderpriority AS operation FROM orders
             UNION SELECT DISTINCT 'say "' || o_orderstatus || '\' FROM orders UNION SELECT DISTINCT operation FROM spans)""",
)
def _(spark, d):
    o = t.table(spark, d, "orders")
    names = F.explode(
        F.array(
            F.concat(F.lit("op "), "o_orderpriority"),
            F.concat(F.lit('say "'), "o_orderstatus", F.lit("\\")),
            F.concat(F.lit("order."), "o_orderstatus"),
        )
    )
    return o.select(names.alias("operation")).distinct().select("operation", formats.quote_name(c("operation")).alias("quoted"))


@query(
    "quote_tag",
    """SELECT priority, CASE WHEN priority LIKE '% %' OR priority LIKE '%=%' THEN '"' || priority || '"' ELSE priority END AS quoted
       FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders UNION SELECT DISTINCT 'p=' || o_orderpriority FROM orders)""",
)
def _(spark, d):
    o = t.table(spark, d, "orders")
    values = F.explode(F.array(c("o_orderpriority"), F.concat(F.lit("p="), "o_orderpriority")))
    return o.select(values.alias("priority")).distinct().select("priority", formats.quote_tag(c("priority")).alias("quoted"))


@query("unescape", "SELECT DISTINCT 'say \"' || source || '\\' AS restored, length('say \"' || source || '\\') AS size FROM points")
def _(spark, d):
    """Quoting followed by unescaping gives the text back."""
    text = F.concat(F.lit('say "'), "source", F.lit("\\"))
    restored = formats.unescape(formats.quote_name(c("text")))
    return t.points(spark, d).select(text.alias("text")).distinct().select(
        restored.alias("restored"), F.length("text").cast("bigint").alias("size")
    )
