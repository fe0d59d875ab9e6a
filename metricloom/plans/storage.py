"""Queries: scans and sinks. Each writes what the tables hold to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.keys import span_family_id
from metricloom.functions.lines import parse_lines
from metricloom.operators import quality
from metricloom.plans.catalog import query
from metricloom.sources import captures, recipes
from metricloom.sources import tables as t
from metricloom.session import work_dir

c = F.col

# capture placement: day of the point, two groups, one instance per source ending
PLACED_SQL = """
    SELECT strftime(to_timestamp(ts), '%Y-%m-%d') AS dt, CASE WHEN row_id % 2 = 0 THEN 'tier-a' ELSE 'tier-b' END AS mig,
      'agent-' || (row_id % 3) AS instance, line FROM points"""


def placed_lines(spark, d) -> DataFrame:
    p = t.points(spark, d)
    return p.select(
        t.metric_text().alias("value"),
        F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("dt"),
        F.when(c("row_id") % 2 == 0, "tier-a").otherwise("tier-b").alias("mig"),
        F.concat(F.lit("agent-"), (c("row_id") % 3).cast("string")).alias("instance"),
    )


def landed(spark, d) -> str:
    path = work_dir(spark, "capture")
    captures.sink_capture(placed_lines(spark, d), path)
    return path


@query("scan_capture_lines", "SELECT line AS value, count(*) AS n FROM points GROUP BY line")
def _(spark, d):
    return captures.scan_lines(spark, landed(spark, d)).groupBy("value").agg(F.count("*").alias("n"))


@query("scan_capture_layout", f"SELECT dt, mig, instance, count(*) AS n FROM ({PLACED_SQL}) GROUP BY ALL")
def _(spark, d):
    return (
        captures.scan_layout(spark, landed(spark, d))
        .groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt"), "mig", "instance")
        .agg(F.count("*").alias("n"))
    )


def manifest(spark, d) -> DataFrame:
    path = work_dir(spark, "manifest")
    captures.append_manifest(captures.file_manifest(spark, landed(spark, d)), path)
    return captures.scan_manifest(spark, path)


MANIFEST_SQL = f"""
    SELECT dt, mig AS zone, instance AS instance_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS original_size
    FROM ({PLACED_SQL}) GROUP BY ALL"""


def manifest_sizes(m: DataFrame) -> DataFrame:
    return m.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt"), "zone", "instance_id").agg(
        F.sum("original_size").alias("original_size")
    )


@query("scan_manifest", MANIFEST_SQL)
def _(spark, d):
    return manifest_sizes(manifest(spark, d))


@query("sink_manifest")
def _(spark, d):
    return manifest(spark, d).select(
        F.regexp_extract("object_name", "[^/]+$", 0).alias("file"), "instance_id", "original_size",
        "compressed_size", "compression_ratio", F.hex("crc32").alias("crc32"), "sha256",
    )


@query(
    "agg_capture_volume",
    f"""SELECT dt, instance AS instance_id, CAST(sum(strlen(line) + 1) AS BIGINT) AS original_bytes, true AS has_ratio, true AS has_rate
        FROM ({PLACED_SQL}) GROUP BY ALL""",
)
def _(spark, d):
    """Ratio and rate depend on the compressor and the clock; that they are known is compared."""
    return captures.volume(manifest(spark, d)).select(
        F.date_format("dt", "yyyy-MM-dd").alias("dt"), "instance_id", "original_bytes",
        (c("compression_ratio") > 0).alias("has_ratio"), (c("bytes_per_second") > 0).alias("has_rate"),
    )


@query("sink_capture_partitioned", f"SELECT dt, mig, instance, count(*) AS n FROM ({PLACED_SQL}) GROUP BY ALL")
def _(spark, d):
    """Parquet landing of raw lines, the batch form of the streaming one."""
    path = work_dir(spark, "raw")
    captures.by_place(placed_lines(spark, d)).write.option("compression", "zstd").option(
        "maxRecordsPerFile", captures.LINES_PER_FILE
    ).partitionBy(*captures.PLACE).parquet(path)
    back = spark.read.schema("value string, dt string, mig string, instance string").parquet(path)
    return back.groupBy("dt", "mig", "instance").agg(F.count("*").alias("n"))


@query(
    "scan_point_strings",
    """SELECT row_id, metric AS name, value AS point_value, ts * 1000 AS timestamp,
         'host=' || source || coalesce(',env=' || env, '') || ',k=' || k AS tags FROM points""",
)
def _(spark, d):
    p = t.points(spark, d)
    text = F.concat_ws(" ", "metric", c("value").cast("string"), (c("ts") * 1000).cast("string"), F.concat(F.lit("host="), "source"), F.array_join(F.transform(F.sort_array(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " "))
    path = work_dir(spark, "points")
    captures.sink_lines_text(p.select(F.concat_ws("\t", c("row_id").cast("string"), text).alias("value")), path)
    raw = spark.read.text(path)
    rows = raw.select(
        F.substring_index("value", "\t", 1).cast("bigint").alias("row_id"), F.substring_index("value", "\t", -1).alias("value")
    )
    return captures.parse_point_strings(rows).select(
        "row_id", "name", "point_value", "timestamp", F.array_join("tag_list", ",").alias("tags")
    )


@query("sink_lines_text", "SELECT count(*) AS lines, count(DISTINCT line) AS texts, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM points")
def _(spark, d):
    path = work_dir(spark, "text")
    captures.sink_lines_text(t.metric_lines(spark, d), path)
    back = spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))
    return back.agg(
        F.sum("n").alias("lines"), F.count("*").alias("texts"),
        F.sum(c("n") * F.octet_length("value")).alias("bytes"),
    )


@query(
    "sink_parsed_by_type",
    "SELECT kind AS record_type, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM alllines GROUP BY kind",
)
def _(spark, d):
    path = work_dir(spark, "parsed")
    recipes.sink_parsed_by_type(parse_lines(t.mixed_lines(spark, d)), path)
    return spark.read.parquet(path).groupBy("record_type").agg(
        F.count("*").alias("n"), F.sum("line_length").alias("bytes")
    )


@query(
    "sink_by_family",
    "SELECT substr(family_id, 1, 2) AS prefix, family_id, count(*) AS n FROM (SELECT family_id FROM points UNION ALL SELECT family_id FROM spans) GROUP BY ALL",
)
def _(spark, d):
    path = work_dir(spark, "by-family")
    rows = t.points(spark, d).select("family_id", "ts", "source")
    spans = t.spans(spark, d).select(span_family_id(c("operation")).alias("family_id"), F.floor(c("start_ms") / 1000).alias("ts"), "source")
    recipes.sink_by_family(rows.unionByName(spans), path)
    return spark.read.schema("family_id string, ts bigint, source string, prefix string").parquet(path).groupBy("prefix", "family_id").agg(F.count("*").alias("n"))


@query(
    "sink_qa_report",
    """SELECT (SELECT count(*) FROM alllines) AS total_lines, (SELECT count(*) FROM points) + (SELECT count(*) FROM sales) AS total_metrics,
         (SELECT count(*) FROM hists) AS total_histograms, (SELECT count(*) FROM spans) AS total_spans,
         0::BIGINT AS parse_errors, 0::BIGINT AS missing_timestamps, 0::BIGINT AS missing_sources, 1.0::DOUBLE AS score,
         count(*) AS total_families, round(avg(n), 6) AS avg_samples_per_family, min(n) AS min_samples, max(n) AS max_samples
       FROM (SELECT family_id, count(*) AS n FROM (SELECT family_id FROM points UNION ALL SELECT family_id FROM sales) GROUP BY family_id)""",
)
def _(spark, d):
    path = work_dir(spark, "qa")
    report = quality.qa_report(parse_lines(t.mixed_lines(spark, d)))
    recipes.sink_report(report, path)
    return spark.read.schema(report.schema).json(path)
