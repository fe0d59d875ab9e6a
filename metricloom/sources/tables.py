"""Telemetry views over business tables: the inputs every registered query starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions import formats
from metricloom.functions.draws import integer, uniform
from metricloom.functions.keys import family_id, series_id
from metricloom.schemas import TAGS
from metricloom.session import prepare

# Orders and shipments predate 2001-09-09, so their epoch seconds have nine digits; thirty years
# are added to satisfy the ten-digit rule of the line format.
EPOCH_SHIFT = 946684800
SPLIT_DATE = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp")).cast("bigint")


def points_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    env = F.when(F.col("event_id") % 6 == 0, "prod").when(F.col("event_id") % 6 == 2, "staging").when(
        F.col("event_id") % 6 == 4, "dev"
    )
    return events.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("app."), "event_type").alias("metric"),
        "value",
        epoch(F.col("ts")).alias("ts"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        F.when(env.isNull(), F.create_map(F.lit("k"), k))
        .otherwise(F.create_map(F.lit("k"), k, F.lit("env"), env))
        .cast(TAGS)
        .alias("tags"),
        (F.col("event_type") == "click").alias("is_delta"),
    )


def with_keys(points: DataFrame) -> DataFrame:
    return points.withColumn("family_id", family_id(F.col("metric"), F.col("tags")))


def with_line_length(points: DataFrame) -> DataFrame:
    return points.withColumn("line_length", F.octet_length(metric_text()).cast("bigint"))


def metric_text() -> Column:
    """Line text of a point row; the value keeps all its digits so that parsing restores it."""
    c = F.col
    return formats.fmt_metric_line(
        c("metric"), c("value").cast("string"), c("ts"), c("source"), c("tags"), c("is_delta")
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with family and line length."""
    return with_line_length(with_keys(points_from_events(table(spark, sf_dir, "events"))))


def with_series(df: DataFrame) -> DataFrame:
    return df.withColumn("series_id", series_id(F.col("metric"), F.col("source"), F.col("tags")))


def sales_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return with_keys(
        li.select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_id"),
            F.lit("sales.price").alias("metric"),
            F.col("l_extendedprice").alias("value"),
            (epoch(F.col("l_shipdate")) + EPOCH_SHIFT).alias("ts"),
            F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("source"),
            F.create_map(
                F.lit("returnflag"), F.col("l_returnflag"), F.lit("linestatus"), F.col("l_linestatus")
            ).alias("tags"),
            F.lit(False).alias("is_delta"),
        )
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("row_id"),
        F.concat(F.lit("order."), "o_orderstatus").alias("operation"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("source"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("tags"),
        (epoch(F.col("o_orderdate")) * 1000).alias("start_ms"),
        F.floor("o_totalprice").cast("bigint").alias("duration_ms"),
    )


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity histograms per return flag.

    Rows are first counted per (flag, day, quantity); only those counts reach the list, so its
    length is bounded by the number of distinct quantities.
    """
    li = table(spark, sf_dir, "lineitem")
    day = F.floor(epoch(F.col("l_shipdate")) / 86400) * 86400 + EPOCH_SHIFT
    counted = li.groupBy(
        F.col("l_returnflag").alias("flag"), day.cast("bigint").alias("ts"), F.col("l_quantity").alias("q")
    ).agg(F.count("*").alias("n"))
    return counted.groupBy("flag", "ts").agg(
        F.sum("n").alias("hist_count"),
        F.sort_array(F.collect_list(F.struct(F.col("q"), F.col("n")))).alias("pairs"),
    ).select(
        F.lit("sales.quantity").alias("metric"),
        F.concat(F.lit("flag-"), "flag").alias("source"),
        F.create_map().cast(TAGS).alias("tags"),
        F.lit("D").alias("granularity"),
        "ts",
        "hist_count",
        F.transform("pairs", lambda p: F.struct(p["n"].alias("count"), p["q"].alias("value"))).alias("centroids"),
    ).withColumn("family_id", family_id(F.col("metric"), F.col("tags")))


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_from_events(table(spark, sf_dir, "events"))
    return p.select("row_id", metric_text().alias("value"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_points(spark, sf_dir).select("row_id", metric_text().alias("value"))


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = formats.fmt_span_line(c("operation"), c("source"), c("tags"), c("start_ms"), c("duration_ms"))
    return spans(spark, sf_dir).select("row_id", text.alias("value"))


def histogram_lines(spark: SparkSession, sf_dir: str, grammar: str = "inline") -> DataFrame:
    """One line per histogram. ``counted`` has no owner; ``joined`` carries it after a newline."""
    c = F.col
    h = histograms(spark, sf_dir)
    text = {
        "inline": formats.fmt_histogram_inline(
            c("granularity"), c("ts"), c("centroids"), c("metric"), c("source"), c("tags")
        ),
        "counted": formats.fmt_histogram_header(c("granularity"), c("ts"), c("hist_count"), c("centroids")),
        "joined": formats.fmt_histogram_two_line(
            c("granularity"), c("ts"), c("hist_count"), c("centroids"), c("metric"), c("source"), c("tags")
        ),
    }[grammar]
    return h.select("source", "ts", text.alias("value"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric, span and histogram lines together, plus a comment and a blank per hundred events."""
    metric = metric_lines(spark, sf_dir).select("value")
    noise = table(spark, sf_dir, "events").filter(F.col("event_id") % 100 == 0).select(
        F.explode(F.array(F.concat(F.lit("# event "), F.col("event_id").cast("string")), F.lit("  "))).alias("value")
    )
    return (
        metric.unionByName(sales_lines(spark, sf_dir).select("value"))
        .unionByName(span_lines(spark, sf_dir).select("value"))
        .unionByName(histogram_lines(spark, sf_dir).select("value"))
        .unionByName(noise)
    )


ERROR_MODES = ["bad_name", "no_source", "nan", "truncated", "double_equals"]


def corrupt(line: Column, metric: Column, mode: Column) -> Column:
    """Damage a line in one of five ways (0..4); any other mode leaves it alone."""
    return (
        F.when(mode == 0, F.replace(line, metric, F.lit("invalid metric name")))
        .when(mode == 1, F.regexp_replace(line, r"source=\S+", ""))
        .when(mode == 2, F.regexp_replace(line, r"\s-?\d+\.?\d*\s", " NaN "))
        .when((mode == 3) & (F.length(line) > 10), F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int")))
        .when(mode == 4, F.regexp_replace(line, "^([^=]*)=", "$1=="))
        .otherwise(line)
    )


def error_mode(seed, row: Column, rate: float | Column) -> Column:
    """Null where the row stays clean, else 0..4."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.when(uniform(seed, row, "error") < rate, integer(uniform(seed, row, "mode"), len(ERROR_MODES)))


def bad_lines(spark: SparkSession, sf_dir: str, rate: float = 0.5, seed: int = 7) -> DataFrame:
    p = points_from_events(table(spark, sf_dir, "events"))
    mode = error_mode(seed, F.col("row_id"), rate)
    return p.select(
        "row_id", "metric", metric_text().alias("clean"), mode.alias("mode")
    ).select("row_id", "mode", F.coalesce(corrupt(F.col("clean"), F.col("metric"), F.col("mode")), "clean").alias("value"))


def split_epoch() -> Column:
    """Epoch second that separates reference from current points."""
    return F.unix_timestamp(F.lit(f"{SPLIT_DATE} 00:00:00").cast("timestamp"))


def reference_and_current(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p.filter(F.col("ts") < split_epoch()), p.filter(F.col("ts") >= split_epoch())
