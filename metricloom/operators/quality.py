"""Quality of a parsed capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def error_rates(parsed: DataFrame) -> DataFrame:
    """Lines and share of all lines per drop reason; ``ok`` for lines without one."""
    by_reason = parsed.groupBy(F.coalesce("drop_reason", F.lit("ok")).alias("reason")).agg(
        F.count("*").alias("lines")
    )
    # the window sees one row per reason, at most eight
    return by_reason.withColumn("share", F.col("lines") / F.sum("lines").over(W.partitionBy()))


def family_coverage(rows: DataFrame) -> DataFrame:
    """One row: number of families and their sample counts."""
    per_family = rows.filter(F.col("family_id").isNotNull()).groupBy("family_id").agg(F.count("*").alias("n"))
    return per_family.agg(
        F.count("*").alias("total_families"),
        F.avg("n").alias("avg_samples_per_family"),
        F.min("n").alias("min_samples"),
        F.max("n").alias("max_samples"),
    )


def qa_report(parsed: DataFrame) -> DataFrame:
    """One row: totals by type, valid ratio, missing timestamps and sources, family coverage.

    Lines are counted per (family, type) first; the totals are then sums over that small table.
    """
    per_family = parsed.groupBy("family_id", "record_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ts").isNull()).alias("no_ts"),
        F.count_if(F.col("drop_reason") == "missing_source").alias("no_source"),
    )
    kind, n = F.col("record_type"), F.col("n")

    def rows(name: str):
        return F.coalesce(F.sum(F.when(kind == name, n)), F.lit(0))

    metric = F.when(kind == "metric", n)
    return per_family.agg(
        F.sum(n).alias("total_lines"),
        rows("metric").alias("total_metrics"),
        rows("histogram").alias("total_histograms"),
        rows("span").alias("total_spans"),
        rows("error").alias("parse_errors"),
        F.coalesce(F.sum(F.when(kind == "metric", F.col("no_ts"))), F.lit(0)).alias("missing_timestamps"),
        F.sum("no_source").alias("missing_sources"),
        (1 - rows("error") / F.sum(n)).alias("score"),
        F.count(metric).alias("total_families"),
        F.avg(metric).alias("avg_samples_per_family"),
        F.min(metric).alias("min_samples"),
        F.max(metric).alias("max_samples"),
    )
