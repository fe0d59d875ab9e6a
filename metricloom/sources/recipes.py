"""Recipe and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.schemas import RECIPE


def sink_parsed_by_type(parsed: DataFrame, path: str) -> None:
    parsed.write.mode("append").option("compression", "zstd").partitionBy("record_type").parquet(path)


def sink_by_family(rows: DataFrame, path: str) -> None:
    """Partitioned by the first two hex digits of the family: 256 folders however many families.

    Rows are range-partitioned on (prefix, family, ts) so a big family spreads over several files
    and each file keeps narrow min/max statistics for pruning.
    """
    (
        rows.withColumn("prefix", F.substring("family_id", 1, 2))
        .repartitionByRange("prefix", "family_id", F.hash(*[c for c in ("ts", "source") if c in rows.columns]))
        .sortWithinPartitions("prefix", "family_id")
        .write.mode("append").option("compression", "zstd").partitionBy("prefix").parquet(path)
    )


def filter_family(rows: DataFrame, family: str) -> DataFrame:
    """Rows of one family; with the prefix predicate the scan reads one folder."""
    condition = F.col("family_id") == family
    if "prefix" in rows.columns:
        condition = condition & (F.col("prefix") == family[:2])
    return rows.filter(condition)


def sink_recipes(recipes: DataFrame, path: str, as_json: bool = False) -> None:
    """Recipes in folders by the first two hex digits of the family, as the index names them."""
    placed = recipes.withColumn("prefix", F.substring("family_id", 1, 2)).write.mode("append").partitionBy("prefix")
    if as_json:
        placed.option("compression", "gzip").json(path)
    else:
        placed.option("compression", "zstd").parquet(path)


def scan_recipes(spark: SparkSession, path: str, as_json: bool = False) -> DataFrame:
    """Recipes with the file they came from and the load time."""
    reader = spark.read.schema(RECIPE)
    frame = reader.json(path) if as_json else reader.parquet(path)
    return frame.select(
        "*", F.col("_metadata.file_name").alias("file_name"), F.current_timestamp().alias("loaded_at")
    ).drop("prefix")


def recipe_index(recipes: DataFrame, path: str = "") -> DataFrame:
    """Catalogue of recipes."""
    return recipes.select(
        "family_id",
        "metric_name",
        F.col("schema.type").alias("type"),
        F.col("statistics.sample_count").alias("sample_count"),
        F.array_join(F.sort_array(F.map_keys("schema.tag_schema")), ",").alias("tag_keys"),
        F.concat(F.lit(path), F.lit("prefix="), F.substring("family_id", 1, 2)).alias("path"),
    )


def sink_report(report: DataFrame, path: str) -> None:
    """One-row JSON report."""
    report.coalesce(1).write.mode("overwrite").json(path)


def completion_marker(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """Written last: counts of what the job produced."""
    marker = recipes.agg(F.count("*").alias("recipes")).withColumn("status", F.lit("complete"))
    marker.write.mode("overwrite").json(path)
    return spark.read.schema("recipes bigint, status string").json(path)
