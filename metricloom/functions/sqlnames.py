"""The expression library under SQL names, for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.functions.lines import parse_lines

FUNCTIONS = {
    "family_id(metric STRING, tags MAP<STRING, STRING>) RETURNS STRING": (
        "sha1(concat(metric, '|', array_join(array_sort(map_keys(tags)), ',')))"
    ),
    "span_family_id(operation STRING) RETURNS STRING": "sha1(concat('span|', operation))",
    "series_id(metric STRING, source STRING, tags MAP<STRING, STRING>) RETURNS STRING": (
        "sha1(concat_ws('|', metric, source, array_join(array_sort("
        "transform(map_entries(tags), e -> concat(e.key, '=', e.value))), ',')))"
    ),
    "telemetry_uniform(seed STRING, row_key STRING, dim STRING) RETURNS DOUBLE": (
        "cast(conv(substr(md5(concat_ws('|', seed, row_key, dim)), 1, 13), 16, 10) as double) / 4503599627370496.0"
    ),
    "minute_of_day(ts BIGINT) RETURNS INT": "cast(floor(pmod(ts, 86400) / 60) as int)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]


def parsed_view(lines: DataFrame, name: str, column: str = "value") -> DataFrame:
    """Expose parsed lines to SQL as a temporary view."""
    parsed = parse_lines(lines, column)
    parsed.createOrReplaceTempView(name)
    return parsed
