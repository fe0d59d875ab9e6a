"""Record and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())
CENTROIDS = T.ArrayType(
    T.StructType(
        [T.StructField("count", T.LongType()), T.StructField("value", T.DoubleType())]
    )
)


PARSED_COLUMNS = [
    "record_type", "metric", "value", "ts", "source", "tags", "is_delta",
    "granularity", "hist_count", "centroids",
    "operation", "start_ms", "duration_ms",
    "line_length", "drop_reason", "family_id",
]

CAT = "struct<top_values:array<struct<value:string,frequency:double>>,distinct_count:bigint,entropy:double>"
NUM = (
    "struct<bins:array<double>,counts:array<bigint>,"
    "quantiles:struct<p01:double,p05:double,p50:double,p95:double,p99:double>,"
    "mean:double,stddev:double,min:double,max:double>"
)
PARAM = (
    "struct<type:string,parameters:map<string,double>,"
    "goodness_of_fit:struct<ks_statistic:double,ks_p_value:double>>"
)
PAT = (
    "struct<pattern:string,frequency:double,"
    "char_distributions:struct<unigrams:map<string,double>,bigrams:map<string,double>,"
    f"trigrams:map<string,double>>,length_distribution:{NUM}>"
)

RECIPE = (
    "version string, family_id string, metric_name string, created_at timestamp, "
    "capture_window struct<start_time:timestamp,end_time:timestamp,duration_hours:double>, "
    "schema struct<type:string,is_delta:boolean,has_histogram:boolean,"
    "tag_schema:map<string,struct<type:string,presence:double,cardinality:bigint>>>, "
    f"statistics struct<sample_count:bigint,source_distribution:{CAT},"
    f"tag_distributions:map<string,{CAT}>,"
    "tag_cooccurrence:array<struct<tags:map<string,string>,frequency:double>>,"
    f"value_distribution:{NUM},parametric:{PARAM},"
    "histogram_distribution:struct<granularities:map<string,double>,"
    f"centroid_count_distribution:{NUM},centroid_value_distribution:{NUM}>,"
    f"span_distribution:struct<duration_distribution:{NUM},operation_distribution:{CAT}>>, "
    "temporal struct<intensity_curve:array<double>,"
    "burstiness:struct<coefficient_of_variation:double,cv_interarrival:double,fano_factor:double>,"
    "cadence:map<string,double>>, "
    f"payload struct<size_distribution:{NUM},error_rate:double>, "
    f"patterns struct<source_patterns:array<{PAT}>,tag_value_patterns:map<string,array<{PAT}>>>, "
    f"generation struct<entity_hints:struct<source_count_estimate:bigint,"
    f"per_source_rate_distribution:{NUM}>,"
    "constraints:struct<max_cardinality_per_tag:map<string,bigint>,required_tags:array<string>>>, "
    "validation struct<coverage:double,drop_reasons:map<string,bigint>,"
    "fitness_scores:struct<categorical_js_divergence:double,numeric_ks_statistic:double,"
    "temporal_correlation:double>>"
)

MANIFEST = (
    "object_name string, original_size bigint, compressed_size bigint, compression_ratio double, "
    "timestamp timestamp, instance_id string, zone string, crc32 bigint, sha256 string, dt date"
)

SCENARIO = (
    "name string, families array<string>, multiplier double, burst_factor double, "
    "schema_drift double, error_injection double, tag_skew double, partitions int, "
    "output_path string"
)
