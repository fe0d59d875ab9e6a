"""Time: minute counts, intensity curves, burstiness and gaps between points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.operators.counts import value_counts

MINUTES = 1440

NO_TIME = -(1 << 60)  # bucket of rows without a time, before all others


def minute_counts(df: DataFrame, keys: list[str], ts: str = "ts", n: str | None = None) -> DataFrame:
    """Rows per minute; ``minute`` is the epoch second at its start, ``n`` sums existing counts."""
    window = F.window(F.timestamp_seconds(ts), "1 minute")
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(*keys, window.alias("w"))
        .agg((F.sum(n) if n else F.count("*")).alias("n"))
        .select(*keys, F.unix_timestamp("w.start").alias("minute"), "n")
    )


def minute_of_day(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86400)) / 60).cast("int")


def curve_points(minutes: DataFrame, keys: list[str]) -> DataFrame:
    """Occupied minutes of the day with their counts."""
    return minutes.groupBy(*keys, minute_of_day(F.col("minute")).alias("mod")).agg(F.sum("n").alias("n"))


def dense_curve(points: DataFrame, keys: list[str]) -> DataFrame:
    """1440 rows per key, normalised to mean 1, empty minutes 0."""
    totals = points.groupBy(*keys).agg(F.sum("n").alias("_total"))
    grid = totals.withColumn("mod", F.explode(F.sequence(F.lit(0), F.lit(MINUTES - 1))))
    return grid.join(points, [*keys, "mod"], "left").select(
        *keys, "mod", (F.coalesce("n", F.lit(0)) * float(MINUTES) / F.col("_total")).alias("rate")
    )


def burstiness(minutes: DataFrame, keys: list[str]) -> DataFrame:
    """CV and Fano factor of per-minute counts from the first to the last minute.

    Empty minutes count as zeros; they enter through the number of minutes, not as rows.
    """
    n, mean = F.col("n").cast("double"), F.col("_mean")
    whole = minutes.groupBy(*keys).agg(((F.max("minute") - F.min("minute")) / 60 + 1).alias("_m"), F.sum(n).alias("_s"), F.count("*").alias("_k"))
    whole = whole.select(*keys, "_m", (F.col("_s") / F.col("_m")).alias("_mean"), (F.col("_m") - F.col("_k")).alias("_empty"))
    # squares are taken around the mean, so steady minutes with large counts keep their digits
    agg = minutes.join(whole, keys).groupBy(*keys).agg(
        F.sum((n - mean) * (n - mean)).alias("_ss"), F.first("_m").alias("_m"), F.first("_mean").alias("_mean"), F.first("_empty").alias("_empty")
    )
    var = (F.col("_ss") + F.col("_empty") * mean * mean) / F.col("_m")
    return agg.select(
        *keys,
        F.col("_m").cast("bigint").alias("minutes"),
        (F.sqrt(var) / mean).alias("cv_counts"),
        (var / mean).alias("fano_factor"),
    )


def previous_in_series(
    df: DataFrame, keys: list[str], ts: str, order: list[str], bucket_seconds: int = 3600
) -> DataFrame:
    """Adds ``prev_ts``: the time of the previous row of the key.

    Rows are windowed per (key, time bucket); the first row of a bucket takes its predecessor
    from a summary of bucket ends. One key's rows therefore spread over as many tasks as it has
    buckets. Rows without a time have no predecessor and are none.
    """
    bucketed = df.withColumn("_tb", F.coalesce(F.floor(F.col(ts) / bucket_seconds), F.lit(NO_TIME)))
    inside = bucketed.withColumn("_in", F.lag(ts).over(W.partitionBy(*keys, "_tb").orderBy(*order)))
    ends = (
        bucketed.groupBy(*keys, "_tb")
        .agg(F.max(ts).alias("_end"))
        .withColumn("_carry", F.lag("_end").over(W.partitionBy(*keys).orderBy("_tb")))
        .select(*keys, "_tb", "_carry")
    )
    return (
        inside.join(ends, [*keys, "_tb"])
        .withColumn("prev_ts", F.coalesce("_in", "_carry"))
        .drop("_tb", "_in", "_carry")
    )


def gap_counts(df: DataFrame, keys: list[str], ts: str = "ts", bucket_seconds: int = 3600, n: str | None = None) -> DataFrame:
    """(keys, gap) -> n over consecutive points of a key; ``n`` names the counts where rows have been counted.

    Equal seconds are counted first (they are gaps of 0), so the windows only see distinct
    seconds.
    """
    seconds = value_counts(df, keys, ts, n)
    linked = previous_in_series(seconds, keys, ts, [ts], bucket_seconds)
    steps = F.array(
        F.struct((F.col(ts) - F.col("prev_ts")).alias("gap"), F.lit(1).cast("bigint").alias("c")),
        F.struct(F.lit(0).cast("bigint").alias("gap"), (F.col("n") - 1).alias("c")),
    )
    return (
        linked.select(*keys, F.inline(steps))
        .filter(F.col("gap").isNotNull() & (F.col("c") > 0))
        .groupBy(*keys, "gap")
        .agg(F.sum("c").alias("n"))
    )


def gap_cv(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Population CV of gaps."""
    g, n = F.col("gap").cast("double"), F.col("n")
    mean = F.col("_mean")
    whole = gaps.groupBy(*keys).agg(F.sum("n").alias("gaps"), (F.sum(g * n) / F.sum("n")).alias("_mean"))
    agg = gaps.join(whole, keys).groupBy(*keys).agg(
        F.first("gaps").alias("gaps"), F.first("_mean").alias("_mean"), F.sum((g - mean) * (g - mean) * n).alias("_ss")
    )
    var = F.col("_ss") / F.col("gaps")
    return agg.select(
        *keys, "gaps", mean.alias("mean_gap"), F.when(mean > 0, F.sqrt(var) / mean).alias("cv_interarrival")
    )
