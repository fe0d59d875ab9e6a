"""Counting primitives that stay safe when one key holds a large share of the rows.

Everything downstream works on (keys, value, n) counts. The first aggregation combines on the map
side and spreads a hot key over its distinct values, so no later step sees its raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROBS = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
BINS = 32
STEPS_PER_OCTAVE = 1024


def value_counts(df: DataFrame, keys: list[str], value: str, n: str | None = None) -> DataFrame:
    """(keys, value) -> n, nulls left out; ``n`` sums existing counts instead of counting rows."""
    weight = F.sum(n) if n else F.count("*")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(weight.alias("n"))


def top_k(counts: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values per key, ties by value; adds ``rank``.

    Spark limits each task's groups to k rows before the shuffle when it sees this filter, so a
    key with very many values is never gathered in one place.
    """
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def newest_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column, ways: int = 64) -> DataFrame:
    """First k rows per key in ``order``, in two rounds.

    The first round keeps k rows per (key, slice), where ``spread`` deals a hot key's rows over
    ``ways`` slices; any row of the final answer is among them. The second round picks from at
    most ``k * ways`` rows per key.
    """
    sliced = df.withColumn("_slice", F.pmod(F.hash(spread), F.lit(ways)))
    first = sliced.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*order))
    ).filter(F.col("_rank") <= k)
    return (
        first.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("_rank") <= k)
        .drop("_slice")
        .withColumnRenamed("_rank", "rank")
    )


def order_bucket(value: Column) -> Column:
    """Integer that never decreases as ``value`` grows: about 0.07 % of a value's size per step."""
    size = F.abs(value.cast("double"))
    step = F.floor(F.log2(size) * STEPS_PER_OCTAVE).cast("bigint") + 2**21
    bucket = F.when(size == 0, F.lit(0).cast("bigint")).when(value < 0, -step).otherwise(step)
    # never null, so joins on it add no filter that would make two uses of one count table differ
    return F.coalesce(bucket, F.lit(0).cast("bigint"))


def bucket_totals(counts: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Counts tagged with their order bucket, and per-bucket running totals.

    The running totals are the only window over a whole key; it sees one row per occupied bucket
    (a few thousand), not one per value.
    """
    tagged = counts.withColumn("_b", order_bucket(F.col(value)))
    by_key = W.partitionBy(*keys)
    totals = (
        tagged.groupBy(*keys, "_b")
        .agg(F.sum("n").alias("_bn"))
        .withColumn("_upto", F.sum("_bn").over(by_key.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_before", F.col("_upto") - F.col("_bn"))
        .withColumn("total", F.sum("_bn").over(by_key))
    )
    return tagged, totals


def cumulative_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``cum`` (rows with a value <= this one) and ``total`` per key.

    A prefix sum in two levels: over buckets, then inside each bucket.
    """
    tagged, totals = bucket_totals(counts, keys, value)
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        tagged.join(totals.select(*keys, "_b", "_before", "total"), [*keys, "_b"])
        .withColumn("cum", F.col("_before") + F.sum("n").over(inside))
        .drop("_b", "_before")
    )


def exact_quantiles(
    counts: DataFrame, keys: list[str], value: str, probs: dict[str, float] | None = None, total: str | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per probability; ``total`` names an
    optional column with the number of rows.

    Only buckets that hold a wanted rank are looked into, so a hot key's values are never
    collected into one buffer as ``percentile`` would do.
    """
    probs = probs or PROBS
    tagged, totals = bucket_totals(counts, keys, value)
    last = F.col("total") - 1

    def low(p: float) -> Column:
        return F.floor(last * p)

    def high(p: float) -> Column:
        return F.ceil(last * p)

    ranks = F.array_distinct(F.array(*[r for p in probs.values() for r in (low(p), high(p))]))
    wanted = totals.filter(
        F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))
    ).select(*keys, "_b", "_before", "total")
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = (
        tagged.join(wanted, [*keys, "_b"])
        .withColumn("_hi", F.col("_before") + F.sum("n").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("n"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_lo")) & (rank < F.col("_hi")), F.col(value).cast("double")))

    picks = []
    for name, p in probs.items():
        picks += [at(low(p)).alias(f"_l_{name}"), at(high(p)).alias(f"_h_{name}")]
    found = placed.groupBy(*keys).agg(F.max("total").alias("total"), *picks)
    return found.select(
        *keys,
        *([F.col("total").alias(total)] if total else []),
        *[
            (
                F.col(f"_l_{name}")
                + (F.col(f"_h_{name}") - F.col(f"_l_{name}")) * (last * p - F.floor(last * p))
            ).alias(name)
            for name, p in probs.items()
        ],
    )


def moments(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sample stddev, min and max per key from counts."""
    v, n = F.col(value).cast("double"), F.col("n")
    basic = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(v * n).alias("_s"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    # squares are taken around the mean, so large offsets do not cancel away the variance
    centred = (
        counts.join(basic.select(*keys, (F.col("_s") / F.col("n")).alias("_mean")), keys)
        .groupBy(*keys)
        .agg(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_ss"))
    )
    return basic.join(centred, keys).select(
        *keys,
        "n",
        (F.col("_s") / F.col("n")).alias("mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("_ss") / (F.col("n") - 1))).alias("stddev"),
        "min",
        "max",
    )


def entropy_stats(counts: DataFrame, keys: list[str]) -> DataFrame:
    """n, distinct_count and Shannon entropy (bits) per key over all values.

    H = log2(N) - sum(n log2 n) / N, a plain sum that needs no total beforehand.
    """
    return (
        counts.groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("distinct_count"),
            F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
        )
        .select(
            *keys, "n", "distinct_count",
            F.greatest(F.log2("n") - F.col("_nlogn") / F.col("n"), F.lit(0.0)).alias("entropy"),
        )
    )


def histogram_bins(counts: DataFrame, quantiles: DataFrame, keys: list[str], value: str, bins: int = BINS) -> DataFrame:
    """Rows per equal-width bin between p01 and p99; outliers fall into the end bins."""
    width = (F.col("p99") - F.col("p01")) / bins
    index = F.when(width <= 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - F.col("p01")) / width)))
    )
    filled = (
        counts.join(quantiles.select(*keys, "p01", "p99"), keys)
        .groupBy(*keys, index.cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    return filled


def dense_bins(filled: DataFrame, quantiles: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """All bins of every key with their edges; empty ones count 0."""
    width = (F.col("p99") - F.col("p01")) / bins
    grid = quantiles.select(*keys, "p01", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("p01") + F.col("bin") * F.col("_w")).alias("lo"),
        (F.col("p01") + (F.col("bin") + 1) * F.col("_w")).alias("hi"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def spread_sequence(df: DataFrame, keys: list[str], n: str, index: str, chunk: int = 10_000) -> DataFrame:
    """``n`` copies of each row (one row per ``keys``), numbered from 0 in ``index``.

    A row is first split into chunks, the chunks are dealt over the cluster, and only then
    expanded, so a single row asking for billions of copies is not expanded by one task.
    """
    first = F.col("_chunk") * chunk
    return (
        df.filter(F.col(n) > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / chunk))))
        .repartition(F.xxhash64(*keys, "_chunk"))
        .withColumn(index, F.explode(F.sequence(first, F.least(F.col(n), first + chunk) - 1)))
        .drop("_chunk")
    )
