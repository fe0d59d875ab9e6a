"""String shapes of sources and tag values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.operators.counts import top_k, value_counts

TOP_PATTERNS = 5
METACHARACTERS = r"([\\.^$|?*+()\[\]{}])"


def generalize(text: Column) -> Column:
    """Upper, lower and digit runs become ``[A-Z]+``, ``[a-z]+`` and ``\\d+``.

    Runs are first replaced by placeholder characters so that a later step cannot rewrite the
    classes written by an earlier one. Other characters stand for themselves: those with a meaning
    in patterns are escaped.
    """
    literal = F.regexp_replace(text, METACHARACTERS, r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(literal, "[A-Z]+", "\u0001"), "[a-z]+", "\u0002"), "[0-9]+", "\u0003")
    return F.replace(
        F.replace(F.replace(marked, F.lit("\u0001"), F.lit("[A-Z]+")), F.lit("\u0002"), F.lit("[a-z]+")),
        F.lit("\u0003"), F.lit("\\d+"),
    )


def pattern_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, generalize(F.col("value")).alias("pattern")).agg(F.sum("n").alias("n"))


def mine(counts: DataFrame, keys: list[str], k: int = TOP_PATTERNS, counted: str | None = None) -> DataFrame:
    """Most frequent patterns per key with their share of rows; ``counted`` names a column that holds them already."""
    patterns = value_counts(counts, keys, counted, "n") if counted else pattern_counts(counts, keys)
    totals = patterns.groupBy(*keys).agg(F.sum("n").alias("total"))
    return top_k(patterns, keys, "pattern", k).join(totals, keys).select(
        *keys, "rank", "pattern", "n", (F.col("n") / F.col("total")).alias("frequency")
    )


def ngrams(counts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Character n-gram counts weighted by how often each value occurs."""
    text = F.col("value")
    grams = F.transform(
        F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: i <= F.length(text) - size + 1),
        lambda i: F.substring(text, i, F.lit(size)),
    )
    return (
        counts.filter(F.length(text) >= size)
        .select(*keys, F.explode(grams).alias("gram"), "n")
        .groupBy(*keys, "gram")
        .agg(F.sum("n").alias("n"))
    )


def length_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys, F.length("value").cast("bigint").alias("length")).agg(F.sum("n").alias("n"))
