"""Categorical dimensions of points: source and one dimension per tag key, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.lines import NUMBER
from metricloom.operators.counts import entropy_stats, top_k, value_counts

SOURCE = "source"
TAG = "tag:"

# Fixed patterns of the tag type rules.
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LONG_ALNUM = r"^[A-Za-z0-9]{20,}$"
KEBAB = r"^[A-Za-z]+-[A-Za-z0-9-]+$"


def explode_tags(df: DataFrame, *keep: str) -> DataFrame:
    """One row per (record, key, value)."""
    return df.select(*keep, F.explode("tags").alias("key", "value"))


def dim_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dim, value) -> n for source and every tag key; one shuffle feeds all statistics."""
    own = F.array(F.struct(F.lit(SOURCE).alias("dim"), F.col("source").alias("value")))
    tags = F.transform(
        F.map_entries("tags"),
        lambda e: F.struct(F.concat(F.lit(TAG), e["key"]).alias("dim"), e["value"].alias("value")),
    )
    long = df.select(*keys, F.inline(F.concat(own, F.coalesce(tags, F.array().cast("array<struct<dim:string,value:string>>")))))
    return value_counts(long, [*keys, "dim"], "value")


def tag_only(counts: DataFrame) -> DataFrame:
    """Tag dimensions with the bare key in ``key``."""
    return counts.filter(F.col("dim").startswith(TAG)).withColumn(
        "key", F.substr("dim", F.lit(len(TAG) + 1))
    )


def categorical(counts: DataFrame, keys: list[str], k: int = 100) -> DataFrame:
    """Top values with frequency over all non-null rows, distinct count and entropy."""
    stats = entropy_stats(counts, keys)
    best = top_k(counts, keys, "value", k)
    return best.join(stats.withColumnRenamed("n", "total"), keys).select(
        *keys, "rank", "value", "n",
        (F.col("n") / F.col("total")).alias("frequency"),
        "distinct_count",
        "entropy",
    )


def tag_schema(counts: DataFrame, families: DataFrame, keys: list[str]) -> DataFrame:
    """Presence, cardinality and inferred type per tag key.

    ``families`` holds ``samples`` per key. Types are decided on all values, weighted by their
    counts: numeric > .8, else identifier > .5, else text when distinct/rows > .8.
    """
    value, n = F.col("value"), F.col("n")

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)) / F.sum(n)

    identifier = F.lower(value).rlike(UUID) | value.rlike(LONG_ALNUM) | value.rlike(KEBAB)
    agg = tag_only(counts).groupBy(*keys, "key").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("cardinality"),
        share(value.rlike(NUMBER)).alias("numeric_share"),
        share(identifier).alias("identifier_share"),
    )
    kind = (
        F.when(F.col("numeric_share") > 0.8, "numeric")
        .when(F.col("identifier_share") > 0.5, "identifier")
        .when(F.col("cardinality") / F.col("rows") > 0.8, "text")
        .otherwise("categorical")
    )
    return agg.join(families.select(*keys, "samples"), keys).select(
        *keys, "key", "rows", "cardinality", "numeric_share", "identifier_share",
        kind.alias("type"),
        (F.col("rows") / F.col("samples")).alias("presence"),
    )


def tag_combinations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count of each complete tag map; ``combo`` is the sorted entry array."""
    combo = F.sort_array(F.map_entries("tags"))
    return df.groupBy(*keys, combo.alias("combo")).agg(F.count("*").alias("n"))


def tag_pairs(combos: DataFrame, keys: list[str]) -> DataFrame:
    """Count of each pair of tags that occur in the same record.

    Pairs are formed per distinct combination, after counting, not per record; two nested explodes
    stream them, so a very wide combination never becomes one huge array of pairs.
    """
    first = combos.filter(F.size("combo") > 1).select(*keys, "n", "combo", F.posexplode("combo").alias("_i", "a"))
    both = first.select(*keys, "n", "a", F.explode(F.slice("combo", F.col("_i") + 2, F.size("combo"))).alias("b"))
    named = both.select(
        *keys, "n",
        F.col("a.key").alias("key_a"), F.col("a.value").alias("value_a"),
        F.col("b.key").alias("key_b"), F.col("b.value").alias("value_b"),
    )
    return named.groupBy(*keys, "key_a", "value_a", "key_b", "value_b").agg(F.sum("n").alias("n"))


def long_form(points: DataFrame, *keep: str) -> DataFrame:
    """(dim, value) rows of source, tags, value and size; numbers travel as text, which keeps all
    digits of a double."""
    fixed = F.array(
        F.struct(F.lit(SOURCE).alias("dim"), F.col("source").alias("value")),
        F.struct(F.lit("value").alias("dim"), F.col("value").cast("string").alias("value")),
        F.struct(F.lit("size").alias("dim"), F.col("line_length").cast("string").alias("value")),
    )
    tags = F.transform(
        F.map_entries("tags"),
        lambda e: F.struct(F.concat(F.lit(TAG), e["key"]).alias("dim"), e["value"].alias("value")),
    )
    return points.select(*keep, F.inline(F.concat(fixed, tags)))


def split_long(counts: DataFrame) -> dict[str, DataFrame]:
    """The count tables behind the scores, from their long form."""
    keys = [c for c in counts.columns if c not in ("dim", "value", "n")]

    def number(dim: str, name: str, kind: str) -> DataFrame:
        return counts.filter(F.col("dim") == dim).select(*keys, F.col("value").cast(kind).alias(name), "n")

    return {
        "dims": counts.filter((F.col("dim") == SOURCE) | F.col("dim").startswith(TAG)),
        "values": number("value", "value", "double"),
        "sizes": number("size", "line_length", "bigint"),
    }
