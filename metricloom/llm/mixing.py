"""Mix sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.session import materialize

c = F.col
HASH_BITS = 60  # of md5, so SQL engines agree on it
LEVEL_BITS = 15  # bits one histogram resolves; four levels use up the hash
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_hash(key: Column) -> Column:
    """A repeatable 60-bit place of a row in its source's order."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """(skey, source_size, target) per source.

    Sources in code point order, null last, weigh 1..``cycle`` in turn and share the whole size;
    no target exceeds ``cap`` times its source, and what is cut goes to the others by weight. The
    common rate is found by repeated sums over the table of sources; only numbers reach the
    driver. The table has one row per source, and only it is numbered in one task.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(c("skey").startswith("s").desc(), "skey")) - 1
    per = materialize(per.withColumn("weight", (place % cycle + 1).cast("bigint")), "mix-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        above = c("source_size") * cap < c("weight") * rate
        n, taken, weight = per.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, c("source_size"))), F.sum(F.when(~above, c("weight")))
        ).first()
        if n == capped or not weight:
            break
        capped, rate = n, (total - cap * (taken or 0)) / weight
    above = c("source_size") * cap < c("weight") * rate
    return per.select("skey", "source_size", F.when(above, c("source_size") * cap).otherwise(c("weight") * rate).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(skey, ..., full, edge, with_edge): rows below ``edge`` are taken once more than ``full`` times.

    One histogram of sizes over (source, leading hash bits) finds the bucket in which a source's
    budget ends; only rows of that bucket are counted again by the next bits, until it holds one
    hash value. No rows are sorted, and a hot source is summed before the shuffle.
    """
    full = F.floor(c("target") / F.nullif(c("source_size"), F.lit(0)))
    state = targets.withColumn("full", F.when(c("source_size") > 0, full).otherwise(0).cast("bigint"))
    state = materialize(state.withColumn("rest", c("target") - c("full") * c("source_size")), "mix-budgets")
    rows, rest = sizes.where("size > 0").select("skey", "size", "h"), state.select("skey", "rest")
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("h", shift)
        sums = rows.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
        upto = Window.partitionBy("skey").orderBy("bucket")
        sums = sums.withColumn("before", F.sum("sum").over(upto) - c("sum")).join(rest, "skey")
        edge = sums.where("before <= rest and rest < before + sum").select("skey", "bucket", (c("rest") - c("before")).alias("rest"))
        edge = materialize(edge, "mix-edges")
        rows = materialize(
            rows.withColumn("bucket", bucket).join(edge.select("skey", "bucket"), ["skey", "bucket"], "left_semi").drop("bucket"),
            "mix-edge-rows",
        )
        rest = edge.select("skey", "rest")
        if rows.groupBy("skey").agg((F.min("h") < F.max("h")).alias("more")).where("more").isEmpty():
            break
    last = rows.groupBy("skey").agg(F.min("h").alias("edge"), F.sum("size").alias("sum")).join(rest, "skey")
    last = last.select("skey", "edge", (c("rest") * 2 >= c("sum")).alias("with_edge"))
    return state.drop("rest").join(last, "skey", "left")


def mix_sources(
    rows: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", cap: float = 3.0, cycle: int = 3
) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, ``repeats`` and ``taken`` (repeats times size).

    ``rows`` needs a size column of whole numbers, 0 or more; null counts as 0. Whole copies come
    first, the remainder is filled by hash order up to the threshold, so every source's taken size
    is within half of one hash value's rows of its target. Rows that repeat a key stand or fall
    together. Null keys share one place. A table without rows or without any size takes nothing.
    Existing columns of the four names are replaced. Same rows, same result.
    """
    names = ("source_size", "target", "repeats", "taken")
    rows = rows.drop(*names)
    skey = F.coalesce(F.concat(F.lit("s"), c(source).cast("string")), F.lit("n"))
    amount = F.coalesce(c(size), F.lit(0)).cast("bigint")
    sizes = materialize(rows.select(skey.alias("skey"), amount.alias("size"), order_hash(c(key)).alias("h")), "mix-sizes")
    plan = materialize(thresholds(sizes, source_targets(sizes, cap, cycle)), "mix-plan")
    plan = plan.select("skey", "source_size", "target", "full", "edge", "with_edge")
    plan = plan.select(*[c(x).alias(f"_mix_{x}") for x in plan.columns])
    h = order_hash(c(key))
    once = F.coalesce((h < c("_mix_edge")) | ((h == c("_mix_edge")) & c("_mix_with_edge")), F.lit(False))
    out = rows.withColumn("_mix_key", skey).join(plan, c("_mix_key") == c("_mix_skey"))
    repeats = (c("_mix_full") + once.cast("bigint")).cast("bigint")
    return out.select(
        *[c(f"`{x}`") for x in rows.columns],
        c("_mix_source_size").alias("source_size"), c("_mix_target").alias("target"),
        repeats.alias("repeats"), (repeats * amount).alias("taken"),
    )
