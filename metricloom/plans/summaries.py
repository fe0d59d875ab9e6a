"""Queries: merged daily sketches against exact results, checksums of files from their spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.operators import counts as C
from metricloom.operators import sketches as S
from metricloom.plans.catalog import query
from metricloom.session import materialize, work_dir
from metricloom.sources import captures
from metricloom.sources import tables as t

c = F.col
FAM = ["family_id"]


def by_day(p):
    return p.withColumn("day", F.floor(c("ts") / 86400))


def rank_check(merged, exact, keys: list[str], value: str):
    """(keys, p, n, within): each sketched quantile's true rank against the stated error."""
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("p"), F.lit(x).alias("at"), S.quantile(c("sketch"), x).alias("q")) for name, x in C.PROBS.items()])).alias("w")
    guess = merged.select(*keys, S.size(c("sketch")).alias("n"), wanted).select(*keys, "n", "w.p", "w.at", "w.q")
    ranks = guess.join(exact, keys).groupBy(*keys, "n", "p", "at").agg(
        (F.sum(F.when(c(value) < c("q"), c("k")).otherwise(0)) / F.sum("k")).alias("below"), (F.sum(F.when(c(value) <= c("q"), c("k")).otherwise(0)) / F.sum("k")).alias("upto")
    )
    off = F.greatest(c("below") - c("at"), c("at") - c("upto"), F.lit(0.0))
    # the error holds for 99 in 100 quantiles; twice of it practically always, and one row where there are few
    return ranks.select(*keys, "p", "n", (off <= 2 * S.rank_error() + 1.0 / c("n")).alias("within"))


@query(
    "sketch_quantiles",
    "SELECT family_id, p, count(*) AS n, true AS within FROM points, (SELECT unnest(['p01', 'p05', 'p50', 'p95', 'p99']) AS p) GROUP BY family_id, p",
)
def _(spark, d):
    """Quantiles of each family from sketches kept per day."""
    p = by_day(t.points(spark, d))
    days = materialize(S.quantile_sketches(p, [*FAM, "day"], "value"), "quantile-sketches")
    exact = C.value_counts(p, FAM, "value").withColumnRenamed("n", "k")
    return rank_check(S.merge_quantiles(days, FAM), exact, FAM, "value")


@query(
    "digest_quantiles",
    "SELECT l_suppkey, p, count(*) AS n, true AS within FROM lineitem, (SELECT unnest(['p01', 'p05', 'p50', 'p95', 'p99']) AS p) GROUP BY l_suppkey, p",
)
def _(spark, d):
    """Price digests per supplier from monthly sketches."""
    li = t.table(spark, d, "lineitem").withColumn("month", F.trunc(c("l_shipdate"), "month"))
    months = materialize(S.quantile_sketches(li, ["l_suppkey", "month"], "l_extendedprice"), "price-sketches")
    exact = C.value_counts(li, ["l_suppkey"], "l_extendedprice").withColumnRenamed("n", "k")
    return rank_check(S.merge_quantiles(months, ["l_suppkey"]), exact, ["l_suppkey"], "l_extendedprice")


@query("sketch_distinct_sources", "SELECT family_id, count(DISTINCT source) AS sources, true AS within, true AS union_agrees FROM points GROUP BY family_id")
def _(spark, d):
    """Distinct sources of each family from sketches kept per day, against the exact count and one sketch of all days."""
    p = by_day(t.points(spark, d))
    days = materialize(S.distinct_sketches(p, [*FAM, "day"], "source"), "source-sketches")
    merged = S.merge_distinct(days, FAM).select(*FAM, S.distinct(c("sketch")).alias("merged"))
    whole = S.distinct_sketches(p, FAM, "source").select(*FAM, S.distinct(c("sketch")).alias("whole"))
    exact = C.value_counts(p, FAM, "source").groupBy(*FAM).agg(F.count("*").alias("sources"))
    most = 4 * S.count_error() * c("sources") + 0.5
    return exact.join(merged, FAM).join(whole, FAM).select(
        *FAM, "sources", (F.abs(c("merged") - c("sources")) <= most).alias("within"), (F.abs(c("merged") - c("whole")) <= most).alias("union_agrees")
    )


@query("text_checksums", "SELECT CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, true AS equal FROM points")
def _(spark, d):
    """Checksums of landed text files from their spans, against one pass over each file."""
    path = work_dir(spark, "checksums")
    captures.sink_lines_text(t.metric_lines(spark, d), path, "none")
    parts = S.text_checksums(spark, path, "part-*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.crc32("content").alias("whole"), "length")
    both = files.where("length > 0").join(parts.withColumn("name", F.element_at(F.split("file_path", "/"), -1)), "name", "left")
    return both.agg(F.sum("bytes").alias("bytes"), F.bool_and(F.coalesce((c("whole") == c("crc32")) & (c("length") == c("bytes")), F.lit(False))).alias("equal"))


@query(
    "tag_combination_top",
    """SELECT family_id, combo, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY n DESC, combo) AS rank FROM (
         SELECT family_id, coalesce('env=' || env || ',', '') || 'k=' || k AS combo, count(*) AS n FROM points GROUP BY ALL)) WHERE rank <= 100""",
)
def _(spark, d):
    """The hundred commonest tag sets of each family, by candidates and an exact recount."""
    combo = F.array_join(F.transform(F.sort_array(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    p = t.points(spark, d).select(*FAM, combo.alias("combo"))
    return S.frequent_items(p, FAM, "combo", 100).select(*FAM, "combo", "n", "rank")
