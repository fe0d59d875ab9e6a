"""Queries: series spaces sized and numbered from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators import counts as C
from metricloom.operators import series
from metricloom.plans.catalog import query
from metricloom.sources import tables as t

c = F.col


def per_type(spark, d) -> DataFrame:
    e = t.table(spark, d, "events")
    return e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.countDistinct("props").alias("k")).groupBy("event_type").agg(
        F.sum("n").alias("target"), F.count("*").alias("users"), F.max("k").alias("ks")
    )


DIMS_SQL = "(SELECT event_type, CAST(sum(n) AS BIGINT) AS target, count(*) AS users, max(k) AS ks FROM (SELECT event_type, user_id, count(*) AS n, count(DISTINCT props) AS k FROM events GROUP BY ALL) GROUP BY event_type)"


@query(
    "series_weighted_dims",
    f"""SELECT event_type, target, CAST(greatest(1, floor(users * unit + 0.5)) AS BIGINT) AS hosts, CAST(greatest(1, floor(ks * unit + 0.5)) AS BIGINT) AS tags
        FROM (SELECT *, power(CAST(target AS DOUBLE), 0.5) / power(CAST(users * ks AS DOUBLE), 0.5) AS unit FROM {DIMS_SQL})""",
)
def _(spark, d):
    """Hosts and tag values in the proportion of users to keys, sized to each type's volume."""
    hosts, tags = series.weighted_dims([c("users"), c("ks")], c("target"))
    return per_type(spark, d).select("event_type", "target", hosts.cast("bigint").alias("hosts"), tags.cast("bigint").alias("tags"))


@query(
    "series_pegged_dims",
    f"""SELECT event_type, target, users AS hosts, CAST(greatest(1, floor(power(target / CAST(users AS DOUBLE), 0.5) + 0.5)) AS BIGINT) AS metrics,
          CAST(greatest(1, floor(power(target / CAST(users AS DOUBLE), 0.5) + 0.5)) AS BIGINT) AS tags FROM {DIMS_SQL}""",
)
def _(spark, d):
    hosts, metrics, tags = series.pegged_dims([c("users"), F.lit(0), F.lit(0)], c("target"))
    return per_type(spark, d).select(
        "event_type", "target", hosts.alias("hosts"), metrics.cast("bigint").alias("metrics"), tags.cast("bigint").alias("tags")
    )


@query("digest_points")
def _(spark, d):
    """Price digests per supplier: about 20 centroids and the median.

    ``histogram_numeric`` merges partial histograms of fixed size, so a big group stays small.
    """
    li = t.table(spark, d, "lineitem")
    digest = li.groupBy("l_suppkey").agg(F.histogram_numeric("l_extendedprice", F.lit(20)).alias("h"), F.count("*").alias("n"))
    prices = C.value_counts(li, ["l_suppkey"], "l_extendedprice")
    median = C.exact_quantiles(prices, ["l_suppkey"], "l_extendedprice", {"median": 0.5})
    return digest.join(median, "l_suppkey").select("l_suppkey", "n", "median", F.posexplode("h").alias("i", "x")).select(
        "l_suppkey", "n", "median", "i", c("x.x").alias("mean"), c("x.y").alias("weight")
    )
