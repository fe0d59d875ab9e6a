"""Queries: joins, windows, sorts and set operations behind the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.draws import pick, uniform
from metricloom.operators import counts as C
from metricloom.operators import dims as D
from metricloom.operators import divergence as V
from metricloom.operators import synth, temporal
from metricloom.plans.catalog import query, u
from metricloom.session import work_dir
from metricloom.sources import buckets
from metricloom.sources import tables as t

c = F.col
FAM = ["family_id"]


@query(
    "join_metric_histogram_family",
    """SELECT m.family_id, m.n AS points, h.n AS histograms, h.total AS hist_total FROM
         (SELECT sha1('sales.quantity|') AS family_id, count(*) AS n FROM lineitem) m
         JOIN (SELECT family_id, count(*) AS n, CAST(sum(hist_count) AS BIGINT) AS total FROM hists GROUP BY family_id) h USING (family_id)""",
)
def _(spark, d):
    """Both sides are reduced to one row per family before they meet."""
    li = t.table(spark, d, "lineitem")
    m = li.select(F.sha1(F.lit("sales.quantity|")).alias("family_id")).groupBy("family_id").agg(F.count("*").alias("points"))
    h = t.histograms(spark, d).groupBy("family_id").agg(F.count("*").alias("histograms"), F.sum("hist_count").alias("hist_total"))
    return m.join(h, "family_id")


@query(
    "join_recipe_samples",
    """SELECT c.family_id, count(*) AS n, count(*) FILTER (c.value < r.v[1]) AS below, count(*) FILTER (c.value > r.v[5]) AS above
       FROM curs c JOIN rq r ON r.family_id = c.family_id GROUP BY c.family_id""",
)
def _(spark, d):
    """Current samples against the reference quantiles of their family."""
    ref, cur = t.reference_and_current(spark, d)
    q = C.exact_quantiles(C.value_counts(ref, FAM, "value"), FAM, "value")
    return cur.join(q, "family_id").groupBy("family_id").agg(
        F.count("*").alias("n"), F.count_if(c("value") < c("p01")).alias("below"), F.count_if(c("value") > c("p99")).alias("above")
    )


@query(
    "join_family_buckets",
    """SELECT c.family_id, count(*) AS n, count(*) FILTER (c.value < r.v[1]) AS below, count(*) FILTER (c.value > r.v[5]) AS above
       FROM curs c JOIN rq r ON r.family_id = c.family_id GROUP BY c.family_id""",
)
def _(spark, d):
    """The same join over stored tables that share their buckets."""
    ref, cur = t.reference_and_current(spark, d)
    q = C.exact_quantiles(C.value_counts(ref, FAM, "value"), FAM, "value")
    points = buckets.store(buckets.sliced(cur.select("family_id", "row_id", "value"), "row_id"), work_dir(spark, "point-buckets"), 8)
    families = buckets.store(buckets.for_every_slice(q), work_dir(spark, "family-buckets"), 8)
    return buckets.join(spark, points, families).groupBy("family_id").agg(
        F.count("*").alias("n"), F.count_if(c("value") < c("p01")).alias("below"), F.count_if(c("value") > c("p99")).alias("above")
    )


@query(
    "join_distribution_outer",
    "SELECT family_id, dim, value, round(p, 6) AS p, round(q, 6) AS q FROM aligned",
)
def _(spark, d):
    ref, cur = t.reference_and_current(spark, d)
    return V.align(D.dim_counts(ref, FAM), D.dim_counts(cur, FAM), [*FAM, "dim"], "value")


TOPITEMS = """items AS (SELECT family_id, value, n, rank, sum(n) OVER (PARTITION BY family_id ORDER BY rank) AS cum, sum(n) OVER (PARTITION BY family_id) AS total
      FROM (SELECT family_id, value, n, row_number() OVER (PARTITION BY family_id ORDER BY n DESC, value) AS rank FROM dimcounts WHERE dim = 'source') WHERE rank <= 100)"""


ALLITEMS = """items AS (SELECT family_id, value, n, rank, sum(n) OVER (PARTITION BY family_id ORDER BY rank) AS cum, sum(n) OVER (PARTITION BY family_id) AS total
      FROM (SELECT family_id, value, n, row_number() OVER (PARTITION BY family_id ORDER BY md5(value), value) AS rank FROM dimcounts WHERE dim = 'source'))"""


@query(
    "join_weighted_range",
    f"""WITH {ALLITEMS}
        SELECT p.row_id, i.value AS picked FROM (SELECT *, {u('row_id', 'pick', 5)} AS u FROM points) p
        JOIN items i ON i.family_id = p.family_id AND i.cum >= p.u * i.total AND (i.cum - i.n < p.u * i.total OR i.rank = 1)""",
)
def _(spark, d):
    """A source per point by cumulative weight, from all sources of the family."""
    p = t.points(spark, d)
    rows = p.select("row_id", "family_id", uniform(5, c("row_id"), "pick").alias("u"))
    return synth.draw_values(rows, C.value_counts(p, FAM, "source"), FAM, "source", "u", "picked").select("row_id", "picked")


@query(
    "join_scenario_theta",
    r"""SELECT s.name, f.family_id FROM famcounts f JOIN
         (SELECT DISTINCT 'load-' || event_type AS name, 'app.' || substr(event_type, 1, 2) || '*' AS pattern FROM events UNION SELECT 'load-all', 'app.*') s
         ON regexp_full_match(f.metric, replace(replace(s.pattern, '.', '\.'), '*', '.*'))""",
)
def _(spark, d):
    e = t.table(spark, d, "events")
    rows = F.array(
        F.struct(F.concat(F.lit("load-"), "event_type").alias("name"), F.concat(F.lit("app."), F.substring("event_type", 1, 2), F.lit("*")).alias("pattern")),
        F.struct(F.lit("load-all").alias("name"), F.lit("app.*").alias("pattern")),
    )
    scenarios = e.select(F.inline(rows)).distinct()
    families = t.points(spark, d).select("family_id", "metric").distinct()
    return synth.match_globs(families, "metric", scenarios, "pattern").select("name", "family_id")


def recipe_families(spark, d) -> DataFrame:
    ref, _cur = t.reference_and_current(spark, d)
    return ref.filter(F.map_contains_key("tags", "env")).select("family_id").distinct()


@query(
    "semi_anti_recipe",
    "SELECT family_id, family_id IN (SELECT family_id FROM refs WHERE env IS NOT NULL) AS has_recipe, n FROM famcounts",
)
def _(spark, d):
    families = t.points(spark, d).groupBy("family_id").agg(F.count("*").alias("n"))
    have = recipe_families(spark, d)
    yes = families.join(have, "family_id", "left_semi").withColumn("has_recipe", F.lit(True))
    no = families.join(have, "family_id", "left_anti").withColumn("has_recipe", F.lit(False))
    return yes.unionByName(no)


@query(
    "win_topk_per_group",
    "SELECT family_id, dim, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY family_id, dim ORDER BY n DESC, value) AS rank FROM dimcounts) WHERE rank <= 5",
)
def _(spark, d):
    return C.top_k(D.dim_counts(t.points(spark, d), FAM), [*FAM, "dim"], "value", 5)


@query(
    "win_cumulative_weight",
    f"WITH {TOPITEMS} SELECT family_id, value, rank, n, CAST(cum AS BIGINT) AS cum FROM items",
)
def _(spark, d):
    best = C.top_k(C.value_counts(t.points(spark, d), FAM, "source").withColumnRenamed("source", "value"), FAM, "value", 100)
    return synth.with_cumulative(best, FAM, "n", ["rank"]).select(*FAM, "value", "rank", "n", "cum")


@query(
    "win_last_n_samples",
    """SELECT family_id, window_start, row_id, rank FROM (
         SELECT family_id, window_start, row_id, row_number() OVER (PARTITION BY family_id, window_start ORDER BY ts DESC, row_id DESC) AS rank FROM day) WHERE rank <= 20""",
)
def _(spark, d):
    """Newest samples per family and day."""
    p = t.points(spark, d).withColumn("window_start", F.floor(c("ts") / 86400) * 86400)
    keys = ["family_id", "window_start"]
    return C.newest_per_group(p, keys, [F.desc("ts"), F.desc("row_id")], 20, c("row_id")).select(*keys, "row_id", "rank")


@query(
    "win_lag_interarrival",
    "SELECT row_id, ts - lag(ts) OVER (PARTITION BY family_id ORDER BY ts, row_id) AS gap FROM points",
)
def _(spark, d):
    p = t.points(spark, d)
    return temporal.previous_in_series(p, FAM, "ts", ["ts", "row_id"], 86400).select("row_id", (c("ts") - c("prev_ts")).alias("gap"))


@query(
    "sort_topn",
    "SELECT value, n FROM (SELECT source AS value, count(*) AS n FROM points GROUP BY source) ORDER BY n DESC, value LIMIT 100",
)
def _(spark, d):
    return t.points(spark, d).groupBy(c("source").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(100)


@query("sort_minutes", "SELECT minute, CAST(sum(n) AS BIGINT) AS n FROM minutes GROUP BY minute ORDER BY minute")
def _(spark, d):
    return t.points(spark, d).groupBy((F.floor(c("ts") / 60) * 60).alias("minute")).agg(F.count("*").alias("n")).orderBy("minute")


@query(
    "distinct_keys",
    "SELECT DISTINCT 'tag' AS kind, key AS name FROM ptags UNION ALL SELECT DISTINCT 'operation', operation FROM spans UNION ALL SELECT DISTINCT 'source', source FROM points",
)
def _(spark, d):
    p = t.points(spark, d)
    tags = p.select(F.lit("tag").alias("kind"), F.explode(F.map_keys("tags")).alias("name")).distinct()
    ops = t.spans(spark, d).select(F.lit("operation").alias("kind"), c("operation").alias("name")).distinct()
    return tags.unionByName(ops).unionByName(p.select(F.lit("source").alias("kind"), c("source").alias("name")).distinct())


@query("union_keys", "SELECT DISTINCT dim, value FROM aligned")
def _(spark, d):
    ref, cur = t.reference_and_current(spark, d)
    one = D.dim_counts(ref, FAM).select("dim", "value")
    return one.unionByName(D.dim_counts(cur, FAM).select("dim", "value")).distinct()


@query(
    "dense_fill",
    """SELECT g.family_id, g.hour, coalesce(n, 0) AS n FROM
         (SELECT family_id, unnest(range(min(ts) // 3600, max(ts) // 3600 + 1)) AS hour FROM points GROUP BY family_id) g
         LEFT JOIN (SELECT family_id, ts // 3600 AS hour, count(*) AS n FROM points GROUP BY ALL) p ON p.family_id = g.family_id AND p.hour = g.hour""",
)
def _(spark, d):
    """Every hour of each family's range; hours without points count 0."""
    counts = t.points(spark, d).groupBy(*FAM, F.floor(c("ts") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    span = counts.groupBy(*FAM).agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = span.select(*FAM, F.explode(F.sequence("a", "b")).alias("hour"))
    return grid.join(counts, [*FAM, "hour"], "left").select(*FAM, "hour", F.coalesce("n", F.lit(0)).alias("n"))
