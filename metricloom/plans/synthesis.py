"""Queries: synthetic tables drawn from what the given tables profile to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions import formats
from metricloom.functions.draws import exponential, log_normal, pick, uniform
from metricloom.operators import counts as C
from metricloom.operators import dims as D
from metricloom.operators import divergence as V
from metricloom.operators import fit, patterns, synth, temporal
from metricloom.plans.catalog import query, u
from metricloom.plans.relations import ALLITEMS
from metricloom.session import materialize
from metricloom.sources import tables as t

c = F.col
FAM = ["family_id"]
SEED = 21
DAY0 = 1704067200  # 2024-01-01


def quantile_frame(p: DataFrame) -> DataFrame:
    return C.exact_quantiles(C.value_counts(p, FAM, "value"), FAM, "value")


@query(
    "synth_categorical",
    f"""WITH {ALLITEMS}
        SELECT p.row_id, i.value AS source FROM (SELECT *, {u('row_id', 'source', SEED)} AS u FROM points) p
        JOIN items i ON i.family_id = p.family_id AND i.cum >= p.u * i.total AND (i.cum - i.n < p.u * i.total OR i.rank = 1)""",
)
def _(spark, d):
    p = t.points(spark, d)
    rows = p.select("row_id", *FAM, uniform(SEED, c("row_id"), "source").alias("u"))
    return synth.draw_values(rows, C.value_counts(p, FAM, "source"), FAM, "source", "u", "source").select("row_id", "source")


INTERP = """CASE WHEN u <= 0.01 THEN p01 WHEN u <= 0.05 THEN p01 + (p05 - p01) * ((u - 0.01) / (0.05 - 0.01))
    WHEN u <= 0.5 THEN p05 + (p50 - p05) * ((u - 0.05) / (0.5 - 0.05)) WHEN u <= 0.95 THEN p50 + (p95 - p50) * ((u - 0.5) / (0.95 - 0.5))
    WHEN u <= 0.99 THEN p95 + (p99 - p95) * ((u - 0.95) / (0.99 - 0.95)) ELSE p99 END"""


@query(
    "synth_quantile_value",
    f"SELECT row_id, round({INTERP}, 6) AS value FROM (SELECT row_id, family_id, {u('row_id', 'value', SEED)} AS u FROM points) JOIN quantiles USING (family_id)",
)
def _(spark, d):
    p = t.points(spark, d)
    return p.select("row_id", *FAM).join(quantile_frame(p), FAM).select(
        "row_id", synth.quantile_value(uniform(SEED, c("row_id"), "value")).alias("value")
    )


@query(
    "synth_lognormal",
    f"""SELECT row_id, round(exp(mu + sigma * sqrt(-2 * ln(greatest({u('row_id', 'ln:r', SEED)}, 1 / 4503599627370496.0))) * cos(2 * pi() * {u('row_id', 'ln:a', SEED)})), 6) AS value
        FROM points JOIN (SELECT family_id, avg(ln(value)) AS mu, stddev_pop(ln(value)) AS sigma FROM points GROUP BY family_id) USING (family_id)""",
)
def _(spark, d):
    p = t.points(spark, d)
    params = fit.parameters(C.value_counts(p, FAM, "value"), FAM)
    return p.select("row_id", *FAM).join(params.select(*FAM, "mu", "sigma"), FAM).select(
        "row_id", log_normal(SEED, c("row_id"), "ln", c("mu"), c("sigma")).alias("value")
    )


@query(
    "synth_exponential",
    f"""SELECT row_id, round(-ln(greatest(1 - {u('row_id', 'exp', SEED)}, 1 / 4503599627370496.0)) / rate, 6) AS value
        FROM points JOIN (SELECT family_id, 1 / avg(value) AS rate FROM points GROUP BY family_id) USING (family_id)""",
)
def _(spark, d):
    p = t.points(spark, d)
    params = fit.parameters(C.value_counts(p, FAM, "value"), FAM).select(*FAM, "rate")
    return p.select("row_id", *FAM).join(params, FAM).select(
        "row_id", exponential(uniform(SEED, c("row_id"), "exp"), c("rate")).alias("value")
    )


@query(
    "synth_uniform",
    f"SELECT row_id, round(lo + {u('row_id', 'uni', SEED)} * (hi - lo), 6) AS value FROM points JOIN (SELECT family_id, min(value) AS lo, max(value) AS hi FROM points GROUP BY family_id) USING (family_id)",
)
def _(spark, d):
    p = t.points(spark, d)
    ends = p.groupBy(*FAM).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return p.select("row_id", *FAM).join(ends, FAM).select(
        "row_id", (c("lo") + uniform(SEED, c("row_id"), "uni") * (c("hi") - c("lo"))).alias("value")
    )


@query(
    "synth_linear",
    "SELECT row_id, CAST(1.0 + 0.5 * (ts - t0) AS DOUBLE) AS value FROM points JOIN (SELECT family_id, min(ts) AS t0 FROM points GROUP BY family_id) USING (family_id)",
)
def _(spark, d):
    p = t.points(spark, d)
    start = p.groupBy(*FAM).agg(F.min("ts").alias("t0"))
    return p.select("row_id", "ts", *FAM).join(start, FAM).select("row_id", (1.0 + 0.5 * (c("ts") - c("t0"))).alias("value"))


@query("synth_pattern_string", "SELECT row_id, true AS matches FROM points")
def _(spark, d):
    """A string per point from the general pattern of its source; it must match that pattern."""
    pattern = patterns.generalize(c("source"))
    made = t.points(spark, d).select("row_id", pattern.alias("pattern")).select(
        "row_id", "pattern", synth.expand_pattern(c("pattern"), SEED, c("row_id")).alias("text")
    )
    return made.select("row_id", F.expr("text RLIKE concat('^', pattern, '$')").alias("matches"))


def family_samplers(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per family (metric, flags, quantiles, tag keys with presence), and all counts per dimension."""
    dims = materialize(D.dim_counts(p, FAM), "dims")
    base = p.groupBy(*FAM, "metric").agg(F.count("*").alias("samples"), F.bool_or("is_delta").alias("is_delta"))
    keys = synth.tag_keys(D.tag_schema(dims, base, FAM), FAM)
    return materialize(base.join(quantile_frame(p), FAM).join(keys, FAM, "left"), "samplers"), dims


def day_budget(p: DataFrame, multiplier: float = 1.0, burst: float | None = None) -> DataFrame:
    """One synthetic day at ``multiplier`` times the average daily volume."""
    curve = temporal.dense_curve(temporal.curve_points(temporal.minute_counts(p, FAM), FAM), FAM)
    base = p.groupBy(*FAM).agg((F.count("*") / (F.countDistinct(F.floor(c("ts") / 86400)) * 1440.0)).alias("base_rate"))
    return synth.row_budget(curve, base, FAM, SEED, F.lit(multiplier), None if burst is None else F.lit(burst))


def synthetic(spark, d, multiplier: float = 1.0) -> DataFrame:
    p = t.points(spark, d)
    return synth.points(day_budget(p, multiplier), *family_samplers(p), FAM, SEED, DAY0)


BUDGET_SQL = f"""
    curve AS (SELECT g.family_id, g.mod, coalesce(n, 0) * 1440.0 / total AS rate, base_rate FROM
         (SELECT family_id, count(*) AS total, count(*) / (count(DISTINCT ts // 86400) * 1440.0) AS base_rate, unnest(range(1440)) AS mod FROM points GROUP BY family_id) g LEFT JOIN
         (SELECT family_id, ts % 86400 // 60 AS mod, count(*) AS n FROM points GROUP BY ALL) p ON p.family_id = g.family_id AND p.mod = g.mod),
    cell AS (SELECT *, {u("family_id || '|' || mod", 'round', SEED)} AS ur, {u("family_id || '|' || mod", 'burst', SEED)} AS ub, {u("family_id || '|' || mod", 'burst-size', SEED)} AS us FROM curve)"""


@query(
    "synth_row_budget",
    f"WITH {BUDGET_SQL} SELECT family_id, mod, CAST(floor(x) + CASE WHEN ur < x - floor(x) THEN 1 ELSE 0 END AS BIGINT) AS rows FROM (SELECT *, base_rate * rate * 1.0 AS x FROM cell)",
)
def _(spark, d):
    return day_budget(t.points(spark, d)).select(*FAM, "mod", "rows")


@query(
    "synth_burst",
    f"WITH {BUDGET_SQL} SELECT family_id, mod, round(base_rate * CASE WHEN ub < 0.1 THEN rate * (1 + 4.0 * us) ELSE rate END, 6) AS expected FROM cell",
)
def _(spark, d):
    return day_budget(t.points(spark, d), burst=5.0).select(*FAM, "mod", "expected")


@query(
    "synth_tag_skew",
    """SELECT family_id, dim, value, round(power(f, 2.0) / sum(power(f, 2.0)) OVER (PARTITION BY family_id, dim), 6) AS skewed FROM (
         SELECT family_id, dim, value, n / sum(n) OVER (PARTITION BY family_id, dim) AS f FROM dimcounts)""",
)
def _(spark, d):
    """Shares of all values of a dimension, sharpened by an exponent."""
    keys = [*FAM, "dim"]
    shares = V.shares(D.dim_counts(t.points(spark, d), FAM), keys)
    return synth.skewed(shares, keys, F.lit(2.0), "p").select(*keys, "value", "skewed")


def item_sql(table: str, key: str, value: str) -> str:
    """Item table of a weighted pick: running and total weight of all values, in the order of their md5."""
    return f"""(SELECT {key} AS key, {value} AS value, n, rank, sum(n) OVER (PARTITION BY {key} ORDER BY rank) AS cum, sum(n) OVER (PARTITION BY {key}) AS total
      FROM (SELECT {key}, {value}, n, row_number() OVER (PARTITION BY {key} ORDER BY md5({value}), {value}) AS rank FROM {table}))"""


PICK_ON = "i.cum >= p.u * i.total AND (i.cum - i.n < p.u * i.total OR i.rank = 1)"


def named_draw(row: str, name: str) -> str:
    """SQL text of a uniform draw whose dimension is an expression."""
    return f"(('0x' || substr(md5('{SEED}|' || {row} || '|' || {name}), 1, 13))::UBIGINT / 4503599627370496.0)"


DRAWN_SQL = """
    drawn AS (SELECT family_id, mod, family_id || '|' || mod || '|' || i AS row_key FROM (SELECT family_id, mod, unnest(range(CAST(floor(x) + CASE WHEN ur < x - floor(x) THEN 1 ELSE 0 END AS BIGINT))) AS i
      FROM (SELECT *, base_rate * rate * 1.0 AS x FROM cell)))"""


@query(
    "synth_source",
    f"""WITH {BUDGET_SQL}, {ALLITEMS}, {DRAWN_SQL}
        SELECT p.family_id, i.value AS source, count(*) AS n FROM (SELECT *, {u('row_key', 'source', SEED)} AS u FROM drawn) p
        JOIN items i ON i.family_id = p.family_id AND {PICK_ON} GROUP BY ALL""",
)
def _(spark, d):
    return synthetic(spark, d).groupBy(*FAM, "source").agg(F.count("*").alias("n"))


TAG_SQL = f"""
    presence AS (SELECT family_id, key, count(*) * 1.0 / any_value(total) AS presence FROM ptags JOIN (SELECT family_id, n AS total FROM famcounts) USING (family_id) GROUP BY family_id, key),
    chosen AS (SELECT d.family_id, d.row_key, q.key, d.family_id || chr(1) || q.key AS fk, {named_draw("d.row_key", "'tag:' || q.key")} AS u
      FROM drawn d JOIN presence q USING (family_id) WHERE {named_draw("d.row_key", "'has:' || q.key")} < presence)"""
TAG_ITEMS = item_sql("(SELECT family_id || chr(1) || key AS fk, value, count(*) AS n FROM ptags GROUP BY ALL)", "fk", "value")


@query(
    "synth_tags",
    f"""WITH {BUDGET_SQL}, {DRAWN_SQL}, {TAG_SQL}
        SELECT p.family_id, p.key, i.value, count(*) AS n FROM chosen p JOIN {TAG_ITEMS} i ON i.key = p.fk AND {PICK_ON} GROUP BY ALL""",
)
def _(spark, d):
    """Tags of a synthetic day, drawn from all values of each key."""
    return synthetic(spark, d).select(*FAM, F.explode("tags").alias("key", "value")).groupBy(*FAM, "key", "value").agg(F.count("*").alias("n"))


COMBO_SQL = "(SELECT family_id, coalesce('env=' || env || ',', '') || 'k=' || k AS text, count(*) AS n FROM points GROUP BY ALL)"


@query(
    "synth_tag_combination",
    f"""SELECT p.row_id, i.value AS tags FROM (SELECT *, {u('row_id', 'combo', SEED)} AS u FROM points) p
        JOIN {item_sql(COMBO_SQL, 'family_id', 'text')} i ON i.key = p.family_id AND {PICK_ON}""",
)
def _(spark, d):
    """Whole tag sets drawn by frequency."""
    p = t.points(spark, d)
    combos = D.tag_combinations(p, FAM).withColumn(
        "text", F.array_join(F.transform("combo", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    )
    rows = p.select("row_id", *FAM, uniform(SEED, c("row_id"), "combo").alias("u"))
    return synth.draw_values(rows, combos.select(*FAM, "text", "n"), FAM, "text", "u", "tags").select("row_id", "tags")


RATE_SQL = "(SELECT metric, source, count(*) AS n FROM points GROUP BY ALL)"


@query(
    "synth_entity",
    f"""SELECT p.row_id, p.metric, i.value AS source FROM (SELECT *, {u('row_id', 'entity', SEED)} AS u FROM points) p
        JOIN {item_sql(RATE_SQL, 'metric', 'source')} i ON i.key = p.metric AND {PICK_ON}""",
)
def _(spark, d):
    """Sources drawn by their rate within the whole capture."""
    p = t.points(spark, d)
    rates = p.groupBy("metric", "source").agg(F.count("*").alias("n"))
    rows = p.select("row_id", "metric", uniform(SEED, c("row_id"), "entity").alias("u"))
    return synth.draw_values(rows, rates, ["metric"], "source", "u", "source").select("row_id", "metric", "source")


@query("synth_arrival_times")
def _(spark, d):
    """Offsets inside the minute for the three arrival kinds."""
    budget = day_budget(t.points(spark, d), 4.0).select(*FAM, "mod", "rows")
    rows = materialize(C.spread_sequence(budget, [*FAM, "mod"], "rows", "i").select(*FAM, "mod", "i"), "arrivals")
    out = None
    for kind in ("uniform", "poisson", "bursty"):
        part = synth.arrival_offsets(rows, FAM, SEED, kind).select(F.lit(kind).alias("kind"), *FAM, "mod", "i", "offset")
        out = part if out is None else out.unionByName(part)
    return out


ARRIVAL_SQL = f"""WITH {BUDGET_SQL}
    SELECT kind, family_id, mod, n, true AS in_range, true AS in_order FROM (
      SELECT family_id, mod, CAST(floor(x) + CASE WHEN ur < x - floor(x) THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT *, base_rate * rate * 4.0 AS x FROM cell)),
      (SELECT unnest(['uniform', 'poisson', 'bursty']) AS kind) WHERE n > 0"""


@query("synth_arrival_invariants", ARRIVAL_SQL)
def _(spark, d):
    """Each minute has the rows of its budget, within the minute; accumulated gaps keep their order."""
    budget = day_budget(t.points(spark, d), 4.0).select(*FAM, "mod", "rows")
    rows = materialize(C.spread_sequence(budget, [*FAM, "mod"], "rows", "i").select(*FAM, "mod", "i"), "arrivals")
    out = None
    for kind in ("uniform", "poisson", "bursty"):
        part = synth.arrival_offsets(rows, FAM, SEED, kind).withColumn("kind", F.lit(kind))
        out = part.select("kind", *FAM, "mod", "i", "offset") if out is None else out.unionByName(part.select("kind", *FAM, "mod", "i", "offset"))
    # neighbours meet by an equi join on the row number
    after = out.select("kind", *FAM, "mod", (c("i") - 1).alias("i"), c("offset").alias("next"))
    pairs = out.join(after, ["kind", *FAM, "mod", "i"], "left")
    ordered = (c("kind") == "uniform") | c("next").isNull() | (c("next") >= c("offset"))
    return pairs.groupBy("kind", *FAM, "mod").agg(
        F.count("*").alias("n"), F.bool_and((c("offset") >= 0) & (c("offset") < 60)).alias("in_range"), F.bool_and(ordered).alias("in_order")
    )


POINT_SQL = f"""WITH {BUDGET_SQL}
    SELECT family_id, CAST(sum(n) AS BIGINT) AS n, true AS own_day, true AS known_sources, true AS values_in_range FROM (
      SELECT family_id, CAST(floor(x) + CASE WHEN ur < x - floor(x) THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT *, base_rate * rate * 1.0 AS x FROM cell))
    WHERE n > 0 GROUP BY family_id"""


@query("synth_point_invariants", POINT_SQL)
def _(spark, d):
    """Drawn points: as many as budgeted, on the day, with sources and values of their family."""
    made = synthetic(spark, d).select(*FAM, "ts", "source", "value")
    p = t.points(spark, d)
    known = p.select(*FAM, "source").distinct().withColumn("known", F.lit(True))
    ends = p.groupBy(*FAM).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return made.join(known, [*FAM, "source"], "left").join(ends, FAM).groupBy(*FAM).agg(
        F.count("*").alias("n"), F.bool_and((c("ts") >= DAY0) & (c("ts") < DAY0 + 86400)).alias("own_day"),
        F.bool_and(c("known").isNotNull()).alias("known_sources"), F.bool_and((c("value") >= c("lo")) & (c("value") <= c("hi"))).alias("values_in_range"),
    )


@query("synth_metric_points")
def _(spark, d):
    s = synthetic(spark, d)
    line = formats.fmt_metric_line(c("metric"), formats.fmt_value(c("value")), c("ts"), c("source"), c("tags"), c("is_delta"))
    return s.select("row_key", "value", "ts", line.alias("line"))


@query(
    "synth_histogram_points",
    f"""SELECT row_id, CASE WHEN g < 0.2 THEN 'H' WHEN g < 0.24 THEN 'D' ELSE 'M' END AS granularity, CAST(10 + floor({u('row_id', 'count', SEED)} * 90) AS BIGINT) AS hist_count,
          CAST(1 + floor({u('row_id', 'centroids', SEED)} * 5) AS BIGINT) AS centroids, true AS adds_up
        FROM (SELECT *, {u('row_id', 'granularity', SEED)} AS g FROM points) WHERE {u('row_id', 'hist', SEED)} < 0.1""",
)
def _(spark, d):
    """One point in ten becomes a histogram."""
    p = t.points(spark, d).filter(uniform(SEED, c("row_id"), "hist") < synth.HISTOGRAM_CHANCE)
    h = synth.histogram_rows(p.select("row_id", c("row_id").alias("row_key"), "ts"), SEED)
    total = F.aggregate("centroids", F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
    return h.select("row_id", "granularity", "hist_count", F.size("centroids").alias("centroids"), (total == c("hist_count")).alias("adds_up"))


@query(
    "synth_spans",
    f"""SELECT row_id, start_ms // 1000 * 1000 + CAST(floor({u('row_id', 'ms', SEED)} * 1000) AS BIGINT) AS start_ms,
          CAST(floor(-ln(greatest(1 - {u('row_id', 'duration', SEED)}, 1 / 4503599627370496.0)) / 0.001) AS BIGINT) + 1 AS duration_ms FROM spans""",
)
def _(spark, d):
    s = t.spans(spark, d).select("row_id", c("row_id").alias("row_key"), F.floor(c("start_ms") / 1000).alias("ts"))
    return synth.span_rows(s, SEED).select("row_id", "start_ms", "duration_ms")


@query(
    "synth_schema_drift",
    f"""SELECT row_id, hit AND {u('row_id', 'drift-add', SEED)} < 0.5 AS gained, hit AND {u('row_id', 'drift-change', SEED)} < 0.3 AS changed
        FROM (SELECT *, {u('row_id', 'drift', SEED)} < 0.3 AS hit FROM points)""",
)
def _(spark, d):
    drifted = t.points(spark, d).select("row_id", "tags", synth.drift_tags(c("tags"), F.lit(0.3), SEED, c("row_id")).alias("now"))
    return drifted.select(
        "row_id",
        F.exists(F.map_keys("now"), lambda k: k.startswith("drift_tag_")).alias("gained"),
        F.exists(F.map_values("now"), lambda v: v.startswith("drift_")).alias("changed"),
    )


@query(
    "synth_error_lines",
    "SELECT row_id, mode, value FROM badlines",
)
def _(spark, d):
    return t.bad_lines(spark, d).select("row_id", "mode", "value")


SCENARIO_SQL = """(SELECT c_custkey AS scenario_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, c_acctbal / 1000 AS multiplier,
    c_nationkey - 2 AS partitions, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE '/out/' || c_mktsegment END AS output_path FROM customer)"""


def scenarios(spark, d) -> DataFrame:
    cu = t.table(spark, d, "customer")
    return cu.select(
        c("c_custkey").alias("scenario_id"),
        F.when(c("c_custkey") % 11 == 0, "").otherwise(c("c_name")).alias("name"),
        (c("c_acctbal") / 1000).alias("multiplier"),
        (c("c_nationkey") - 2).alias("partitions"),
        F.when(c("c_mktsegment") != "BUILDING", F.concat(F.lit("/out/"), "c_mktsegment")).alias("output_path"),
    )


@query(
    "scenario_validate",
    f"""SELECT scenario_id, 'name_required' AS rule FROM {SCENARIO_SQL} WHERE name = ''
        UNION ALL SELECT scenario_id, 'multiplier_not_positive' FROM {SCENARIO_SQL} WHERE multiplier <= 0
        UNION ALL SELECT scenario_id, 'partitions_not_positive' FROM {SCENARIO_SQL} WHERE partitions <= 0
        UNION ALL SELECT scenario_id, 'output_path_required' FROM {SCENARIO_SQL} WHERE output_path IS NULL""",
)
def _(spark, d):
    return synth.scenario_violations(scenarios(spark, d))


@query(
    "scenario_apply",
    """SELECT f.family_id, s.name, round(s.multiplier, 6) AS multiplier, round(f.n * s.multiplier, 6) AS target_rows
       FROM famcounts f JOIN (SELECT 'load-' || event_type AS name, 'app.' || event_type AS metric, avg(value) / 100 AS multiplier FROM events GROUP BY event_type) s ON s.metric = f.metric""",
)
def _(spark, d):
    e = t.table(spark, d, "events")
    sc = e.groupBy("event_type").agg((F.avg("value") / 100).alias("multiplier")).select(
        F.concat(F.lit("load-"), "event_type").alias("name"), F.concat(F.lit("app."), "event_type").alias("pattern"), "multiplier"
    )
    families = t.points(spark, d).groupBy(*FAM, "metric").agg(F.count("*").alias("n"))
    return synth.match_globs(families, "metric", sc, "pattern").select(
        *FAM, "name", "multiplier", (c("n") * c("multiplier")).alias("target_rows")
    )
