"""Queries: distributions, patterns, temporal statistics and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators import counts as C
from metricloom.operators import dims as D
from metricloom.operators import fit, patterns, temporal
from metricloom.plans import recipe
from metricloom.plans.catalog import query
from metricloom.session import materialize, work_dir
from metricloom.sources import recipes as store
from metricloom.sources import tables as t

c = F.col
FAM = ["family_id"]

CAT_SQL = """
    SELECT family_id, {key} rank, value, n, round(n / total, 6) AS frequency, distinct_count, round(entropy, 6) AS entropy FROM (
      SELECT *, row_number() OVER (PARTITION BY family_id, dim ORDER BY n DESC, value) AS rank,
        sum(n) OVER (PARTITION BY family_id, dim) AS total, count(*) OVER (PARTITION BY family_id, dim) AS distinct_count,
        log2(sum(n) OVER (PARTITION BY family_id, dim)) - sum(n * log2(n)) OVER (PARTITION BY family_id, dim) / sum(n) OVER (PARTITION BY family_id, dim) AS entropy
      FROM dimcounts) WHERE rank <= 100 AND {where}"""


@query("dist_categorical_source", CAT_SQL.format(key="", where="dim = 'source'"))
def _(spark, d):
    counts = D.dim_counts(t.points(spark, d), FAM).filter(c("dim") == D.SOURCE)
    return D.categorical(counts, [*FAM, "dim"]).drop("dim")


@query("dist_categorical_tags", CAT_SQL.format(key="substr(dim, 5) AS key,", where="dim <> 'source'"))
def _(spark, d):
    counts = D.tag_only(D.dim_counts(t.points(spark, d), FAM))
    return D.categorical(counts.drop("dim"), [*FAM, "key"])


@query(
    "dist_quantiles",
    "SELECT family_id, round(p01, 6) AS p01, round(p05, 6) AS p05, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM quantiles",
)
def _(spark, d):
    return C.exact_quantiles(C.value_counts(t.points(spark, d), FAM, "value"), FAM, "value")


@query(
    "dist_moments",
    "SELECT family_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, min(value) AS min, max(value) AS max FROM points GROUP BY family_id",
)
def _(spark, d):
    return C.moments(C.value_counts(t.points(spark, d), FAM, "value"), FAM, "value")


@query(
    "dist_histogram_32",
    """SELECT g.family_id, g.bin, round(g.p01 + g.bin * (g.p99 - g.p01) / 32, 6) AS lo, round(g.p01 + (g.bin + 1) * (g.p99 - g.p01) / 32, 6) AS hi, coalesce(n, 0) AS n
       FROM (SELECT *, unnest(range(32)) AS bin FROM quantiles) g LEFT JOIN (
         SELECT family_id, CASE WHEN p99 <= p01 THEN 0 ELSE CAST(least(31, greatest(0, floor((value - p01) / ((p99 - p01) / 32)))) AS BIGINT) END AS bin, count(*) AS n
         FROM points JOIN quantiles USING (family_id) GROUP BY ALL) h ON g.family_id = h.family_id AND g.bin = h.bin""",
)
def _(spark, d):
    counts = C.value_counts(t.points(spark, d), FAM, "value")
    q = C.exact_quantiles(counts, FAM, "value")
    return C.dense_bins(C.histogram_bins(counts, q, FAM, "value"), q, FAM)


@query(
    "dist_payload_size",
    """SELECT family_id, round(avg(line_length), 6) AS mean, round(stddev_samp(line_length), 6) AS stddev, min(line_length)::DOUBLE AS min, max(line_length)::DOUBLE AS max,
         round(quantile_cont(line_length::DOUBLE, 0.01), 6) AS p01, round(quantile_cont(line_length::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(line_length::DOUBLE, 0.99), 6) AS p99
       FROM points GROUP BY family_id""",
)
def _(spark, d):
    counts = C.value_counts(t.points(spark, d), FAM, "line_length")
    q = C.exact_quantiles(counts, FAM, "line_length").select("family_id", "p01", "p50", "p99")
    return C.moments(counts, FAM, "line_length").drop("n").join(q, FAM)


ERF = """(sign({x}) * (1.0 - (1.0/(1.0+0.3275911*abs({x}))) * (0.254829592 + (1.0/(1.0+0.3275911*abs({x}))) * (-0.284496736
  + (1.0/(1.0+0.3275911*abs({x}))) * (1.421413741 + (1.0/(1.0+0.3275911*abs({x}))) * (-1.453152027 + (1.0/(1.0+0.3275911*abs({x}))) * 1.061405429)))) * exp(-({x})*({x}))))"""


@query(
    "dist_parametric_fit",
    f"""WITH par AS (
          SELECT family_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, avg(ln(value)) AS mu, stddev_pop(ln(value)) AS sigma,
            1 / avg(value) AS rate, avg(value) ** 2 / var_pop(value) AS shape, var_pop(value) / avg(value) AS scale FROM points GROUP BY family_id),
        cum AS (
          SELECT family_id, value, sum(n) OVER w / sum(n) OVER (PARTITION BY family_id) AS f_at, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY family_id) AS f_below
          FROM (SELECT family_id, value, count(*) AS n FROM points GROUP BY ALL) WINDOW w AS (PARTITION BY family_id ORDER BY value)),
        cdf AS (
          SELECT family_id, f_at, f_below, 0.5 * (1 + {ERF.format(x='zn')}) AS c_n, 0.5 * (1 + {ERF.format(x='zl')}) AS c_l, c_e FROM (
            SELECT family_id, f_at, f_below, (value - mean) / std / sqrt(2) AS zn, (ln(value) - mu) / sigma / sqrt(2) AS zl, 1 - exp(-rate * value) AS c_e
            FROM cum JOIN par USING (family_id))),
        fitted AS (
          SELECT family_id, max(greatest(abs(f_at - c_n), abs(c_n - f_below))) AS ks_normal, max(greatest(abs(f_at - c_l), abs(c_l - f_below))) AS ks_log_normal,
            max(greatest(abs(f_at - c_e), abs(c_e - f_below))) AS ks_exponential FROM cdf GROUP BY family_id)
        SELECT family_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mu, 6) AS mu, round(sigma, 6) AS sigma, round(rate, 6) AS rate,
          round(shape, 6) AS shape, round(scale, 6) AS scale, round(ks_normal, 6) AS ks_normal, round(ks_log_normal, 6) AS ks_log_normal, round(ks_exponential, 6) AS ks_exponential
        FROM par JOIN fitted USING (family_id)""",
)
def _(spark, d):
    counts = C.value_counts(t.points(spark, d), FAM, "value")
    params = fit.parameters(counts, FAM)
    return params.join(fit.ks_statistics(counts, params, FAM, ["normal", "log_normal", "exponential"]), FAM)


@query("dist_parametric_best")
def _(spark, d):
    """All four families with their p-value; the gamma CDF has no SQL twin."""
    counts = C.value_counts(t.points(spark, d), FAM, "value")
    params = fit.parameters(counts, FAM)
    best = fit.best_fit(params, fit.ks_statistics(counts, params, FAM), FAM)
    return best.select("family_id", "type", F.to_json("parameters").alias("parameters"), "ks_statistic", "ks_p_value")


@query(
    "tag_cooccurrence",
    """SELECT family_id, rank, key_a, value_a, key_b, value_b, n, round(n / samples, 6) AS frequency FROM (
         SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY n DESC, concat_ws(chr(1), key_a, value_a, key_b, value_b)) AS rank FROM (
           SELECT family_id, 'env' AS key_a, env AS value_a, 'k' AS key_b, k AS value_b, count(*) AS n FROM points WHERE env IS NOT NULL GROUP BY ALL))
       JOIN (SELECT family_id, n AS samples FROM famcounts) USING (family_id) WHERE rank <= 100""",
)
def _(spark, d):
    p = t.points(spark, d)
    combos = D.tag_combinations(p, FAM)
    pairs = D.tag_pairs(combos, FAM).withColumn("pair", F.concat_ws("\u0001", "key_a", "value_a", "key_b", "value_b"))
    samples = combos.groupBy(*FAM).agg(F.sum("n").alias("samples"))
    return C.top_k(pairs, FAM, "pair", recipe.TOP_PAIRS).join(samples, FAM).select(
        *FAM, "rank", "key_a", "value_a", "key_b", "value_b", "n", (c("n") / c("samples")).alias("frequency")
    )


@query(
    "tag_combination_full",
    "SELECT family_id, coalesce('env=' || env || ',', '') || 'k=' || k AS combo, count(*) AS n FROM points GROUP BY ALL",
)
def _(spark, d):
    combos = D.tag_combinations(t.points(spark, d), FAM)
    text = F.array_join(F.transform("combo", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return combos.select(*FAM, text.alias("combo"), "n")


@query(
    "intensity_curve",
    """SELECT g.family_id, g.mod, round(coalesce(n, 0) * 1440.0 / total, 6) AS rate FROM
         (SELECT family_id, n AS total, unnest(range(1440)) AS mod FROM famcounts) g LEFT JOIN
         (SELECT family_id, ts % 86400 // 60 AS mod, count(*) AS n FROM points GROUP BY ALL) p ON p.family_id = g.family_id AND p.mod = g.mod""",
)
def _(spark, d):
    minutes = temporal.minute_counts(t.points(spark, d), FAM)
    return temporal.dense_curve(temporal.curve_points(minutes, FAM), FAM)


@query(
    "burstiness",
    """SELECT family_id, minutes, round(sqrt(var) / mean, 6) AS cv_counts, round(var / mean, 6) AS fano_factor FROM (
         SELECT family_id, minutes, s / minutes AS mean, greatest(q / minutes - (s / minutes) ** 2, 0) AS var FROM (
           SELECT family_id, CAST((max(minute) - min(minute)) // 60 + 1 AS BIGINT) AS minutes, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n * n) AS DOUBLE) AS q FROM minutes GROUP BY family_id))""",
)
def _(spark, d):
    return temporal.burstiness(temporal.minute_counts(t.points(spark, d), FAM), FAM)


GAPS_SQL = "SELECT family_id, ts - lag(ts) OVER (PARTITION BY family_id ORDER BY ts) AS gap FROM points"


@query(
    "interarrival_cv",
    f"SELECT family_id, count(gap) AS gaps, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap) / avg(gap), 6) AS cv_interarrival FROM ({GAPS_SQL}) GROUP BY family_id",
)
def _(spark, d):
    return temporal.gap_cv(temporal.gap_counts(t.points(spark, d), FAM), FAM)


@query(
    "histogram_cadence",
    """SELECT family_id, granularity, round(quantile_cont(gap, 0.5), 6) AS cadence_seconds FROM (
         SELECT sha1('sales.quantity|') AS family_id, 'D' AS granularity, CAST(ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) AS DOUBLE) AS gap FROM hists)
       WHERE gap IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return recipe.cadence(t.histograms(spark, d), FAM)


GENERAL = r"replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([\\.^$|?*+()\[\]{{}}])', '\\\1', 'g'), '[A-Z]+', chr(1), 'g'), '[a-z]+', chr(2), 'g'), '[0-9]+', chr(3), 'g'), chr(1), '[A-Z]+'), chr(2), '[a-z]+'), chr(3), '\d+')"


@query(
    "pattern_generalize",
    f"SELECT line, {GENERAL.format(x='line')} AS pattern FROM (SELECT DISTINCT line FROM points)",
)
def _(spark, d):
    return t.metric_lines(spark, d).select(c("value").alias("line")).distinct().select("line", patterns.generalize(c("line")).alias("pattern"))


MINE_SQL = """
    SELECT family_id, {key} rank, pattern, CAST(n AS BIGINT) AS n, round(n / total, 6) AS frequency FROM (
      SELECT family_id, dim, pattern, n, row_number() OVER (PARTITION BY family_id, dim ORDER BY n DESC, pattern) AS rank, sum(n) OVER (PARTITION BY family_id, dim) AS total
      FROM (SELECT family_id, dim, """ + GENERAL.format(x="value").replace("{", "{{").replace("}", "}}") + """ AS pattern, sum(n) AS n FROM dimcounts GROUP BY ALL)) WHERE rank <= 5 AND {where}"""


@query("pattern_mine_source", MINE_SQL.format(key="", where="dim = 'source'"))
def _(spark, d):
    counts = D.dim_counts(t.points(spark, d), FAM).filter(c("dim") == D.SOURCE)
    return patterns.mine(counts, FAM)


@query("pattern_mine_tags", MINE_SQL.format(key="substr(dim, 5) AS key,", where="dim <> 'source'"))
def _(spark, d):
    return patterns.mine(D.tag_only(D.dim_counts(t.points(spark, d), FAM)), [*FAM, "key"])


@query(
    "pattern_char_ngrams",
    """SELECT family_id, size, gram, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT family_id, size, n, substr(value, i, size) AS gram FROM (
           SELECT family_id, size, n, value, unnest(range(1, greatest(length(value) - size + 2, 1))) AS i
           FROM dimcounts, (SELECT unnest([1, 2, 3])::BIGINT AS size) WHERE dim = 'source')) GROUP BY ALL""",
)
def _(spark, d):
    counts = D.dim_counts(t.points(spark, d), FAM).filter(c("dim") == D.SOURCE)
    out = None
    for size in (1, 2, 3):
        part = patterns.ngrams(counts, FAM, size).select(*FAM, F.lit(size).alias("size"), "gram", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "pattern_lengths",
    """SELECT family_id, dim, round(quantile_cont(len, 0.5), 6) AS p50, round(quantile_cont(len, 0.99), 6) AS p99, round(avg(len), 6) AS mean, min(len) AS min, max(len) AS max
       FROM (SELECT family_id, dim, CAST(length(value) AS DOUBLE) AS len FROM dims) GROUP BY ALL""",
)
def _(spark, d):
    keys = [*FAM, "dim"]
    lengths = patterns.length_counts(D.dim_counts(t.points(spark, d), FAM), keys)
    q = C.exact_quantiles(lengths, keys, "length", {"p50": 0.5, "p99": 0.99})
    return q.join(C.moments(lengths, keys, "length").select(*keys, "mean", "min", "max"), keys)


@query(
    "constraints",
    """SELECT family_id, key, count(DISTINCT value) AS max_cardinality, count(*) = any_value(n) AS required
       FROM ptags JOIN famcounts USING (family_id) GROUP BY ALL""",
)
def _(spark, d):
    p = t.points(spark, d)
    families = p.groupBy("family_id").agg(F.count("*").alias("samples"))
    s = D.tag_schema(D.dim_counts(p, FAM), families, FAM)
    return s.select(*FAM, "key", c("cardinality").alias("max_cardinality"), (c("presence") == 1.0).alias("required"))


CORR_SQL = """
    SELECT family_id, CASE WHEN vx > 0 AND vy > 0 THEN cov / (sqrt(vx) * sqrt(vy)) END AS corr FROM (
      SELECT family_id, 1440 * sum(x * y) - sum(x) * sum(y) AS cov, 1440 * sum(x * x) - sum(x) ** 2 AS vx, 1440 * sum(y * y) - sum(y) ** 2 AS vy FROM (
        SELECT family_id, ts % 86400 // 60 AS mod, CAST(count(*) FILTER (ts < epoch(TIMESTAMP '2024-01-16')) AS DOUBLE) AS x,
          CAST(count(*) FILTER (ts >= epoch(TIMESTAMP '2024-01-16')) AS DOUBLE) AS y FROM points GROUP BY ALL) GROUP BY family_id)"""


@query(
    "fitness_scores",
    f"""WITH knots AS (SELECT family_id, unnest(v) AS q, unnest([0.01, 0.05, 0.5, 0.95, 0.99]) AS p FROM rq),
        kv AS (SELECT family_id, greatest(0.0, max(greatest(p - f_at, f_below - p))) AS ks FROM (
          SELECT k.family_id, p, avg(CASE WHEN c.value <= q THEN 1.0 ELSE 0 END) AS f_at, avg(CASE WHEN c.value < q THEN 1.0 ELSE 0 END) AS f_below
          FROM knots k JOIN curs c ON c.family_id = k.family_id GROUP BY k.family_id, p, q) GROUP BY family_id)
        SELECT j.family_id, round(js_categorical, 6) AS categorical_js_divergence, round(ks, 6) AS numeric_ks_statistic, round(corr, 6) AS temporal_correlation
        FROM jsfam j JOIN kv USING (family_id) LEFT JOIN ({CORR_SQL}) USING (family_id)""",
)
def _(spark, d):
    return recipe.fitness(materialize(recipe.day_counts(t.points(spark, d)), "day-counts"), t.split_epoch())


# --- recipes ----------------------------------------------------------------------------------


def recipe_path(spark, d) -> str:
    """Recipes of the points, written to a new folder."""
    path = work_dir(spark, "recipes")
    store.sink_recipes(recipe.assemble(t.points(spark, d), t.split_epoch()), path)
    return path


def stored_recipes(spark, d) -> DataFrame:
    return store.scan_recipes(spark, recipe_path(spark, d))


RECIPE_SQL = """WITH bm AS (SELECT family_id, sum(n) AS s, sum(n * n) AS q, (max(minute) - min(minute)) / 60 + 1 AS m FROM minutes GROUP BY family_id)
       SELECT q.family_id, metric AS metric_name, f.n AS sample_count, bool_or(is_delta) AS is_delta, count(DISTINCT source) AS sources, round(any_value(p50), 6) AS p50,
         round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, min(value) AS low, max(value) AS high, round(quantile_cont(CAST(line_length AS DOUBLE), 0.5), 6) AS size_p50,
         round(entropy(source), 6) AS source_entropy, round((max(ts) - min(ts)) / 3600.0, 6) AS hours, list_sort(list(DISTINCT k))[1] AS first_k,
         round(any_value(sqrt(bm.q / bm.m - (bm.s / bm.m) ** 2) / (bm.s / bm.m)), 6) AS cv_counts, round(any_value((bm.q / bm.m - (bm.s / bm.m) ** 2) / (bm.s / bm.m)), 6) AS fano_factor,
         round(any_value(js_categorical), 6) AS js, count(DISTINCT k) AS k_values, any_value(CASE WHEN env IS NULL THEN 1 ELSE 2 END)::BIGINT AS tag_keys,
         1440::BIGINT AS curve_size, 1440.0::DOUBLE AS curve_sum, count(*) AS binned
       FROM points p JOIN quantiles q ON p.family_id = q.family_id JOIN (SELECT family_id, n FROM famcounts) f ON f.family_id = q.family_id
         JOIN bm ON bm.family_id = q.family_id JOIN jsfam ON jsfam.family_id = q.family_id GROUP BY q.family_id, metric, f.n"""


def recipe_leaves(r: DataFrame) -> DataFrame:
    """One column for some leaf of every block of a recipe."""
    num, stats = c("statistics.value_distribution"), c("statistics")
    k_values = c("statistics.tag_distributions")["k"]
    return r.select(
        "family_id", "metric_name", stats["sample_count"].alias("sample_count"), c("schema.is_delta").alias("is_delta"),
        c("generation.entity_hints.source_count_estimate").alias("sources"), num["quantiles"]["p50"].alias("p50"),
        num["mean"].alias("mean"), num["stddev"].alias("stddev"), num["min"].alias("low"), num["max"].alias("high"),
        c("payload.size_distribution.quantiles.p50").alias("size_p50"), stats["source_distribution"]["entropy"].alias("source_entropy"),
        c("capture_window.duration_hours").alias("hours"), F.array_min(F.transform(k_values["top_values"], lambda x: x["value"])).alias("first_k"),
        c("temporal.burstiness.coefficient_of_variation").alias("cv_counts"), c("temporal.burstiness.fano_factor").alias("fano_factor"),
        c("validation.fitness_scores.categorical_js_divergence").alias("js"),
        c("schema.tag_schema")["k"]["cardinality"].alias("k_values"), F.size("schema.tag_schema").alias("tag_keys"),
        F.size("temporal.intensity_curve").alias("curve_size"),
        F.aggregate("temporal.intensity_curve", F.lit(0.0), lambda a, x: a + x).alias("curve_sum"),
        F.aggregate(num["counts"], F.lit(0).cast("bigint"), lambda a, x: a + x).alias("binned"),
    )


@query("recipe_assemble", RECIPE_SQL)
def _(spark, d):
    return recipe_leaves(stored_recipes(spark, d))


@query("recipe_by_days", RECIPE_SQL)
def _(spark, d):
    """Recipes from a store of day counts to which three stretches of the capture were added one by one."""
    p, path = t.points(spark, d), work_dir(spark, "day-store")
    first, second = t.split_epoch() - 7 * 86400, t.split_epoch() + 3 * 86400
    for part in (c("ts") < first, (c("ts") >= first) & (c("ts") < second), c("ts") >= second):
        recipe.add_day(p.filter(part), path)
    return recipe_leaves(recipe.from_days(recipe.stored_days(spark, path), t.split_epoch()))


@query(
    "recipe_validate",
    "SELECT rule, checked, CASE rule WHEN 'duration_hours' THEN short ELSE 0 END AS violations FROM (SELECT count(*) AS checked, count(*) FILTER (hours < 0.1) AS short FROM (SELECT family_id, (max(ts) - min(ts)) / 3600 AS hours FROM points GROUP BY family_id)), (SELECT unnest(['version', 'family_id', 'metric_name', 'duration_hours', 'type', 'tag_keys', 'tag_types', 'presence', 'cardinality', 'sample_count', 'source_distribution', 'tag_distributions', 'intensity_curve', 'burstiness', 'entity_hints']) AS rule)",
)
def _(spark, d):
    return recipe.rule_report(stored_recipes(spark, d))


@query("scan_recipes", "SELECT family_id, metric AS metric_name, n AS sample_count FROM famcounts")
def _(spark, d):
    """Recipes through their JSON form."""
    path = work_dir(spark, "recipes-json")
    store.sink_recipes(stored_recipes(spark, d).drop("file_name", "loaded_at"), path, as_json=True)
    return store.scan_recipes(spark, path, as_json=True).select("family_id", "metric_name", c("statistics.sample_count").alias("sample_count"))


@query("sink_recipes", "SELECT family_id, metric AS metric_name, 'v1.0' AS version FROM famcounts")
def _(spark, d):
    return stored_recipes(spark, d).select("family_id", "metric_name", "version")


@query(
    "sink_recipe_index",
    """SELECT family_id, metric AS metric_name, 'metric' AS type, count(*) AS sample_count, CASE WHEN env IS NULL THEN 'k' ELSE 'env,k' END AS tag_keys,
         'prefix=' || substr(family_id, 1, 2) AS path FROM points GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY family_id, metric, env IS NULL, tag_keys"),
)
def _(spark, d):
    """The index is written, and every recipe is found again in the folder it names."""
    path, recipes = work_dir(spark, "recipe-index"), recipe_path(spark, d)
    index = store.recipe_index(store.scan_recipes(spark, recipes))
    index.write.parquet(path)
    there = spark.read.schema("family_id string, prefix string").parquet(recipes).withColumn("path", F.concat(F.lit("prefix="), "prefix"))
    return spark.read.schema(index.schema).parquet(path).join(there.select("family_id", "path"), ["family_id", "path"], "left_semi")


@query("sink_completion_marker", "SELECT count(*) AS recipes, 'complete' AS status FROM famcounts")
def _(spark, d):
    return store.completion_marker(spark, work_dir(spark, "marker"), stored_recipes(spark, d))


@query(
    "span_recipes",
    "SELECT family_id, operation AS metric_name, count(*) AS sample_count, round(quantile_cont(CAST(duration_ms AS DOUBLE), 0.5), 6) AS p50, count(DISTINCT source) AS sources FROM spans GROUP BY ALL",
)
def _(spark, d):
    r = recipe.span_recipes(t.spans(spark, d))
    return r.select(
        "family_id", "metric_name", c("statistics.sample_count").alias("sample_count"),
        c("statistics.span_distribution.duration_distribution.quantiles.p50").alias("p50"),
        c("generation.entity_hints.source_count_estimate").alias("sources"),
    )


@query(
    "recipe_histograms",
    """SELECT sha1('sales.quantity|') AS family_id, 1.0::DOUBLE AS daily_share, round(c.k50, 6) AS centroid_count_p50, round(v.v50, 6) AS centroid_value_p50, round(g.g50, 6) AS cadence
       FROM (SELECT quantile_cont(CAST(centroids AS DOUBLE), 0.5) AS k50 FROM hists) c,
         (SELECT quantile_cont(l_quantity, 0.5) AS v50 FROM lineitem) v,
         (SELECT quantile_cont(gap, 0.5) AS g50 FROM (SELECT CAST(ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) AS DOUBLE) AS gap FROM hists) WHERE gap IS NOT NULL) g""",
)
def _(spark, d):
    """The histogram block of a recipe."""
    h = recipe.histogram_parts(t.histograms(spark, d))
    dist = "histogram_distribution"
    return h.select(
        "family_id",
        F.try_element_at(f"{dist}.granularities", F.lit("D")).alias("daily_share"),
        c(f"{dist}.centroid_count_distribution.quantiles.p50").alias("centroid_count_p50"),
        c(f"{dist}.centroid_value_distribution.quantiles.p50").alias("centroid_value_p50"),
        F.try_element_at("cadence", F.lit("D")).alias("cadence"),
    )
