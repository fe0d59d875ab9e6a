"""Queries: divergence scores, status and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators import counts as C
from metricloom.operators import dims as D
from metricloom.operators import divergence as V
from metricloom.operators import synth, temporal
from metricloom.plans.catalog import query, u
from metricloom.session import materialize
from metricloom.sources import tables as t
from metricloom.streaming import jobs

c = F.col
FAM = ["family_id"]
DAY = ["family_id", "window_start"]


def profile(counts: DataFrame) -> dict[str, DataFrame]:
    """Everything the scores need, from one table of (family, dim, value) counts."""
    parts = D.split_long(counts)
    parts["value_q"] = C.exact_quantiles(parts["values"], FAM, "value")
    parts["size_q"] = C.exact_quantiles(parts["sizes"], FAM, "line_length")
    return parts


def ref_profile(ref: DataFrame) -> dict[str, DataFrame]:
    counts = materialize(C.value_counts(D.long_form(ref, *FAM), [*FAM, "dim"], "value"), "reference")
    parts = profile(counts)
    return {name: parts[name] for name in ("dims", "value_q", "size_q")}


def profiles(spark, d):
    """Both halves in one pass over the points: the half is a grouping key of the count table."""
    p = t.points(spark, d).withColumn("side", F.when(c("ts") < t.split_epoch(), "ref").otherwise("cur"))
    long = D.long_form(p, "side", *FAM)
    counts = materialize(C.value_counts(long, ["side", *FAM, "dim"], "value"), "sides", ["side"])
    return [profile(counts.filter(c("side") == side).drop("side")) for side in ("ref", "cur")]


def scores(spark, d) -> DataFrame:
    """Every family of either half; those with too few current points are ``insufficient``."""
    ref, cur = profiles(spark, d)
    return V.score(ref, cur, FAM, silent=True)


@query(
    "current_source_dist",
    "SELECT family_id, window_start, value, n, round(n / sum(n) OVER (PARTITION BY family_id, window_start), 6) AS p FROM (SELECT family_id, window_start, source AS value, count(*) AS n FROM day GROUP BY ALL)",
)
def _(spark, d):
    p = t.points(spark, d).withColumn("window_start", F.floor(c("ts") / 86400) * 86400)
    counts = C.value_counts(p, DAY, "source").withColumnRenamed("source", "value")
    return V.shares(counts, DAY).select(*DAY, "value", "n", "p")


@query(
    "current_tag_dist",
    """SELECT family_id, window_start, key, value, n, round(n / sum(n) OVER (PARTITION BY family_id, window_start, key), 6) AS p FROM
         (SELECT family_id, ts // 86400 * 86400 AS window_start, key, value, count(*) AS n FROM ptags GROUP BY ALL)""",
)
def _(spark, d):
    p = t.points(spark, d).withColumn("window_start", F.floor(c("ts") / 86400) * 86400)
    counts = C.value_counts(D.explode_tags(p, *DAY), [*DAY, "key"], "value")
    return V.shares(counts, [*DAY, "key"]).select(*DAY, "key", "value", "n", "p")


@query(
    "current_quantiles",
    """SELECT family_id, 'value' AS measure, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50,
         round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM curs GROUP BY family_id
       UNION ALL SELECT family_id, 'size', round(quantile_cont(x, 0.01), 6), round(quantile_cont(x, 0.05), 6), round(quantile_cont(x, 0.5), 6),
         round(quantile_cont(x, 0.95), 6), round(quantile_cont(x, 0.99), 6) FROM (SELECT family_id, CAST(line_length AS DOUBLE) AS x FROM curs) GROUP BY family_id""",
)
def _(spark, d):
    """Value and size in one pass: both measures travel as rows of one count table."""
    _ref, cur = t.reference_and_current(spark, d)
    long = cur.select(
        *FAM,
        F.inline(
            F.array(
                F.struct(F.lit("value").alias("measure"), c("value").alias("x")),
                F.struct(F.lit("size").alias("measure"), c("line_length").cast("double").alias("x")),
            )
        ),
    )
    keys = [*FAM, "measure"]
    return C.exact_quantiles(C.value_counts(long, keys, "x"), keys, "x")


@query("js_divergence", "SELECT family_id, dim, in_ref, round(js, 6) AS js FROM jsdim")
def _(spark, d):
    ref, cur = t.reference_and_current(spark, d)
    return V.js_divergence(D.dim_counts(ref, FAM), D.dim_counts(cur, FAM), [*FAM, "dim"])


@query("js_tags_average", "SELECT family_id, round(js_tags_avg, 6) AS js_tags_avg FROM jsfam")
def _(spark, d):
    ref, cur = t.reference_and_current(spark, d)
    return V.js_scores(D.dim_counts(ref, FAM), D.dim_counts(cur, FAM), FAM).select(*FAM, "js_tags_avg")


@query("js_categorical", "SELECT family_id, round(js_source, 6) AS js_source, round(js_categorical, 6) AS js_categorical FROM jsfam")
def _(spark, d):
    ref, cur = t.reference_and_current(spark, d)
    return V.js_scores(D.dim_counts(ref, FAM), D.dim_counts(cur, FAM), FAM).select(*FAM, "js_source", "js_categorical")


@query("wasserstein_quantile", "SELECT family_id, round(wasserstein, 6) AS wasserstein FROM wass")
def _(spark, d):
    ref, cur = profiles(spark, d)
    return V.wasserstein(ref["value_q"], cur["value_q"], FAM)


@query("ks_size", "SELECT family_id, round(ks_size, 6) AS ks_size FROM ksfam")
def _(spark, d):
    ref, cur = profiles(spark, d)
    return V.ks_knots(ref["size_q"], cur["sizes"], FAM, "line_length")


@query(
    "temporal_correlation",
    """SELECT family_id, round(CASE WHEN vx > 0 AND vy > 0 THEN cov / (sqrt(vx) * sqrt(vy)) END, 6) AS temporal_corr FROM (
      SELECT family_id, 1440 * sum(x * y) - sum(x) * sum(y) AS cov, 1440 * sum(x * x) - sum(x) ** 2 AS vx, 1440 * sum(y * y) - sum(y) ** 2 AS vy FROM (
        SELECT family_id, ts % 86400 // 60 AS mod, CAST(count(*) FILTER (ts < epoch(TIMESTAMP '2024-01-16')) AS DOUBLE) AS x,
          CAST(count(*) FILTER (ts >= epoch(TIMESTAMP '2024-01-16')) AS DOUBLE) AS y FROM points GROUP BY family_id, ts % 86400 // 60) GROUP BY family_id)""",
)
def _(spark, d):
    ref, cur = t.reference_and_current(spark, d)
    curves = [temporal.curve_points(temporal.minute_counts(x, FAM), FAM) for x in (ref, cur)]
    return V.curve_correlation(*curves, FAM)


@query(
    "cooccurrence_js",
    """SELECT family_id, round(CASE WHEN max(p) = 0 OR max(q) = 0 THEN 1.0 ELSE greatest(0.0, sum(
           CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / (2 * ln(2))) END, 6) AS cooccurrence_js
       FROM (SELECT family_id, pair, coalesce(max(share) FILTER (side = 'r'), 0) AS p, coalesce(max(share) FILTER (side = 'c'), 0) AS q FROM (
         SELECT family_id, side, pair, n / sum(n) OVER (PARTITION BY family_id, side) AS share FROM (
           SELECT family_id, CASE WHEN ts < epoch(TIMESTAMP '2024-01-16') THEN 'r' ELSE 'c' END AS side, env || '|' || k AS pair, count(*) AS n FROM points WHERE env IS NOT NULL GROUP BY ALL))
         GROUP BY family_id, pair) GROUP BY family_id""",
)
def _(spark, d):
    pairs = [
        D.tag_pairs(D.tag_combinations(x, FAM), FAM).select(*FAM, F.concat_ws("\u0001", "key_a", "value_a", "key_b", "value_b").alias("pair"), "n")
        for x in t.reference_and_current(spark, d)
    ]
    return V.js_divergence(*pairs, FAM, "pair").select(*FAM, c("js").alias("cooccurrence_js"))


@query(
    "family_status",
    "SELECT family_id, status, CASE status WHEN 'red' THEN 2 WHEN 'amber' THEN 1 WHEN 'green' THEN 0 END::BIGINT AS status_code FROM scores",
)
def _(spark, d):
    return scores(spark, d).select(*FAM, "status", V.status_code(c("status")).alias("status_code"))


@query(
    "families_report",
    """SELECT s.family_id, metric, s.n, status, round(js_source, 6) AS js_source, round(js_tags_avg, 6) AS js_tags_avg, round(js_categorical, 6) AS js_categorical,
         round(wasserstein, 6) AS wasserstein, round(ks_size, 6) AS ks_size FROM scores s JOIN (SELECT family_id, metric FROM famcounts) f USING (family_id)""",
)
def _(spark, d):
    names = t.points(spark, d).select("family_id", "metric").distinct()
    return scores(spark, d).join(names, FAM).select(
        *FAM, "metric", "n", "status", "js_source", "js_tags_avg", "js_categorical", "wasserstein", "ks_size"
    )


DAY_SECONDS = 86400
RETIRE = 3  # silent days after which a family has no further evaluations

# Scores of every (family, day) of the current half with enough points, against the reference half.
SCORED_SQL = """
    w AS (SELECT *, ts // 86400 * 86400 AS window_start FROM curs),
    wn AS (SELECT family_id, window_start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 10),
    wd AS (SELECT family_id, window_start, dim, value, count(*) AS n FROM (
        SELECT family_id, ts // 86400 * 86400 AS window_start, dim, value FROM dims WHERE ts >= epoch(TIMESTAMP '2024-01-16')) GROUP BY ALL),
    wp AS (SELECT family_id, window_start, dim, value, n / sum(n) OVER (PARTITION BY family_id, window_start, dim) AS q FROM wd),
    rp AS (SELECT r.family_id, wn.window_start, r.dim, r.value, r.p FROM rdims r JOIN wn ON wn.family_id = r.family_id),
    al AS (SELECT coalesce(rp.family_id, x.family_id) AS family_id, coalesce(rp.window_start, x.window_start) AS window_start, coalesce(rp.dim, x.dim) AS dim,
        coalesce(rp.p, 0) AS p, coalesce(x.q, 0) AS q FROM rp FULL JOIN (SELECT wp.* FROM wp JOIN wn ON wn.family_id = wp.family_id AND wn.window_start = wp.window_start) x
        ON rp.family_id = x.family_id AND rp.window_start = x.window_start AND rp.dim = x.dim AND rp.value = x.value),
    jd AS (SELECT family_id, window_start, dim, max(p) > 0 AS in_ref, CASE WHEN max(p) = 0 OR max(q) = 0 THEN 1.0 ELSE greatest(0.0, sum(
        CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / (2 * ln(2))) END AS js FROM al GROUP BY family_id, window_start, dim),
    jf AS (SELECT family_id, window_start, max(js) FILTER (dim = 'source') AS js_source, coalesce(avg(js) FILTER (dim LIKE 'tag:%' AND in_ref), 0) AS js_tags_avg FROM jd GROUP BY family_id, window_start),
    wq AS (SELECT family_id, window_start, quantile_cont(value, [0.01, 0.05, 0.5, 0.95, 0.99]) AS v FROM w GROUP BY ALL),
    ws AS (SELECT wq.family_id, wq.window_start, (abs(rq.v[1] - wq.v[1]) + abs(rq.v[2] - wq.v[2]) + abs(rq.v[3] - wq.v[3]) + abs(rq.v[4] - wq.v[4]) + abs(rq.v[5] - wq.v[5])) / 5 / (rq.v[5] - rq.v[1]) AS wasserstein
        FROM wq JOIN rq ON rq.family_id = wq.family_id),
    wk AS (SELECT family_id, window_start, greatest(0.0, max(greatest(p - f_at, f_below - p))) AS ks_size FROM (
        SELECT w.family_id, w.window_start, p, avg(CASE WHEN line_length <= q THEN 1.0 ELSE 0 END) AS f_at, avg(CASE WHEN line_length < q THEN 1.0 ELSE 0 END) AS f_below
        FROM w JOIN (SELECT family_id, unnest(s) AS q, unnest([0.01, 0.05, 0.5, 0.95, 0.99]) AS p FROM rq) k ON k.family_id = w.family_id GROUP BY w.family_id, w.window_start, p, q) GROUP BY family_id, window_start),
    scored AS (SELECT wn.family_id, wn.window_start, wn.n, js_source, js_tags_avg, (js_source + js_tags_avg) / 2 AS js_categorical, wasserstein, ks_size
        FROM wn JOIN jf ON jf.family_id = wn.family_id AND jf.window_start = wn.window_start JOIN ws ON ws.family_id = wn.family_id AND ws.window_start = wn.window_start
        JOIN wk ON wk.family_id = wn.family_id AND wk.window_start = wn.window_start),
    stat AS (SELECT *, CASE WHEN js_categorical > 0.05 OR wasserstein > 0.1 OR ks_size > 0.05 THEN 'red'
        WHEN js_categorical > 0.025 OR wasserstein > 0.05 OR ks_size > 0.025 THEN 'amber' ELSE 'green' END AS status FROM scored)"""

# Evaluations: scored days, and up to RETIRE insufficient ones after each where no score follows.
STREAK_SQL = f"""{SCORED_SQL},
    nxt AS (SELECT *, lead(window_start) OVER (PARTITION BY family_id ORDER BY window_start) AS nx FROM stat),
    evaluated AS (SELECT family_id, start AS window_start, CASE WHEN start = own THEN status ELSE 'insufficient' END AS status FROM (
      SELECT family_id, window_start AS own, status, unnest(range(window_start, least(window_start + {RETIRE * DAY_SECONDS}, coalesce(nx - {DAY_SECONDS}, window_start + {RETIRE * DAY_SECONDS})) + 1, {DAY_SECONDS})) AS start FROM nxt)),
    isl AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY window_start) - sum(CASE WHEN status = 'red' THEN 1 ELSE 0 END) OVER (PARTITION BY family_id ORDER BY window_start) AS island FROM evaluated),
    streaks AS (SELECT family_id, window_start, status, CASE WHEN status = 'red' THEN row_number() OVER (PARTITION BY family_id, island, status = 'red' ORDER BY window_start) ELSE 0 END AS red_streak FROM isl)"""


def judged_days(spark, d) -> DataFrame:
    """Real scores of every day, silent days included."""
    ref, cur = t.reference_and_current(spark, d)
    days = cur.withColumn("window_start", (F.floor(c("ts") / DAY_SECONDS) * DAY_SECONDS).cast("bigint"))
    counts = materialize(C.value_counts(D.long_form(days, *DAY), [*DAY, "dim"], "value"), "day-counts")
    scored = materialize(jobs.score_windows(ref_profile(ref), counts), "day-scores")
    return V.fill_silent(scored, FAM, "window_start", DAY_SECONDS, RETIRE)


@query("win_red_streak", f"WITH {STREAK_SQL} SELECT family_id, window_start, status, red_streak FROM streaks")
def _(spark, d):
    return V.red_streaks(judged_days(spark, d), FAM, "window_start")


ALERT_SQL = f"""WITH {STREAK_SQL} SELECT window_start, count(*) FILTER (status = 'red' AND red_streak >= 15) AS critical,
        count(*) FILTER (status = 'amber') AS warning, count(*) FILTER (status = 'red') AS info, count(*) FILTER (status = 'insufficient') AS insufficient FROM streaks GROUP BY window_start"""


@query("alert_counts", ALERT_SQL)
def _(spark, d):
    return V.alert_counts(V.red_streaks(judged_days(spark, d), FAM, "window_start"), "window_start")


FIDELITY = 1.7


@query(
    "load_fidelity",
    f"""SELECT family_id, CAST(sum(CAST(floor(x) AS BIGINT) + CASE WHEN {u("family_id || '|' || mod", 'round', 11)} < x - floor(x) THEN 1 ELSE 0 END) AS BIGINT) AS produced, any_value(target) AS target,
          abs(sum(CAST(floor(x) AS BIGINT) + CASE WHEN {u("family_id || '|' || mod", 'round', 11)} < x - floor(x) THEN 1 ELSE 0 END) - any_value(target)) <= 0.05 * any_value(target) AS within
        FROM (SELECT family_id, ts % 86400 // 60 AS mod, count(*) * 1.7::DOUBLE AS x, any_value(total) * 1.7::DOUBLE AS target
              FROM points JOIN (SELECT family_id, n AS total FROM famcounts) USING (family_id) GROUP BY family_id, ts % 86400 // 60) GROUP BY family_id""",
)
def _(spark, d):
    """Synthetic rows drawn at multiplier 1.7 against 1.7 times the observed volume."""
    p = t.points(spark, d)
    curve = temporal.curve_points(temporal.minute_counts(p, FAM), FAM).withColumn("rate", c("n").cast("double")).drop("n")
    total = p.groupBy(*FAM).agg(F.count("*").alias("total")).withColumn("base_rate", F.lit(1.0))
    budget = synth.row_budget(curve, total, FAM, 11, F.lit(FIDELITY))
    drawn = C.spread_sequence(budget.select(*FAM, "mod", "rows"), [*FAM, "mod"], "rows", "i").groupBy(*FAM).agg(F.count("*").alias("produced"))
    return total.select(*FAM, (c("total") * F.lit(FIDELITY)).alias("target")).join(drawn, FAM).select(*FAM, "produced", "target").withColumn(
        "within", F.abs(c("produced") - c("target")) <= 0.05 * c("target")
    )
