"""Comparison of a reference profile with current data, and alert status."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.operators.counts import PROBS
from metricloom.operators.dims import SOURCE, TAG
from metricloom.operators.temporal import MINUTES

# Red thresholds, amber share and streak length of the alert rules.
JS_THRESHOLD = 0.05
WASSERSTEIN_THRESHOLD = 0.1
KS_THRESHOLD = 0.05
AMBER_SHARE = 0.5
CRITICAL_STREAK = 15
MIN_SAMPLES = 10
RED, INSUFFICIENT = "red", "insufficient"


def shares(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``p`` = n / total of the key; the total is its own aggregate, not a window."""
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, keys).withColumn("p", F.col("n") / F.col("total"))


def align(ref: DataFrame, cur: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both distributions over the union of their values, missing shares 0."""
    left = shares(ref, keys).select(*keys, value, F.col("p").alias("p"))
    right = shares(cur, keys).select(*keys, value, F.col("p").alias("q"))
    return left.join(right, [*keys, value], "full_outer").select(
        *keys, value,
        F.coalesce("p", F.lit(0.0)).alias("p"),
        F.coalesce("q", F.lit(0.0)).alias("q"),
    )


def js_divergence(ref: DataFrame, cur: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Jensen-Shannon divergence in [0, 1] per key; 1 when one side is empty."""
    return aligned_divergence(align(ref, cur, keys, value), keys)


def aligned_divergence(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`js_divergence` of shares ``p`` and ``q`` of the same values."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    return (
        aligned.groupBy(*keys)
        .agg(
            F.sum(term(p) + term(q)).alias("_sum"),
            F.max(p).alias("_p"),
            F.max(q).alias("_q"),
        )
        .select(
            *keys,
            (F.col("_p") > 0).alias("in_ref"),
            F.when((F.col("_p") == 0) | (F.col("_q") == 0), 1.0)
            .otherwise(F.greatest(F.col("_sum") / (2 * math.log(2)), F.lit(0.0)))
            .alias("js"),
        )
    )


def js_scores(ref_dims: DataFrame, cur_dims: DataFrame, keys: list[str]) -> DataFrame:
    """Source score, mean over the reference's tag keys, and their average."""
    return family_scores(js_divergence(ref_dims, cur_dims, [*keys, "dim"]), keys)


def js_halves(dims: DataFrame, keys: list[str], ref: str, cur: str) -> DataFrame:
    """:func:`js_scores` of two count columns of the same rows, null or 0 where a side lacks the value; no join of values."""
    by, r, q = [*keys, "dim"], F.col(ref), F.col(cur)
    rows = dims.filter((F.coalesce(r, F.lit(0)) > 0) | (F.coalesce(q, F.lit(0)) > 0))
    whole = rows.groupBy(*by).agg(F.sum(r).alias("_r"), F.sum(q).alias("_c"))
    shared = rows.join(whole, by).select(
        *by, F.coalesce(F.try_divide(r, F.col("_r")), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide(q, F.col("_c")), F.lit(0.0)).alias("q")
    )
    return family_scores(aligned_divergence(shared, by), keys)


def family_scores(per_dim: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of a family from those of its dimensions."""
    tags = F.when(F.col("dim").startswith(TAG) & F.col("in_ref"), F.col("js"))
    return (
        per_dim.groupBy(*keys)
        .agg(
            F.max(F.when(F.col("dim") == SOURCE, F.col("js"))).alias("js_source"),
            F.coalesce(F.avg(tags), F.lit(0.0)).alias("js_tags_avg"),
        )
        .withColumn("js_categorical", (F.col("js_source") + F.col("js_tags_avg")) / 2)
    )


def js_windows(ref_dims: DataFrame, cur_dims: DataFrame, keys: list[str], family: list[str]) -> DataFrame:
    """:func:`js_scores` of many windows per family, without a copy of the reference for each.

    A value that only the reference holds adds p ln 2 to the divergence, and all of them together
    what is left of 1 after the shares of the values seen. So only values seen in a window meet
    their reference shares, in an equi join, and the rest is one subtraction.
    """
    p, q = F.coalesce("p", F.lit(0.0)), F.col("q")
    ref = shares(ref_dims, [*family, "dim"]).select(*family, "dim", "value", "p")
    cur = shares(cur_dims, [*keys, "dim"]).select(*keys, "dim", "value", F.col("p").alias("q"))

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / ((p + q) / 2))).otherwise(0.0)

    seen = (
        cur.join(ref, [*family, "dim", "value"], "left").groupBy(*keys, "dim")
        .agg(F.sum(term(p) + term(q)).alias("_sum"), F.sum(p).alias("_p"))
    )
    dims = ref.select(*family, "dim").distinct().withColumn("in_ref", F.lit(True))
    rest = F.greatest(1 - F.col("_p"), F.lit(0.0)) * math.log(2)
    per_dim = seen.join(dims, [*family, "dim"], "left").select(
        *keys, "dim", F.coalesce("in_ref", F.lit(False)).alias("in_ref"),
        F.when(F.col("in_ref").isNull(), 1.0).otherwise(F.greatest((F.col("_sum") + rest) / (2 * math.log(2)), F.lit(0.0))).alias("js"),
    )
    is_tag = F.col("dim").startswith(TAG)
    tags = dims.where(is_tag).groupBy(*family).agg(F.count("*").alias("_tags"))
    own = per_dim.groupBy(*keys).agg(
        F.max(F.when(F.col("dim") == SOURCE, F.col("js"))).alias("js_source"),
        F.sum(F.when(is_tag & F.col("in_ref"), F.col("js"))).alias("_js"),
        F.count_if(is_tag & F.col("in_ref")).alias("_met"),
    )
    # a tag key of the reference that a window lacks has the divergence 1
    missing = F.col("_tags") - F.col("_met")
    average = F.coalesce((F.coalesce("_js", F.lit(0.0)) + missing) / F.col("_tags"), F.lit(0.0))
    scored = own.join(tags, family, "left").select(*keys, "js_source", average.alias("js_tags_avg"))
    return scored.withColumn("js_categorical", (F.col("js_source") + F.col("js_tags_avg")) / 2)


def wasserstein(ref_q: DataFrame, cur_q: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute quantile gap over the reference range; 1 when current data is missing."""
    names = list(PROBS)
    joined = ref_q.select(*keys, F.array(*names).alias("r")).join(
        cur_q.select(*keys, F.array(*names).alias("c")), keys, "left"
    )
    gaps = F.zip_with("r", "c", lambda a, b: F.abs(a - b))
    mean = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) / len(names)
    spread = F.element_at("r", -1) - F.element_at("r", 1)
    return joined.select(
        *keys,
        F.when(F.col("c").isNull(), 1.0)
        .otherwise(F.when(spread > 0, mean / spread).otherwise(mean))
        .alias("wasserstein"),
    )


def ks_knots(ref_q: DataFrame, cur_counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Largest gap between the current distribution and the reference knots.

    A knot inside a run of equal values costs nothing as long as its probability lies between
    the shares below and at that value.
    """
    n, v = F.col("n"), F.col(value)
    parts = []
    for name in PROBS:
        parts += [
            (F.sum(F.when(v <= F.col(name), n).otherwise(0)) / F.sum(n)).alias(f"_at_{name}"),
            (F.sum(F.when(v < F.col(name), n).otherwise(0)) / F.sum(n)).alias(f"_below_{name}"),
        ]
    seen = cur_counts.join(ref_q.select(*keys, *PROBS), keys).groupBy(*keys).agg(*parts)
    gaps = [F.lit(0.0)]
    for name, p in PROBS.items():
        gaps += [F.lit(p) - F.col(f"_at_{name}"), F.col(f"_below_{name}") - F.lit(p)]
    return (
        ref_q.select(*keys)
        .join(seen.select(*keys, F.greatest(*gaps).alias("_ks")), keys, "left")
        .select(*keys, F.coalesce("_ks", F.lit(1.0)).alias("ks_size"))
    )


def curve_correlation(ref: DataFrame, cur: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson correlation of minute-of-day counts over all 1440 minutes.

    Empty minutes are zeros; both curves are centred at their means before products are summed, so
    large even curves lose no digits. Empty minutes add the product of the means.
    """
    both = ref.select(*keys, "mod", F.col("n").alias("x")).join(
        cur.select(*keys, "mod", F.col("n").alias("y")), [*keys, "mod"], "full_outer"
    )
    x = F.coalesce("x", F.lit(0)).cast("double")
    y = F.coalesce("y", F.lit(0)).cast("double")
    c = F.col
    means = both.groupBy(*keys).agg((F.sum(x) / MINUTES).alias("mx"), (F.sum(y) / MINUTES).alias("my"), (MINUTES - F.count("*")).alias("rest"))
    dx, dy = x - c("mx"), y - c("my")
    s = both.join(means, keys).groupBy(*keys).agg(
        F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("rest").alias("rest"),
    )
    top = c("xy") + c("rest") * c("mx") * c("my")
    vx, vy = c("xx") + c("rest") * c("mx") * c("mx"), c("yy") + c("rest") * c("my") * c("my")
    # a flat curve is exactly its mean everywhere, or differs by rounding of the mean alone
    spread = (vx > 1e-30 * MINUTES * c("mx") * c("mx")) & (vy > 1e-30 * MINUTES * c("my") * c("my"))
    return s.select(*keys, F.when(spread, top / (F.sqrt(vx) * F.sqrt(vy))).alias("temporal_corr"))


def status(js: Column, w: Column, ks: Column) -> Column:
    """red / amber / green; a missing score never raises the status."""

    def any_above(share: float) -> Column:
        return (
            F.coalesce(js > JS_THRESHOLD * share, F.lit(False))
            | F.coalesce(w > WASSERSTEIN_THRESHOLD * share, F.lit(False))
            | F.coalesce(ks > KS_THRESHOLD * share, F.lit(False))
        )

    return F.when(any_above(1.0), "red").when(any_above(AMBER_SHARE), "amber").otherwise("green")


def status_code(name: Column) -> Column:
    """2, 1 or 0; null where nothing was evaluated."""
    return F.when(name == RED, 2).when(name == "amber", 1).when(name == "green", 0)


def score(
    ref: dict[str, DataFrame], cur: dict[str, DataFrame], keys: list[str], min_samples: int = MIN_SAMPLES, js: DataFrame | None = None, silent: bool = False,
) -> DataFrame:
    """All scores per key.

    ``ref`` and ``cur`` hold ``dims`` (dim, value, n), ``value_q`` (p01..p99), ``size_q`` (reference
    only) and ``sizes`` (line_length, n; current only). ``js`` replaces the categorical scores. With
    ``silent``, keys of either side with fewer than ``min_samples`` current rows, or none, stay as
    ``insufficient`` without scores; else they have no row.
    """
    count = F.sum(F.when(F.col("dim") == SOURCE, F.col("n")).otherwise(0)).alias("n")
    totals = cur["dims"].groupBy(*keys).agg(count)
    enough = F.col("n") >= min_samples
    if silent:
        known = ref["dims"].select(*keys).distinct()
        totals = totals.join(known, keys, "full_outer").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    else:
        totals = totals.filter(enough)
    scored = (
        totals.join(js_scores(ref["dims"], cur["dims"], keys) if js is None else js, keys, "left")
        .join(wasserstein(ref["value_q"], cur["value_q"], keys), keys, "left")
        .join(ks_knots(ref["size_q"], cur["sizes"], keys, "line_length"), keys, "left")
    )
    if silent:
        scored = scored.withColumns({x: F.when(enough, F.col(x)) for x in scored.columns if x not in (*keys, "n")})
    judged = status(F.col("js_categorical"), F.col("wasserstein"), F.col("ks_size"))
    return scored.withColumn("status", F.when(enough, judged).otherwise(INSUFFICIENT))


def fill_silent(scored: DataFrame, keys: list[str], order: str, step: int, retire: int) -> DataFrame:
    """Batch form of the stream's evaluations: windows without a score become ``insufficient`` rows.

    After each scored window up to ``retire`` missing ones follow, as far as the next scored one.
    """
    following = F.lead(order).over(W.partitionBy(*keys).orderBy(order))
    last = F.least(F.col(order) + F.lit(retire * step), F.coalesce(following - step, F.col(order) + F.lit(retire * step)))
    starts = F.sequence(F.col(order), F.col("_last"), F.lit(step).cast("bigint"))
    grown = scored.select(*keys, order, "status").withColumn("_last", last).select(*keys, F.col(order).alias("_own"), "status", F.explode(starts).alias(order))
    return grown.select(*keys, order, F.when(F.col(order) == F.col("_own"), F.col("status")).otherwise(INSUFFICIENT).alias("status"))


def red_streaks(scored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Length of the run of red evaluations ending at each row; any other status resets it."""
    w = W.partitionBy(*keys).orderBy(order)
    red = F.col("status") == "red"
    island = F.row_number().over(w) - F.sum(F.when(red, 1).otherwise(0)).over(
        w.rowsBetween(W.unboundedPreceding, 0)
    )
    return (
        scored.withColumn("_island", island)
        .withColumn(
            "red_streak",
            F.when(red, F.row_number().over(W.partitionBy(*keys, "_island", red).orderBy(order))).otherwise(0),
        )
        .drop("_island")
    )


def alert_counts(streaks: DataFrame, order: str) -> DataFrame:
    """Critical, warning and info counts per evaluation time."""
    red = F.col("status") == "red"
    return streaks.groupBy(order).agg(
        F.count_if(red & (F.col("red_streak") >= CRITICAL_STREAK)).alias("critical"),
        F.count_if(F.col("status") == "amber").alias("warning"),
        F.count_if(red).alias("info"),
        F.count_if(F.col("status") == INSUFFICIENT).alias("insufficient"),
    )
