"""Recipes: one row per metric family with everything needed to compare and synthesise it.

The work is a few grouped aggregations over the points, each written once to the shared folder;
all statistics derive from those count tables, and one row per family is joined at the end.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.operators import counts as C
from metricloom.operators import dims as D
from metricloom.operators import divergence as V
from metricloom.operators import fit, patterns, temporal
from metricloom.functions.keys import span_family_id
from metricloom.schemas import CAT, RECIPE
from metricloom.session import materialize

VERSION = "v1.0"
FAMILY = ["family_id"]
TOP_PAIRS = 100
PARALLEL_PARTS = 6
DAY = 86400
TYPES = ["categorical", "numeric", "text", "identifier"]
TAG_SCHEMA = "map<string,struct<type:string,presence:double,cardinality:bigint>>"
TAG_KEY = r"^[a-zA-Z][a-zA-Z0-9_]*$"
GRAMS = {1: "unigrams", 2: "bigrams", 3: "trigrams"}


def numeric_struct(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Bins, counts, quantiles and moments of a numeric column as one struct per key."""
    q = C.exact_quantiles(counts, keys, value)
    filled = C.histogram_bins(counts, q, keys, value)
    by_bin = filled.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_bins"))
    width = (F.col("p99") - F.col("p01")) / C.BINS
    edges = F.transform(F.sequence(F.lit(0), F.lit(C.BINS)), lambda i: F.col("p01") + i * width)
    tallies = F.transform(
        F.sequence(F.lit(0), F.lit(C.BINS - 1)),
        lambda i: F.coalesce(F.try_element_at("_bins", i), F.lit(0).cast("bigint")),
    )
    return (
        q.join(by_bin, keys)
        .join(C.moments(counts, keys, value), keys)
        .select(
            *keys,
            F.struct(
                edges.alias("bins"),
                tallies.alias("counts"),
                F.struct(*C.PROBS).alias("quantiles"),
                "mean", "stddev", "min", "max",
            ).alias(name),
        )
    )


def cat_struct(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    cat = D.categorical(counts, keys)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "value", "frequency")))
    return cat.groupBy(*keys).agg(
        F.struct(
            F.transform(ordered, lambda x: F.struct(x["value"].alias("value"), x["frequency"].alias("frequency"))).alias("top_values"),
            F.first("distinct_count").alias("distinct_count"),
            F.first("entropy").alias("entropy"),
        ).alias(name)
    )


def pattern_pieces(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, piece, n): lengths (size 0) and n-grams of 1 to 3 characters of all values, in one pass."""
    text, at = F.col("value"), F.col("at")
    each = values.select(*keys, "n", "value", F.explode(F.sequence(F.lit(0), F.length(text))).alias("at"))

    def gram(size: int) -> Column:
        whole = (at > 0) & (at + size - 1 <= F.length(text))
        return F.struct(F.lit(size).alias("size"), F.when(whole, F.substring(text, at, F.lit(size))).alias("piece"))

    length = F.struct(F.lit(0).alias("size"), F.when(at == 0, F.length(text).cast("string")).alias("piece"))
    return C.value_counts(each.select(*keys, "n", F.inline(F.array(length, *[gram(size) for size in GRAMS]))), [*keys, "size"], "piece", "n")


def pattern_structs(dim_counts: DataFrame) -> DataFrame:
    """Top patterns per (family, dim) with n-grams and lengths of the values behind them.

    The values are generalised once; n-grams and lengths of all sizes are counted in one pass over them.
    """
    keys = [*FAMILY, "dim", "pattern"]
    shaped = materialize(dim_counts.select(*FAMILY, "dim", patterns.generalize(F.col("value")).alias("pattern"), "value", "n"), "shaped")
    best = materialize(patterns.mine(shaped, [*FAMILY, "dim"], counted="pattern"), "best-patterns")
    pieces = materialize(pattern_pieces(shaped.join(best.select(*keys), keys, "left_semi"), keys), "pieces")

    def grams(size: int, name: str) -> DataFrame:
        shared = V.shares(pieces.filter(F.col("size") == size).select(*keys, F.col("piece").alias("gram"), "n"), keys)
        return shared.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("gram", "p"))).alias(name))

    sized = pieces.filter(F.col("size") == 0).select(*keys, F.col("piece").cast("bigint").alias("length"), "n")
    rows = best.join(numeric_struct(sized, keys, "length", "length_distribution"), keys, "left")
    for size, name in GRAMS.items():
        rows = rows.join(grams(size, name), keys, "left")
    item = F.struct(
        "rank", "pattern", "frequency",
        F.struct("unigrams", "bigrams", "trigrams").alias("char_distributions"),
        "length_distribution",
    )
    return rows.groupBy(*FAMILY, "dim").agg(
        F.transform(
            F.array_sort(F.collect_list(item), lambda a, b: (a["rank"] - b["rank"]).cast("int")),
            lambda x: F.struct(x["pattern"].alias("pattern"), x["frequency"].alias("frequency"), x["char_distributions"].alias("char_distributions"), x["length_distribution"].alias("length_distribution")),
        ).alias("patterns")
    )


def fitness(counts: DataFrame, cut: Column) -> DataFrame:
    """First half of the capture against the second, per family, from day counts."""
    whole = stored_totals(totals(counts, cut, "n"))
    return half_scores(of_part(whole, D.SOURCE, D.TAG), typed(whole, "value", "value", "double"), typed(whole, "second", "ts", "bigint"))


def half_scores(dims: DataFrame, values: DataFrame, seconds: DataFrame) -> DataFrame:
    """Scores of the counts ``before`` against those ``after``, both columns of the same rows."""

    def half(rows: DataFrame, name: str) -> DataFrame:
        return rows.filter(F.col(name).isNotNull()).withColumn("n", F.col(name))

    curve = {name: temporal.curve_points(temporal.minute_counts(half(seconds, name), FAMILY, n="n"), FAMILY) for name in HALVES}
    js = V.js_halves(dims, FAMILY, *HALVES).select(*FAMILY, F.col("js_categorical").alias("categorical_js_divergence"))
    ks = V.ks_knots(C.exact_quantiles(half(values, "before"), FAMILY, "value"), half(values, "after"), FAMILY, "value").select(
        *FAMILY, F.col("ks_size").alias("numeric_ks_statistic")
    )
    corr = V.curve_correlation(curve["before"], curve["after"], FAMILY).select(*FAMILY, F.col("temporal_corr").alias("temporal_correlation"))
    return js.join(ks, FAMILY, "left").join(corr, FAMILY, "left")


# --- day counts -------------------------------------------------------------------------------

COMBO = "array<struct<key:string,value:string>>"


def long_points(points: DataFrame) -> DataFrame:
    """(family_id, metric, day, dim, value): a row for all that recipes need of a point."""
    c = F.col
    entries = F.sort_array(F.map_entries("tags"))

    def row(dim: str, value: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), value.cast("string").alias("value"))

    fixed = F.array(
        row(D.SOURCE, c("source")), row("value", c("value")), row("size", c("line_length")), row("second", c("ts")),
        row("combo", F.to_json(entries)), row("delta", F.coalesce("is_delta", F.lit(False))),
    )
    tags = F.transform(F.map_entries("tags"), lambda e: F.struct(F.concat(F.lit(D.TAG), e["key"]).alias("dim"), e["value"].alias("value")))
    return points.select(
        *FAMILY, "metric", F.floor(c("ts") / DAY).alias("day"), F.inline(F.concat(fixed, F.coalesce(tags, F.array().cast("array<struct<dim:string,value:string>>"))))
    )


def day_counts(points: DataFrame) -> DataFrame:
    """(family_id, metric, day, dim, value, n): all that recipes need of the points, in one scan.

    ``day`` is the number of the day of ``ts``, null where there is no time. Dimensions are source,
    tag:<key>, value, size, second, combo (the whole tag set) and delta (one row per point). Counts
    of different days add up, so a new day needs its own points only.
    """
    return C.value_counts(long_points(points), [*FAMILY, "metric", "day", "dim"], "value")


HALVES = ["before", "after"]


def totals(rows: DataFrame, cut: Column, n: str | None = None) -> DataFrame:
    """(family_id, metric, dim, value, n, before, after) over all days.

    ``rows`` are long points, or day counts with their ``n``. ``before`` and ``after`` are the counts on
    either side of ``cut``, null where there are none; rows without a day are in neither. ``metric``
    stands with delta rows only, so that no other value is in two rows.
    """
    c = F.col
    weight, second_half = c(n) if n else F.lit(1), c("day") * DAY >= cut
    return (
        rows.filter(c("value").isNotNull())
        .groupBy(*FAMILY, F.when(c("dim") == "delta", c("metric")).alias("metric"), "dim", "value")
        .agg(F.sum(weight).alias("n"), F.sum(F.when(~second_half, weight)).alias("before"), F.sum(F.when(second_half, weight)).alias("after"))
    )


def stored_totals(rows: DataFrame) -> DataFrame:
    """Totals written once, in a folder per dimension (all tags in one): each block reads only its own."""
    part = F.when(F.col("dim").startswith(D.TAG), D.TAG).otherwise(F.col("dim"))
    return materialize(rows.withColumn("part", F.replace(part, F.lit(":"), F.lit(""))), "totals", ["part"])


def of_part(rows: DataFrame, *dims: str) -> DataFrame:
    """Rows of some dimensions of stored totals; ``D.TAG`` stands for all tags."""
    return rows.filter(F.col("part").isin(*[dim.replace(":", "") for dim in dims])).drop("part")


def typed(rows: DataFrame, dim: str, name: str, kind: str) -> DataFrame:
    """(family_id, name, n, before, after) of one dimension of stored totals, as its own type."""
    own = of_part(rows, dim).select(*FAMILY, F.col("value").cast(kind).alias(name), "n", *HALVES)
    return own.filter(F.col(name).isNotNull()).groupBy(*FAMILY, name).agg(*[F.sum(x).alias(x) for x in ("n", *HALVES)])


def add_day(points: DataFrame, path: str) -> None:
    """Add the counts of new points to the store of day counts at ``path``.

    The store is partitioned by day; points of a day that is there already, late ones say, come as
    further files of its folder and add to its counts. Adding points twice counts them twice.
    """
    day_counts(points).write.mode("append").partitionBy("day").parquet(path)


def stored_days(spark, path: str) -> DataFrame:
    """All counts of a store."""
    return spark.read.schema("family_id string, metric string, dim string, value string, n bigint, day bigint").parquet(path)


def assemble(points: DataFrame, cut: Column, histograms: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Recipes of all metric families from one scan of the points.

    ``points`` needs family_id, metric, value, ts, source, tags, is_delta and line_length;
    ``cut`` is the epoch second that halves the capture for the fitness scores. ``errors`` holds
    ``reason`` and ``lines`` of the whole capture.
    """
    return from_totals(stored_totals(totals(long_points(points), cut)), histograms, errors)


def from_days(counts: DataFrame, cut: Column, histograms: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Recipes from day counts; the fitness scores set days that begin at ``cut`` or later against those before."""
    return from_totals(stored_totals(totals(counts, cut, "n")), histograms, errors)


def from_totals(counts: DataFrame, histograms: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """Recipes from stored totals."""
    c = F.col
    values = materialize(typed(counts, "value", "value", "double"), "values")
    sizes = materialize(typed(counts, "size", "line_length", "bigint"), "sizes")
    dims, sources, tags = of_part(counts, D.SOURCE, D.TAG), of_part(counts, D.SOURCE), of_part(counts, D.TAG)
    seconds = materialize(typed(counts, "second", "ts", "bigint"), "seconds")
    minutes = materialize(temporal.minute_counts(seconds, FAMILY, n="n"), "minutes")
    combos = of_part(counts, "combo").select(*FAMILY, F.from_json("value", COMBO).alias("combo"), "n")

    delta = of_part(counts, "delta").groupBy(*FAMILY, "metric").agg(F.sum("n").alias("samples"), F.bool_or(c("value") == "true").alias("is_delta"))
    window = seconds.groupBy(*FAMILY).agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    base = materialize(delta.join(window, FAMILY, "left"), "base")
    tag_schema = D.tag_schema(tags, base, FAMILY)
    schema_map = tag_schema.groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.struct("type", "presence", "cardinality")))).alias("tag_schema"),
        F.map_from_entries(F.collect_list(F.struct("key", "cardinality"))).alias("max_cardinality_per_tag"),
        F.sort_array(F.collect_list(F.when(c("presence") == 1.0, c("key")))).alias("required_tags"),
    )
    source_cat = cat_struct(sources, [*FAMILY, "dim"], "source_distribution").drop("dim")
    tag_cats = D.tag_only(cat_struct(tags, [*FAMILY, "dim"], "cat")).groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "cat"))).alias("tag_distributions")
    )
    pairs = V.shares(D.tag_pairs(combos, FAMILY), FAMILY).withColumn(
        "pair", F.concat_ws("\u0001", "key_a", "value_a", "key_b", "value_b")
    )
    samples = base.select(*FAMILY, "samples")
    cooccurrence = (
        C.top_k(pairs, FAMILY, "pair", TOP_PAIRS)
        .join(samples, FAMILY)
        .groupBy(*FAMILY)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", "key_a", "value_a", "key_b", "value_b", (c("n") / c("samples")).alias("f")))),
                lambda x: F.struct(
                    F.create_map(x["key_a"], x["value_a"], x["key_b"], x["value_b"]).alias("tags"), x["f"].alias("frequency")
                ),
            ).alias("tag_cooccurrence")
        )
    )
    value_num = numeric_struct(values, FAMILY, "value", "value_distribution")
    size_num = numeric_struct(sizes, FAMILY, "line_length", "size_distribution")
    rates = sources.groupBy(*FAMILY, c("n").alias("rate")).agg(F.count("*").alias("n"))
    params = fit.parameters(values, FAMILY)
    best = fit.best_fit(params, fit.ks_statistics(values, params, FAMILY), FAMILY).select(
        *FAMILY,
        F.struct("type", "parameters", F.struct("ks_statistic", "ks_p_value").alias("goodness_of_fit")).alias("parametric"),
    )
    curve_points = temporal.curve_points(minutes, FAMILY)
    curve = curve_points.groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("mod", "n"))).alias("_m"), F.sum("n").alias("_n")
    ).select(
        *FAMILY,
        F.transform(
            F.sequence(F.lit(0), F.lit(temporal.MINUTES - 1)),
            lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) * float(temporal.MINUTES) / c("_n"),
        ).alias("intensity_curve"),
    )
    burst = temporal.burstiness(minutes, FAMILY)
    gaps = temporal.gap_cv(temporal.gap_counts(seconds, FAMILY, n="n"), FAMILY)
    # parts that write steps of their own are made inside the pool
    parts = [
        lambda: pattern_structs(dims),
        lambda: half_scores(dims, values, seconds).select(
            *FAMILY,
            F.struct("categorical_js_divergence", "numeric_ks_statistic", "temporal_correlation").alias("fitness_scores"),
        ),
        lambda: numeric_struct(materialize(rates, "rates"), FAMILY, "rate", "per_source_rate_distribution"),
        *[lambda part=part: part for part in (schema_map, source_cat, tag_cats, cooccurrence, value_num, size_num, best, curve, burst, gaps)],
    ]
    out = base
    if histograms is not None:
        parts.append(lambda: histogram_parts(histograms))
    else:
        out = out.withColumn("histogram_distribution", F.lit(None)).withColumn("cadence", F.lit(None)).withColumn("has_histogram", F.lit(False))
    # One row per family each. Written separately so that every part is a small plan of its own;
    # a few run side by side because most of them are too small to fill a cluster.
    with ThreadPoolExecutor(PARALLEL_PARTS) as pool:
        shapes, *parts = pool.map(lambda make: materialize(make(), "part"), parts)
    source_shapes = shapes.filter(c("dim") == D.SOURCE).select(*FAMILY, c("patterns").alias("source_patterns"))
    tag_shapes = D.tag_only(shapes).groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "patterns"))).alias("tag_value_patterns")
    )
    for part in (*parts, source_shapes, tag_shapes):
        out = out.join(part, FAMILY, "left")
    drop_reasons = F.lit(None).cast("map<string,bigint>")
    coverage = F.lit(1.0)
    if errors is not None:
        totals = errors.agg(
            F.map_from_entries(F.collect_list(F.when(c("reason") != "ok", F.struct("reason", "lines")))).alias("drop_reasons"),
            (F.sum(F.when(c("reason") == "ok", c("lines"))) / F.sum("lines")).alias("coverage"),
        ).first()  # one row of at most eight entries
        if totals["drop_reasons"]:
            drop_reasons = F.create_map(*[F.lit(x) for kv in totals["drop_reasons"].items() for x in kv]).cast("map<string,bigint>")
        coverage = F.lit(float(totals["coverage"] or 0.0))
    return conform(out.select(
        F.lit(VERSION).alias("version"),
        *FAMILY,
        c("metric").alias("metric_name"),
        F.current_timestamp().alias("created_at"),
        F.struct(
            F.timestamp_seconds("_t0").alias("start_time"),
            F.timestamp_seconds("_t1").alias("end_time"),
            ((c("_t1") - c("_t0")) / 3600.0).alias("duration_hours"),
        ).alias("capture_window"),
        F.struct(
            F.lit("metric").alias("type"), "is_delta",
            F.coalesce("has_histogram", F.lit(False)).alias("has_histogram"),
            F.coalesce("tag_schema", F.create_map().cast(TAG_SCHEMA)).alias("tag_schema"),
        ).alias("schema"),
        F.struct(
            c("samples").alias("sample_count"), "source_distribution",
            F.coalesce("tag_distributions", F.create_map().cast(f"map<string,{CAT}>")).alias("tag_distributions"),
            "tag_cooccurrence",
            "value_distribution", "parametric", "histogram_distribution",
            F.lit(None).alias("span_distribution"),
        ).alias("statistics"),
        F.struct(
            "intensity_curve",
            F.struct(c("cv_counts").alias("coefficient_of_variation"), "cv_interarrival", "fano_factor").alias("burstiness"),
            "cadence",
        ).alias("temporal"),
        F.struct("size_distribution", (1.0 - coverage).alias("error_rate")).alias("payload"),
        F.struct("source_patterns", "tag_value_patterns").alias("patterns"),
        F.struct(
            F.struct(c("source_distribution.distinct_count").alias("source_count_estimate"), "per_source_rate_distribution").alias("entity_hints"),
            F.struct("max_cardinality_per_tag", "required_tags").alias("constraints"),
        ).alias("generation"),
        F.struct(coverage.alias("coverage"), drop_reasons.alias("drop_reasons"), "fitness_scores").alias("validation"),
    ))


def conform(recipes: DataFrame) -> DataFrame:
    """Columns in schema order with their declared types; absent blocks become typed nulls."""
    schema = T.StructType.fromDDL(RECIPE)
    return recipes.select(
        *[
            (F.col(f"`{f.name}`") if f.name in recipes.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def histogram_parts(histograms: DataFrame) -> DataFrame:
    """Granularity shares, centroid distributions and cadence per family."""
    c = F.col
    shares = V.shares(C.value_counts(histograms, FAMILY, "granularity"), FAMILY)
    grans = shares.groupBy(*FAMILY).agg(F.map_from_entries(F.collect_list(F.struct("granularity", "p"))).alias("granularities"))
    centroid = histograms.select(*FAMILY, F.inline("centroids"))
    n_counts = numeric_struct(
        histograms.groupBy(*FAMILY, F.size("centroids").cast("bigint").alias("k")).agg(F.count("*").alias("n")), FAMILY, "k", "centroid_count_distribution"
    )
    v_counts = numeric_struct(
        centroid.groupBy(*FAMILY, "value").agg(F.sum("count").alias("n")), FAMILY, "value", "centroid_value_distribution"
    )
    cad = cadence(histograms, FAMILY).groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("granularity", "cadence_seconds"))).alias("cadence")
    )
    return (
        grans.join(n_counts, FAMILY).join(v_counts, FAMILY).join(cad, FAMILY, "left")
        .select(
            *FAMILY,
            F.lit(True).alias("has_histogram"),
            F.struct("granularities", "centroid_count_distribution", "centroid_value_distribution").alias("histogram_distribution"),
            "cadence",
        )
    )


def cadence(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Median seconds between submissions of one source, per granularity."""
    gaps = temporal.gap_counts(histograms, [*keys, "granularity", "source"], bucket_seconds=86400 * 30)
    pooled = gaps.groupBy(*keys, "granularity", "gap").agg(F.sum("n").alias("n"))
    return C.exact_quantiles(pooled, [*keys, "granularity"], "gap", {"cadence_seconds": 0.5})


def span_recipes(spans: DataFrame) -> DataFrame:
    """Recipes of span operations with the same blocks as metric recipes."""
    c = F.col
    rows = spans.withColumn("family_id", span_family_id(c("operation"))).withColumn("ts", F.floor(c("start_ms") / 1000))
    dims = D.dim_counts(rows, FAMILY)
    base = rows.groupBy(*FAMILY, "operation").agg(F.count("*").alias("samples"), F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    durations = numeric_struct(C.value_counts(rows, FAMILY, "duration_ms"), FAMILY, "duration_ms", "duration_distribution")
    source = cat_struct(dims.filter(c("dim") == D.SOURCE), [*FAMILY, "dim"], "source_distribution").drop("dim")
    tag_cats = D.tag_only(cat_struct(dims, [*FAMILY, "dim"], "cat")).groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "cat"))).alias("tag_distributions")
    )
    schema_map = D.tag_schema(dims, base, FAMILY).groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.struct("type", "presence", "cardinality")))).alias("tag_schema")
    )
    minutes = temporal.minute_counts(rows, FAMILY)
    curve = temporal.curve_points(minutes, FAMILY).groupBy(*FAMILY).agg(
        F.map_from_entries(F.collect_list(F.struct("mod", "n"))).alias("_m"), F.sum("n").alias("_n")
    )
    burst = temporal.burstiness(minutes, FAMILY)
    out = base
    for part in (durations, source, tag_cats, schema_map, curve, burst):
        out = out.join(part, FAMILY, "left")
    only = F.struct(
        F.array(F.struct(c("operation").alias("value"), F.lit(1.0).alias("frequency"))).alias("top_values"),
        F.lit(1).cast("bigint").alias("distinct_count"), F.lit(0.0).alias("entropy"),
    )
    none = F.lit(None)
    return conform(out.select(
        F.lit(VERSION).alias("version"), *FAMILY, c("operation").alias("metric_name"),
        F.current_timestamp().alias("created_at"),
        F.struct(
            F.timestamp_seconds("_t0").alias("start_time"), F.timestamp_seconds("_t1").alias("end_time"),
            ((c("_t1") - c("_t0")) / 3600.0).alias("duration_hours"),
        ).alias("capture_window"),
        F.struct(F.lit("span").alias("type"), F.lit(False).alias("is_delta"), F.lit(False).alias("has_histogram"), "tag_schema").alias("schema"),
        F.struct(
            c("samples").alias("sample_count"), "source_distribution", "tag_distributions",
            none.alias("tag_cooccurrence"), none.alias("value_distribution"), none.alias("parametric"),
            none.alias("histogram_distribution"),
            F.struct("duration_distribution", only.alias("operation_distribution")).alias("span_distribution"),
        ).alias("statistics"),
        F.struct(
            F.transform(
                F.sequence(F.lit(0), F.lit(temporal.MINUTES - 1)),
                lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)) * float(temporal.MINUTES) / c("_n"),
            ).alias("intensity_curve"),
            F.struct(
                c("cv_counts").alias("coefficient_of_variation"), none.alias("cv_interarrival"), "fano_factor"
            ).alias("burstiness"),
            none.alias("cadence"),
        ).alias("temporal"),
        F.struct(
            F.struct(
                c("source_distribution.distinct_count").alias("source_count_estimate"),
                none.alias("per_source_rate_distribution"),
            ).alias("entity_hints"),
            none.alias("constraints"),
        ).alias("generation"),
    ))


def validate(recipes: DataFrame) -> DataFrame:
    """One row per (family, broken rule) of the recipe contract."""
    c = F.col
    stats, tags = c("statistics"), c("schema.tag_schema")

    def is_true(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    rules = rule_columns(c, stats, tags)
    broken = F.array_compact(F.array(*[F.when(~is_true(ok), F.lit(name)) for name, ok in rules.items()]))
    return recipes.select("family_id", F.explode(broken).alias("rule"))


def rule_columns(c, stats: Column, tags: Column) -> dict[str, Column]:
    return {
        "version": c("version").rlike(r"^v1\.[0-9]+$"),
        "family_id": c("family_id").rlike("^[a-f0-9]{40}$"),
        "metric_name": c("metric_name").isNotNull(),
        "duration_hours": c("capture_window.duration_hours") >= 0.1,
        "type": c("schema.type").isin("metric", "histogram", "span"),
        "tag_keys": F.forall(F.map_keys(tags), lambda k: k.rlike(TAG_KEY)),
        "tag_types": F.forall(F.map_values(tags), lambda t: t["type"].isin(*TYPES)),
        "presence": F.forall(F.map_values(tags), lambda t: (t["presence"] >= 0) & (t["presence"] <= 1)),
        "cardinality": F.forall(F.map_values(tags), lambda t: t["cardinality"] >= 1),
        "sample_count": stats["sample_count"] >= 1,
        "source_distribution": stats["source_distribution"]["distinct_count"] >= 1,
        "tag_distributions": stats["tag_distributions"].isNotNull(),
        "intensity_curve": (F.size("temporal.intensity_curve") == temporal.MINUTES)
        & F.forall("temporal.intensity_curve", lambda x: x >= 0),
        "burstiness": (c("temporal.burstiness.coefficient_of_variation") >= 0) & (c("temporal.burstiness.fano_factor") >= 0),
        "entity_hints": c("generation.entity_hints.source_count_estimate") >= 1,
    }


def rule_report(recipes: DataFrame) -> DataFrame:
    """Recipes checked and violations per rule, in one pass over the recipes."""
    c = F.col
    rules = rule_columns(c, c("statistics"), c("schema.tag_schema"))
    flags = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1).cast("bigint").alias("bad"))
            for name, ok in rules.items()
        ]
    )
    return recipes.select(F.inline(flags)).groupBy("rule").agg(
        F.count("*").alias("checked"), F.sum("bad").alias("violations")
    )
