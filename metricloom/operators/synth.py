"""Synthetic telemetry tables drawn from recipe statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metricloom.functions.draws import exponential, integer, interpolate, pick, uniform
from metricloom.operators.counts import PROBS, spread_sequence
from metricloom.operators.dims import SOURCE, TAG
from metricloom.schemas import TAGS

# Fallback tag values by keyword, burst and histogram odds.
ENVIRONMENTS = ["prod", "staging", "dev", "test"]
REGIONS = ["us-east-1", "us-west-2", "eu-west-1", "ap-southeast-1"]
BURST_CHANCE = 0.1
HISTOGRAM_CHANCE = 0.1
GRANULARITY_CUM = [("H", 0.2), ("D", 0.24), ("M", 1.0)]
DRIFT_NEW_TAG = 0.5
DRIFT_CHANGED_VALUE = 0.3
PATTERN_PIECE = r"(\\d\+|\\d\{\d+\}|\[a-z\]\+|\[a-z\]\{\d+\}|\[A-Z\]\+|\[A-Z\]\{\d+\}|\[a-zA-Z0-9\]\+|\\[^A-Za-z0-9]|.)"
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()


def with_cumulative(items: DataFrame, keys: list[str], weight: str, order: list[str]) -> DataFrame:
    """Running weight inside each distribution; recipes hold at most 100 items per key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("cum", F.sum(weight).over(w))


def item_arrays(items: DataFrame, keys: list[str], value: str, weight: str, order: str = "rank") -> DataFrame:
    """One array per key, in order, ready for ``draws.pick``."""
    cum = with_cumulative(items, keys, weight, [order])
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("value"), F.col(weight).cast("double").alias("weight"), F.col("cum").cast("double").alias("cum"))))
    return cum.groupBy(*keys).agg(
        F.transform(packed, lambda x: F.struct(x["value"].alias("value"), x["weight"].alias("weight"), x["cum"].alias("cum"))).alias("items")
    )


def running_counts(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, n, _lo, _hi): running counts of all values of a key in the order of their md5.

    Two levels: first within the values that share four hexadecimal digits, then over those groups,
    so no window sees more than 65,536 rows of a key, or one group.
    """
    place = F.md5(F.col(value).cast("string"))
    items = counts.select(*keys, F.col(value).alias("_v"), "n", F.substring(place, 1, 4).alias("_g"), place.alias("_p"))
    groups = with_cumulative(items.groupBy(*keys, "_g").agg(F.sum("n").alias("_gn")), keys, "_gn", ["_g"])
    groups = groups.select(*keys, "_g", (F.col("cum") - F.col("_gn")).alias("_before"))
    inside = W.partitionBy(*keys, "_g").orderBy("_p", "_v").rowsBetween(W.unboundedPreceding, 0)
    out = items.withColumn("_in", F.sum("n").over(inside)).join(groups, [*keys, "_g"])
    return out.select(*keys, "_v", "n", (F.col("_before") + F.col("_in") - F.col("n")).alias("_lo"), (F.col("_before") + F.col("_in")).alias("_hi"))


def draw_values(rows: DataFrame, counts: DataFrame, keys: list[str], value: str, u: str, out: str, how: str = "inner") -> DataFrame:
    """Adds ``out``: a value of the row's key, drawn by its count from all values of the key.

    ``counts`` holds (keys, value, n), ``u`` names a uniform column. The whole count of a key is cut
    into as many equal stretches as it has values; every value is listed under the stretches it
    reaches into, two per stretch on average, and a row looks up its own stretch. So a row meets one
    small table of totals and one equi join, however many values its key has, and a hot key is
    spread over its stretches. With ``how`` "left", rows of keys without counts stay, with null.
    """
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"), F.count("*").alias("_cuts"))
    placed = rows.join(totals, keys, how).withColumn("_t", F.col(u) * F.col("_total"))

    def stretch(x: Column) -> Column:
        return F.least(F.floor(x * F.col("_cuts") / F.col("_total")), F.col("_cuts") - 1)

    items = running_counts(counts, keys, value).join(totals, keys)
    items = items.select(*keys, "_v", "_lo", "_hi", F.explode(F.sequence(stretch(F.col("_lo")), stretch(F.col("_hi")))).alias("_cut"))
    placed = placed.withColumn("_cut", stretch(F.col("_t")))
    left, right = placed.alias("r"), items.alias("i")
    same = [F.col(f"r.{k}") == F.col(f"i.{k}") for k in [*keys, "_cut"]]
    hit = (F.col("i._hi") >= F.col("r._t")) & ((F.col("i._lo") < F.col("r._t")) | (F.col("i._lo") == 0))
    on = hit
    for x in same:
        on = on & x
    return left.join(right, on, how).select(*[F.col(f"r.{x}").alias(x) for x in rows.columns], F.col("i._v").alias(out))


def quantile_value(u: Column, q: Column | None = None) -> Column:
    """Value at probability ``u`` between the true quantile probabilities."""
    get = (lambda name: q[name]) if q is not None else F.col
    return interpolate([(p, get(name)) for name, p in PROBS.items()], u)


def skewed(items: DataFrame, keys: list[str], exponent: Column, weight: str = "frequency") -> DataFrame:
    """Weights raised to ``exponent`` and renormalised."""
    raised = items.withColumn("_w", F.pow(F.col(weight), exponent))
    total = raised.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    return raised.join(total, keys).withColumn("skewed", F.col("_w") / F.col("_t")).drop("_w", "_t")


def expand_pattern(pattern: Column, seed, row: Column) -> Column:
    """String matching a generalised pattern; every piece draws from its own repeatable hash."""

    def chars(alphabet: str, length: Column, at: Column) -> Column:
        return F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.greatest(length, F.lit(1))),
                lambda j: F.substring(
                    F.lit(alphabet),
                    (integer(uniform(seed, row, F.concat_ws(".", F.lit("p"), at, j)), len(alphabet)) + 1).cast("int"),
                    F.lit(1),
                ),
            ),
            "",
        )

    def piece(p: Column, i: Column) -> Column:
        u = uniform(seed, row, F.concat_ws(".", F.lit("n"), i))
        exact = F.regexp_extract(p, r"\{(\d+)\}", 1).try_cast("int")

        def run(alphabet: str, low: int, spread: int) -> Column:
            return chars(alphabet, F.coalesce(exact, (integer(u, spread) + low).cast("int")), i)

        return (
            F.when(p.rlike(r"^\\[^A-Za-z0-9]$"), F.substring(p, 2, 1))
            .when(p.startswith("\\d") & (F.length(p) > 1), run(DIGITS, 1, 4))
            .when(p.startswith("[a-z]"), run(LOWER, 3, 5))
            .when(p.startswith("[A-Z]"), run(UPPER, 3, 5))
            .when(p.startswith("[a-zA-Z0-9]"), run(LOWER + UPPER + DIGITS, 5, 10))
            .otherwise(p)
        )

    pieces = F.regexp_extract_all(pattern, F.lit(PATTERN_PIECE), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p, i: piece(p, i)), "")


def fallback_value(key: Column, seed, row: Column) -> Column:
    """Default tag value by keyword in the key."""
    low = F.lower(key)

    def u(name: str) -> Column:
        return uniform(seed, row, F.concat(F.lit(name + ":"), key))

    def one_of(values: list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (integer(u("v"), len(values)) + 1).cast("int"))

    def number(name: str, n: int) -> Column:
        return integer(u(name), n).cast("string")

    return (
        F.when(low.contains("env"), one_of(ENVIRONMENTS))
        .when(low.contains("region"), one_of(REGIONS))
        .when(low.contains("service"), F.concat(F.lit("service-"), number("v", 100)))
        .when(
            low.contains("version"),
            F.concat(F.lit("v"), number("a", 10), F.lit("."), number("b", 20), F.lit("."), number("c", 100)),
        )
        .otherwise(F.concat(F.lit("value-"), number("v", 1000)))
    )


def draw_source(drawn: Column, patterns: Column, seed, row: Column) -> Column:
    """The value drawn from the distribution first, then a pattern, then ``host-N``."""
    return F.coalesce(
        drawn,
        expand_pattern(pick(patterns, uniform(seed, row, "source-pattern")), seed, row),
        F.concat(F.lit("host-"), integer(uniform(seed, row, "host"), 1000).cast("string")),
    )


def draw_dims(rows: DataFrame, counts: DataFrame, keys: list[str], seed, row: str = "row_key", also: list[str] | None = None) -> DataFrame:
    """(keys, row, also, source, tags) of every row, drawn from all values of every dimension.

    ``rows`` holds keys, ``row`` and ``tag_keys`` array<struct<key, presence>>; ``counts`` holds
    (keys, dim, value, n). Each tag key joins with its presence probability; all picks of all rows
    are drawn in one pass over (row, dimension) and put together again by row. A tag key without
    values falls back to a keyword default; a source without values stays null.
    """
    at, also = F.col(row), also or []
    has = F.filter("tag_keys", lambda t: uniform(seed, at, F.concat(F.lit("has:"), t["key"])) < t["presence"])
    own = F.array(F.struct(F.lit(SOURCE).alias("dim"), uniform(seed, at, "source").alias("_u")))
    tags = F.transform(has, lambda t: F.struct(F.concat(F.lit(TAG), t["key"]).alias("dim"), uniform(seed, at, F.concat(F.lit("tag:"), t["key"])).alias("_u")))
    picks = rows.select(*keys, row, *also, F.inline(F.concat(own, F.coalesce(tags, F.array().cast("array<struct<dim:string,_u:double>>")))))
    drawn = draw_values(picks, counts, [*keys, "dim"], "value", "_u", "_drawn", "left")
    is_tag = F.col("dim") != SOURCE
    key = F.substr("dim", F.lit(len(TAG) + 1))
    tag = F.when(is_tag, F.struct(key.alias("key"), F.coalesce("_drawn", fallback_value(key, seed, at)).alias("value")))
    return drawn.groupBy(*keys, row, *also).agg(
        F.max(F.when(~is_tag, F.col("_drawn"))).alias("source"), F.map_from_entries(F.sort_array(F.collect_list(tag))).cast(TAGS).alias("tags")
    )


def burst(intensity: Column, factor: Column, seed, row: Column) -> Column:
    """One minute in ten is multiplied by up to ``factor``."""
    lifted = intensity * (1.0 + (factor - 1.0) * uniform(seed, row, "burst-size"))
    return F.when((factor > 1.0) & (uniform(seed, row, "burst") < BURST_CHANCE), lifted).otherwise(intensity)


def row_budget(curve: DataFrame, base: DataFrame, keys: list[str], seed, multiplier: Column, burst_factor: Column | None = None) -> DataFrame:
    """Rows to draw per key and minute of day: base rate x intensity x multiplier, rounded up
    with the probability of its fraction."""
    cell = F.concat_ws("|", *keys, "mod")
    rate = F.col("rate")
    if burst_factor is not None:
        rate = burst(rate, burst_factor, seed, cell)
    expected = F.col("base_rate") * rate * multiplier
    return curve.join(base, keys).withColumn("expected", expected).withColumn(
        "rows",
        (F.floor("expected") + F.when(uniform(seed, cell, "round") < F.col("expected") - F.floor("expected"), 1).otherwise(0)).cast("bigint"),
    )


def tag_keys(presence: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: its tag keys with their presence, one entry for each tag key."""
    return presence.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("key", "presence"))).alias("tag_keys"))


def points(budget: DataFrame, families: DataFrame, counts: DataFrame, keys: list[str], seed, day_start: int, value_scale: float = 1.0) -> DataFrame:
    """Synthetic points.

    ``budget`` holds keys, mod (minute of day) and rows; ``families`` holds keys, metric, is_delta,
    p01..p99 and tag_keys, and may hold source_patterns array<struct<value, weight, cum>> for
    families without known sources; ``counts`` holds (keys, dim, value, n) with every source and tag
    value. Rows are numbered and spread first, so a hot family is drawn by many tasks.
    """
    numbered = spread_sequence(budget.select(*keys, "mod", "rows"), [*keys, "mod"], "rows", "i")
    rows = numbered.select(*keys, F.concat_ws("|", *keys, "mod", F.col("i")).alias("row_key"), "mod")
    wanted = rows.join(families.select(*keys, "tag_keys"), keys)
    drawn = draw_dims(wanted, counts, keys, seed, also=["mod"]).join(families.drop("tag_keys"), keys)
    row = F.col("row_key")
    second = integer(uniform(seed, row, "second"), 60)
    patterns = F.col("source_patterns") if "source_patterns" in families.columns else F.lit(None).cast("array<struct<value:string,weight:double,cum:double>>")
    return drawn.select(
        *keys,
        "row_key",
        "metric",
        (quantile_value(uniform(seed, row, "value")) * value_scale).alias("value"),
        (F.lit(day_start) + F.col("mod") * 60 + second).cast("bigint").alias("ts"),
        draw_source(F.col("source"), patterns, seed, row).alias("source"),
        "tags",
        "is_delta",
    )


def arrival_offsets(rows: DataFrame, keys: list[str], seed, kind: str, bucket: str = "mod", order: str = "i") -> DataFrame:
    """Seconds inside the minute.

    ``uniform`` draws independent offsets; ``poisson`` and ``bursty`` accumulate gaps in row
    order and scale them to the minute. The running sum stays within one (key, minute, slice),
    where slices of 10,000 rows cover consecutive parts of the minute.
    """
    row = F.concat_ws("|", *keys, F.col(bucket), F.col(order))
    u = uniform(seed, row, "gap")
    if kind == "uniform":
        return rows.withColumn("offset", u * 60.0)
    gap = exponential(u, F.lit(1.0))
    if kind == "bursty":
        gap = F.when(
            uniform(seed, row, "burst") < BURST_CHANCE, 1.0 / (1.0 + uniform(seed, row, "burst-size"))
        ).otherwise(gap * 2.0)
    sliced = rows.withColumn("_slice", F.floor(F.col(order) / 10_000)).withColumn("_gap", gap)
    sizes = sliced.groupBy(*keys, bucket, "_slice").agg(F.sum("_gap").alias("_len"), F.count("*").alias("_cnt"))
    by_minute = W.partitionBy(*keys, bucket)
    placed = sizes.withColumn(
        "_start", F.sum("_len").over(by_minute.orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("_len")
    ).withColumn("_all", F.sum("_len").over(by_minute) + 1.0)
    inside = W.partitionBy(*keys, bucket, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        sliced.withColumn("_run", F.sum("_gap").over(inside))
        .join(placed.select(*keys, bucket, "_slice", "_start", "_all"), [*keys, bucket, "_slice"])
        .withColumn("offset", (F.col("_start") + F.col("_run")) / F.col("_all") * 60.0)
        .drop("_slice", "_gap", "_run", "_start", "_all")
    )


def histogram_rows(rows: DataFrame, seed, multiplier: float = 1.0) -> DataFrame:
    """Histogram columns for rows that carry ``row_key``: granularity, total count and 1-5
    centroids around 100; the last centroid takes the remainder."""
    row = F.col("row_key")
    u = uniform(seed, row, "granularity")
    gran = F.when(u < GRANULARITY_CUM[0][1], "H").when(u < GRANULARITY_CUM[1][1], "D").otherwise("M")
    k = integer(uniform(seed, row, "centroids"), 5) + 1
    total = F.floor(multiplier * (10 + integer(uniform(seed, row, "count"), 90))).cast("bigint")
    per = F.floor(F.col("hist_count") / F.col("_k")).cast("bigint")
    out = rows.withColumn("granularity", gran).withColumn("_k", k).withColumn("hist_count", total)
    u1 = lambda i: F.greatest(uniform(seed, row, F.concat(F.lit("r"), i)), F.lit(1.0 / 2**52))
    u2 = lambda i: uniform(seed, row, F.concat(F.lit("a"), i))
    normal = lambda i: F.sqrt(-2.0 * F.ln(u1(i))) * F.cos(6.283185307179586 * u2(i))
    return out.withColumn(
        "centroids",
        F.transform(
            F.sequence(F.lit(1).cast("bigint"), F.col("_k")),
            lambda i: F.struct(
                F.when(i == F.col("_k"), F.col("hist_count") - per * (F.col("_k") - 1)).otherwise(per).alias("count"),
                (normal(i.cast("string")) * 50 + 100).alias("value"),
            ),
        ),
    ).drop("_k")


def span_rows(rows: DataFrame, seed) -> DataFrame:
    """Start and exponential duration for rows with ``row_key`` and ``ts``."""
    row = F.col("row_key")
    return rows.withColumn("start_ms", F.col("ts") * 1000 + integer(uniform(seed, row, "ms"), 1000)).withColumn(
        "duration_ms", F.floor(exponential(uniform(seed, row, "duration"), F.lit(0.001))).cast("bigint") + 1
    )


def drift_tags(tags: Column, rate: Column, seed, row: Column) -> Column:
    """Schema drift: with ``rate``, half the rows gain a tag and three in ten change a value."""
    hit = uniform(seed, row, "drift") < rate
    new = F.create_map(
        F.concat(F.lit("drift_tag_"), integer(uniform(seed, row, "drift-key"), 10).cast("string")),
        F.concat(F.lit("value_"), integer(uniform(seed, row, "drift-value"), 100).cast("string")),
    )
    grown = F.when(
        hit & (uniform(seed, row, "drift-add") < DRIFT_NEW_TAG), F.map_concat(F.map_filter(tags, lambda k, _: ~F.map_contains_key(new, k)), new)
    ).otherwise(tags)
    keys = F.sort_array(F.map_keys(grown))
    target = F.try_element_at(keys, (integer(uniform(seed, row, "drift-pick"), F.size(keys)) + 1).cast("int"))
    change = hit & (F.size(keys) > 0) & (uniform(seed, row, "drift-change") < DRIFT_CHANGED_VALUE)
    return F.when(
        change,
        F.transform_values(grown, lambda k, v: F.when(k == target, F.concat(F.lit("drift_"), v)).otherwise(v)),
    ).otherwise(grown)


def scenario_violations(scenarios: DataFrame) -> DataFrame:
    """One row per broken rule of a scenario."""
    rules = {
        "name_required": F.coalesce(F.col("name"), F.lit("")) == "",
        "multiplier_not_positive": F.coalesce(F.col("multiplier"), F.lit(0.0)) <= 0,
        "partitions_not_positive": F.coalesce(F.col("partitions"), F.lit(0)) <= 0,
        "output_path_required": F.coalesce(F.col("output_path"), F.lit("")) == "",
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return scenarios.select("scenario_id", F.explode(broken).alias("rule"))


def glob_regex(glob: Column) -> Column:
    """Anchored regex of a glob with ``*`` and ``?``."""
    quoted = F.regexp_replace(glob, r"([.\\+^$|()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def match_globs(names: DataFrame, name: str, globs: DataFrame, glob: str) -> DataFrame:
    """Names paired with the globs they match, as an equi join.

    A glob is keyed by its literal text before the first wildcard or after the last one, whichever
    is longer; a name offers its own beginnings and ends of just those lengths that some glob has.
    The regex then checks the few candidates. Only the set of different lengths, at most the length
    of a glob, reaches the driver. A glob without literal ends meets every name.
    """
    head = F.regexp_extract(F.col(glob), r"^([^*?]*)", 1)
    tail = F.regexp_extract(F.col(glob), r"([^*?]*)$", 1)
    first = F.length(head) >= F.length(tail)
    keyed = globs.withColumns(
        {"_end": F.when(first, "head").otherwise("tail"), "_text": F.when(first, head).otherwise(tail), "_regex": glob_regex(F.col(glob))}
    )
    sizes = keyed.select("_end", F.length("_text").alias("n")).distinct().collect()
    ends = [
        F.when(
            F.length(name) >= r["n"],
            F.struct(
                F.lit(r["_end"]).alias("_end"),
                (F.substring(name, 1, r["n"]) if r["_end"] == "head" else F.right(F.col(name), F.lit(r["n"]))).alias("_text"),
            ),
        )
        for r in sorted(sizes)
    ]
    offers = F.array_compact(F.array(*ends)) if ends else F.array().cast("array<struct<_end:string,_text:string>>")
    offered = names.select("*", F.inline(offers))
    matched = offered.join(keyed, ["_end", "_text"]).filter(F.expr(f"{name} RLIKE _regex"))
    return matched.select(*names.columns, *globs.columns)
