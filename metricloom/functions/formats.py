"""Text forms of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BARE_NAME = r"^[a-zA-Z0-9._-]+$"
NEEDS_QUOTES = r'[\s"=]'


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def quote_name(name: Column) -> Column:
    return F.when(name.rlike(BARE_NAME), name).otherwise(_quoted(name))


def quote_tag(value: Column) -> Column:
    return F.when(value.rlike(NEEDS_QUOTES), _quoted(value)).otherwise(value)


def unescape(text: Column) -> Column:
    """Exact inverse of the quoting: strip the quotes, then undo the escapes."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(
        text.startswith('"') & text.endswith('"') & (F.length(text) >= 2),
        F.regexp_replace(inner, r'\\(.)', "$1"),
    ).otherwise(text)


def _fixed(magnitude: Column, digits: int) -> Column:
    """Decimal text with ``digits`` places, rounding the exact binary value half to even.

    ``format_string`` rounds the shortest decimal form half up, which differs on values such as
    2.25 or 0.15. Here the rounding error of ``magnitude * 10^digits`` is recovered with the
    usual split product, so the decision uses the exact product.
    """
    scale = float(10**digits)
    splitter = float(2**27 + 1)
    product = magnitude * scale
    big = magnitude * splitter
    hi = big - (big - magnitude)
    lo = magnitude - hi
    error = ((hi * scale) - product) + lo * scale
    whole = F.floor(product)
    offset = product - whole - 0.5
    up = (offset > 0) | ((offset == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    units = whole + F.when(up, 1).otherwise(0)
    step = 10**digits
    return F.concat(
        F.floor(units / step).cast("string"),
        F.lit("."),
        F.lpad((units % step).cast("string"), digits, "0"),
    )


def fmt_value(value: Column) -> Column:
    """Precision by magnitude: 6, 3, 1 or 0 decimals; NaN and infinities become 0.

    Minus zero keeps its sign, as do small negative values that round to zero.
    """
    size = F.abs(value)
    minus_zero = (value == 0) & value.cast("string").startswith("-")
    sign = F.when((value < 0) | minus_zero, "-").otherwise("")
    return (
        F.when(F.isnan(value) | (size == float("inf")), "0")
        .when(size < 0.001, F.concat(sign, _fixed(size, 6)))
        .when(size < 1, F.concat(sign, _fixed(size, 3)))
        .when(size < 1000, F.concat(sign, _fixed(size, 1)))
        .when(size < 1e37, F.rint(value).cast("decimal(38,0)").cast("string"))
        .otherwise(value.cast("string"))
    )


def fmt_tags(tags: Column) -> Column:
    """`` k=v k=v`` in key order with a leading blank, or an empty string."""
    parts = F.transform(
        F.sort_array(F.map_entries(tags)),
        lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), quote_tag(e["value"])),
    )
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def fmt_metric_line(metric, value_text, ts, source, tags, is_delta=None) -> Column:
    """``name value [ts] source=… tags``; ``ts`` may be null."""
    name = metric if is_delta is None else F.when(is_delta, F.concat(F.lit("∆"), metric)).otherwise(metric)
    stamp = F.coalesce(F.concat(F.lit(" "), ts.cast("string")), F.lit(""))
    return F.concat(
        quote_name(name), F.lit(" "), value_text, stamp,
        F.lit(" source="), quote_tag(source), fmt_tags(tags),
    )


def fmt_metric_line_rounded(metric, value, ts_ms, source, tags, rounded: bool = True) -> Column:
    """Millisecond input, seconds output, value rounded half up, source under ``host``."""
    text = F.floor(value + 0.5).cast("bigint") if rounded else value
    return F.concat(
        metric, F.lit(" "), text.cast("string"), F.lit(" "),
        F.floor(ts_ms / 1000).cast("bigint").cast("string"),
        F.lit(" host="), quote_tag(source), fmt_tags(tags),
    )


def _centroid_text(centroids: Column, count_prefix: str) -> Column:
    return F.array_join(
        F.transform(
            centroids,
            lambda c: F.concat(
                F.lit(" " + count_prefix), c["count"].cast("string"), F.lit(" "), c["value"].cast("string")
            ),
        ),
        "",
    )


def fmt_histogram_inline(granularity, ts, centroids, metric, source, tags) -> Column:
    """``!M ts #c mean #c mean … name source=… tags``"""
    return F.concat(
        F.lit("!"), granularity, F.lit(" "), ts.cast("string"), _centroid_text(centroids, "#"),
        F.lit(" "), quote_name(metric), F.lit(" source="), quote_tag(source), fmt_tags(tags),
    )


def fmt_histogram_header(granularity, ts, hist_count, centroids) -> Column:
    stamp = F.coalesce(F.concat(F.lit(" "), ts.cast("string")), F.lit(""))
    return F.concat(
        F.lit("!"), granularity, stamp, F.lit(" #"), hist_count.cast("string"),
        _centroid_text(centroids, ""),
    )


def fmt_histogram_owner(metric, source, tags) -> Column:
    return F.concat(quote_name(metric), F.lit(" source="), quote_tag(source), fmt_tags(tags))


def fmt_histogram_two_line(granularity, ts, hist_count, centroids, metric, source, tags) -> Column:
    return F.concat_ws(
        "\n",
        fmt_histogram_header(granularity, ts, hist_count, centroids),
        fmt_histogram_owner(metric, source, tags),
    )


def fmt_span_line(operation, source, tags, start_ms, duration_ms) -> Column:
    return F.concat(
        quote_name(operation), F.lit(" source="), quote_tag(source), fmt_tags(tags),
        F.lit(" "), start_ms.cast("string"), F.lit(" "), duration_ms.cast("string"),
    )


def fmt_opentsdb(metric, value, ts, source, tags) -> Column:
    return F.concat(
        F.lit("put "), metric, F.lit(" "), ts.cast("string"), F.lit(" "), value.cast("string"),
        F.lit(" host="), quote_tag(source), fmt_tags(tags),
    )
