"""Keys, checksums and repeatable strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 32-bit FNV-1a and the 62-character alphabet of repeatable strings.
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 16777619
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
CHARS_PER_LEVEL = 8
CHUNK = 20  # bytes in a SHA-1 digest, one character each


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def family_id(metric: Column, tags: Column) -> Column:
    """SHA-1 of the metric name and its sorted tag keys."""
    keys = F.array_join(F.sort_array(F.map_keys(tags)), ",")
    return F.sha1(F.concat(metric, F.lit("|"), keys))


def span_family_id(operation: Column) -> Column:
    return F.sha1(F.concat(F.lit("span|"), operation))


def tag_pairs(tags: Column) -> Column:
    """Sorted ``k=v`` strings of a tag map."""
    return F.sort_array(
        F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )


def series_id(metric: Column, source: Column, tags: Column) -> Column:
    return F.sha1(F.concat_ws("|", metric, source, F.array_join(tag_pairs(tags), ",")))


def _byte(hex_text: Column, index: Column) -> Column:
    return F.conv(F.substring(hex_text, index * 2 + 1, F.lit(2)), 16, 10).cast("bigint")


def fnv1a(text: Column) -> Column:
    """Signed 32-bit FNV-1a of the UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    unsigned = F.aggregate(
        pairs,
        F.lit(FNV_OFFSET).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(F.conv(b, 16, 10).cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(
            F.lit(0xFFFFFFFF)
        ),
    )
    return F.when(unsigned >= 2**31, unsigned - F.lit(2**32)).otherwise(unsigned)


def _chunk(text: Column, seed: Column) -> Column:
    return once(
        F.sha1(F.concat(seed, text)),
        lambda digest: F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.lit(CHUNK - 1)),
                lambda i: F.substring(F.lit(ALPHABET), (_byte(digest, i) % 62 + 1).cast("int"), F.lit(1)),
            ),
            "",
        ),
    )


def deterministic_string(key: Column, length: int | Column, seed: str = "") -> Column:
    """``length`` characters that depend only on ``key`` and ``seed``; longer requests extend
    shorter ones because each chunk is hashed from all the text before it."""
    if isinstance(length, int) and length <= CHUNK:
        return F.substring(_chunk(key, F.lit(seed)), 1, length)
    size = length if isinstance(length, Column) else F.lit(length)
    rounds = F.ceil(size / F.lit(CHUNK)).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))),
        key,
        lambda acc, _: F.concat(acc, _chunk(acc, F.lit(seed))),
    )
    return F.substring(grown, F.length(key) + 1, size)


def levelled_suffix(prefix: Column, min_levels: int = 0, min_length: int = 0, seed: str = "") -> Column:
    """Append dot-separated repeatable levels until both minimums hold; at least one is added."""
    if min_levels <= 1 and min_length == 0:
        return F.concat(prefix, F.lit("."), deterministic_string(prefix, CHARS_PER_LEVEL, seed))
    levels = F.length(prefix) - F.length(F.replace(prefix, F.lit("."), F.lit(""))) + 1
    missing = F.greatest(F.lit(min_levels - 1) - levels, F.lit(0))
    base = F.aggregate(
        F.filter(F.sequence(F.lit(0), missing), lambda i: i < missing),
        prefix,
        lambda acc, _: F.concat(acc, F.lit("."), deterministic_string(acc, CHARS_PER_LEVEL, seed)),
    )
    tail = F.when(
        F.length(base) + CHARS_PER_LEVEL + 1 < min_length, F.lit(min_length - 1) - F.length(base)
    ).otherwise(F.lit(CHARS_PER_LEVEL))
    return F.concat(base, F.lit("."), deterministic_string(base, tail, seed))
