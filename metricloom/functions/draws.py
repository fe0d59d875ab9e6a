"""Repeatable random draws.

A draw depends only on (seed, row, dimension), never on partitioning, so a lost task recomputes
the same rows and two runs with different parallelism agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.keys import once

TINY = 1.0 / 2**52


def uniform(seed: int | str, row: Column, dim: str | Column) -> Column:
    dim = dim if isinstance(dim, Column) else F.lit(dim)
    text = F.concat_ws("|", F.lit(str(seed)), row.cast("string"), dim)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def standard_normal(seed, row: Column, dim: str) -> Column:
    """Box-Muller from two uniforms."""
    u1 = F.greatest(uniform(seed, row, dim + ":r"), F.lit(TINY))
    u2 = uniform(seed, row, dim + ":a")
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)


def log_normal(seed, row: Column, dim: str, mu: Column, sigma: Column) -> Column:
    return F.exp(mu + sigma * standard_normal(seed, row, dim))


def exponential(u: Column, rate: Column) -> Column:
    return -F.ln(F.greatest(1.0 - u, F.lit(TINY))) / rate


def integer(u: Column, n: int | Column) -> Column:
    """0..n-1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(u * n).cast("bigint")


def pick(items: Column, u: Column) -> Column:
    """Weighted pick from ``array<struct<value, weight, cum>>``.

    The first item whose cumulative weight reaches ``u * total``; equal chances when all weights
    are zero. The arrays come from recipes, which hold at most 100 entries.
    """
    total = F.element_at(items, -1)["cum"]
    # the draw is hashed once, not once per item
    weighted = once(
        u * total, lambda target: F.try_element_at(F.filter(items, lambda x: x["cum"] >= target), F.lit(1))["value"]
    )
    even = F.element_at(items, (F.floor(u * F.size(items)) + 1).cast("int"))["value"]
    return (
        F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(None))
        .when(total <= 0, even)
        .otherwise(F.coalesce(weighted, F.element_at(items, -1)["value"]))
    )


def interpolate(knots: list[tuple[float, Column]], p: Column) -> Column:
    """Inverse CDF, piecewise linear through (probability, value), flat outside the knots."""
    expr = F.when(p <= knots[0][0], knots[0][1])
    for (p0, v0), (p1, v1) in zip(knots, knots[1:]):
        expr = expr.when(p <= p1, v0 + (v1 - v0) * ((p - p0) / (p1 - p0)))
    return expr.otherwise(knots[-1][1])
