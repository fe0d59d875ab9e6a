"""Parametric fits of value distributions and their Kolmogorov-Smirnov distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from metricloom.operators.counts import cumulative_counts

FAMILIES = ["normal", "log_normal", "exponential", "gamma"]


def parameters(counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Moment estimates per key; log moments use positive values only."""
    c = F.col
    v, n = c(value).cast("double"), c("n").cast("double")
    pos = v > 0
    log = F.when(pos, F.ln(v))
    means = counts.groupBy(*keys).agg(
        F.sum(n).alias("_n"),
        (F.sum(v * n) / F.sum(n)).alias("_mean"),
        F.sum(F.when(pos, n)).alias("_ln"),
        (F.sum(log * n) / F.sum(F.when(pos, n))).alias("_mu"),
    )
    # squares are taken around the means, so a large offset does not cancel the spread away
    around, log_around = v - c("_mean"), log - c("_mu")
    squares = counts.join(means.select(*keys, "_mean", "_mu"), keys).groupBy(*keys).agg(
        F.sum(around * around * n).alias("_q"), F.sum(log_around * log_around * n).alias("_lq")
    )
    s = means.join(squares, keys)
    mean, var = c("_mean"), c("_q") / c("_n")
    mu, lvar = c("_mu"), c("_lq") / c("_ln")
    return s.select(
        *keys,
        c("_n").cast("bigint").alias("n"),
        mean.alias("mean"),
        F.sqrt(var).alias("std"),
        mu.alias("mu"),
        F.sqrt(lvar).alias("sigma"),
        F.when(mean > 0, 1.0 / mean).alias("rate"),
        F.when((mean > 0) & (var > 0), mean * mean / var).alias("shape"),
        F.when((mean > 0) & (var > 0), var / mean).alias("scale"),
    )


def erf(x: Column) -> Column:
    """Rational approximation with absolute error below 1.5e-7 (fixed coefficients)."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / F.sqrt(F.lit(2.0))))


LARGE_SHAPE = 1e4  # from here on the uniform expansion is exact to about 1e-9


def _log_gamma(a: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 10."""
    shifted, lift = a.copy(), np.zeros_like(a)
    for _ in range(10):
        lift += np.log(shifted)
        shifted += 1.0
    return (
        (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * np.log(2 * np.pi)
        + 1 / (12 * shifted) - 1 / (360 * shifted**3) - lift
    )


def _gamma_series(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Power series below a + 1, until no term of the batch counts any more."""
    term = 1.0 / a
    total, i = term.copy(), 0
    while (term > 1e-16 * total).any():
        i += 1
        term = term * z / (a + i)
        total += term
    return np.exp(a * np.log(z) - z - _log_gamma(a)) * total


def _gamma_fraction(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """One less the continued fraction above a + 1, until no factor of the batch changes it."""
    tiny = 1e-300
    b = z + 1.0 - a
    c = np.full_like(a, 1.0 / tiny)
    d = 1.0 / b
    h, i, change = d.copy(), 0, np.full_like(a, 2.0)
    while (np.abs(change - 1.0) > 1e-15).any():
        i += 1
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        change = d * c
        h = h * change
        if i > 20 * np.sqrt(a.max()) + 2000:  # rounding keeps the last digit moving
            break
    return 1.0 - np.exp(a * np.log(z) - z - _log_gamma(a)) * h


def _gamma_uniform(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Uniform asymptotic expansion for large shapes, first correction included."""
    mu = z / a - 1.0
    small = np.abs(mu) < 1e-3
    m = np.where(small, mu, 0.0)
    half = np.where(small, m * m * (0.5 - m * (1 / 3 - m * (0.25 - m * 0.2))), mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2.0 * half)
    safe = np.where(small, 1.0, mu), np.where(small, 1.0, eta)
    first = np.where(small, -1 / 3 + eta / 12, 1.0 / safe[0] - 1.0 / safe[1])
    tail = 0.5 * np.array([math.erfc(x) for x in -eta * np.sqrt(a / 2.0)])
    return tail - np.exp(-0.5 * a * eta * eta) / np.sqrt(2 * np.pi * a) * first


def gamma_cdf_values(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function; each branch runs until it has converged."""
    out = np.full(len(a), np.nan)
    known = np.isfinite(a) & ~np.isnan(z) & (a > 0)
    out[known & (z <= 0)] = 0.0
    out[known & np.isinf(z) & (z > 0)] = 1.0
    rest = known & (z > 0) & np.isfinite(z)
    large = a >= LARGE_SHAPE
    with np.errstate(all="ignore"):
        for branch, rows in (
            (_gamma_uniform, rest & large), (_gamma_series, rest & ~large & (z < a + 1)), (_gamma_fraction, rest & ~large & (z >= a + 1))
        ):
            if rows.any():
                out[rows] = branch(a[rows], z[rows])
    return np.clip(out, 0.0, 1.0)


@F.pandas_udf(DoubleType())
def gamma_cdf(shape: pd.Series, x: pd.Series) -> pd.Series:
    """``gamma_cdf_values`` on whole Arrow batches."""
    return pd.Series(gamma_cdf_values(shape.to_numpy(dtype=float, na_value=np.nan), x.to_numpy(dtype=float, na_value=np.nan)))


def cdf(kind: str, x: Column) -> Column:
    c = F.col
    if kind == "normal":
        return F.when(c("std") > 0, normal_cdf((x - c("mean")) / c("std")))
    if kind == "log_normal":
        return F.when(c("sigma") > 0, F.when(x > 0, normal_cdf((F.ln(x) - c("mu")) / c("sigma"))).otherwise(0.0))
    if kind == "exponential":
        return F.when(c("rate").isNotNull(), F.when(x > 0, 1.0 - F.exp(-c("rate") * x)).otherwise(0.0))
    return F.when(c("shape").isNotNull(), gamma_cdf(c("shape"), x / c("scale")))


def p_value(d: Column, n: Column) -> Column:
    """Asymptotic Kolmogorov p-value."""
    root = F.sqrt(n)
    lam = (root + 0.12 + 0.11 / root) * d
    total = F.lit(0.0)
    for k in range(1, 11):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_statistics(counts: DataFrame, params: DataFrame, keys: list[str], kinds: list[str] = FAMILIES, value: str = "value") -> DataFrame:
    """KS distance of every fitted family: largest gap at, or just below, any observed value."""
    steps = cumulative_counts(counts, keys, value).withColumnRenamed("n", "here").join(params, keys)
    v = F.col(value).cast("double")
    at = F.col("cum") / F.col("total")
    below = (F.col("cum") - F.col("here")) / F.col("total")
    aggs = [
        F.max(F.greatest(F.abs(at - F.col(f"_{k}")), F.abs(F.col(f"_{k}") - below))).alias(f"ks_{k}")
        for k in kinds
    ]
    return steps.select("*", *[cdf(k, v).alias(f"_{k}") for k in kinds]).groupBy(*keys).agg(*aggs)


def best_fit(params: DataFrame, ks: DataFrame, keys: list[str], kinds: list[str] = FAMILIES) -> DataFrame:
    """The family with the smallest distance, its parameters, distance and p-value."""
    options = F.sort_array(
        F.filter(
            F.array(*[F.struct(F.col(f"ks_{k}").alias("ks"), F.lit(k).alias("type")) for k in kinds]),
            lambda o: o["ks"].isNotNull(),
        )
    )
    best = F.try_element_at(options, F.lit(1))
    values = {
        "normal": ("mean", "std"),
        "log_normal": ("mu", "sigma"),
        "exponential": ("rate",),
        "gamma": ("shape", "scale"),
    }
    chosen = F.lit(None).cast("map<string,double>")
    for k in kinds:
        pairs = [x for name in values[k] for x in (F.lit(name), F.col(name))]
        chosen = F.when(F.col("_best.type") == k, F.create_map(*pairs)).otherwise(chosen)
    return params.join(ks, keys).withColumn("_best", best).select(
        *keys,
        F.col("_best.type").alias("type"),
        chosen.alias("parameters"),
        F.col("_best.ks").alias("ks_statistic"),
        p_value(F.col("_best.ks"), F.col("n").cast("double")).alias("ks_p_value"),
    )
