"""Series spaces: how many metrics, hosts and tags fit a wanted number of series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def weighted_dims(weights: list[Column], target: Column) -> list[Column]:
    """Cardinalities proportional to ``weights`` whose product is about ``target``."""
    n = len(weights)
    product = weights[0]
    for w in weights[1:]:
        product = product * w
    unit = F.pow(target.cast("double"), F.lit(1.0 / n)) / F.pow(product.cast("double"), F.lit(1.0 / n))
    return [F.greatest(F.lit(1), _round_half_up(w * unit)) for w in weights]


def pegged_dims(pegs: list[Column], target: Column) -> list[Column]:
    """Non-zero pegs stay; zeros share what is left of ``target`` evenly."""
    product = F.lit(1).cast("double")
    zeros = F.lit(0)
    for p in pegs:
        product = product * F.when(p == 0, 1).otherwise(p)
        zeros = zeros + F.when(p == 0, 1).otherwise(0)
    share = F.greatest(F.lit(1), _round_half_up(F.pow(target / product, 1.0 / F.greatest(zeros, F.lit(1)))))
    return [F.when(p == 0, share).otherwise(p.cast("bigint")) for p in pegs]
