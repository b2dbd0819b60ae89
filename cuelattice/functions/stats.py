"""Aggregate expressions with defined results on degenerate groups."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are there; null if either is constant or there are no two rows."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.try_divide(F.covar_pop(x, y), spread))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope; null if x is constant."""
    x_, y_ = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.when(F.var_pop(x_) > 1e-12, F.try_divide(F.covar_pop(x_, y_), F.var_pop(x_)))


def standard_error(x: Column) -> Column:
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def interval(x: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Normal-approximation confidence interval of a mean."""
    half = F.lit(z) * standard_error(x)
    return F.avg(x) - half, F.avg(x) + half


def poisson_steps(bits: int = 16) -> list[int]:
    """Where the distribution function of a Poisson number of mean 1 lies on a scale of 2**bits, while it differs from 1 there."""
    steps, total, k = [], 0.0, 0
    while not steps or steps[-1] < (1 << bits) - 1:
        total += math.exp(-1) / math.factorial(k)
        steps.append(math.floor(total * (1 << bits)))
        k += 1
    return steps


def poisson(u: Column, bits: int = 16) -> Column:
    """The Poisson number of mean 1 for a whole number drawn evenly from 0 to 2**bits - 1, by the inverse of its distribution."""
    out = F.lit(0)
    for step in poisson_steps(bits):
        out = out + (u >= step).cast("int")
    return out
