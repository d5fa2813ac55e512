"""Sampling bounds and the logarithmic size code."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: sizes are coded as powers of this base in one byte.
LOG_BASE = 1.1
#: Standard deviations of a Poisson bound, by sample size.
POISSON_DEVIATIONS = ((6.0, 12.0), (16.0, 9.0), (float("inf"), 6.0))


def poisson_upper(s: float) -> float:
    """A mean at which fewer than s events are very unlikely."""
    return max(s + next(d for top, d in POISSON_DEVIATIONS if s < top) * sqrt(s), 1e-10)


def poisson_lower(s: float) -> float:
    """A mean at which more than s events are very unlikely."""
    return max(s - next(d for top, d in POISSON_DEVIATIONS if s < top) * sqrt(s), 1e-15)


def binomial_upper(delta: float, n: int, fraction: float) -> float:
    """A rate at which n trials give fewer than fraction x n successes with a chance below delta."""
    g = -log(delta) / n
    return min(1.0, max(1e-10, fraction + g + sqrt(g * (g + 2 * fraction))))


def binomial_lower(delta: float, n: int, fraction: float) -> float:
    """A rate at which n trials give more than fraction x n successes with a chance below delta."""
    g = -2 * log(delta) / (3 * n)
    return fraction + g - sqrt(g * (g + 3 * fraction))


def fraction_for(sample: int, total: int, replacement: bool = False) -> float:
    """The Bernoulli or Poisson fraction that gives at least sample of total rows in 99.99 % of draws."""
    if replacement:
        return poisson_upper(sample) / total
    return binomial_upper(1e-4, total, sample / total)


def poisson_upper_column(s: Column) -> Column:
    """poisson_upper over a column."""
    s = s.cast("double")
    (low, many), (mid, some), (_, few) = POISSON_DEVIATIONS
    k = F.when(s < low, many).when(s < mid, some).otherwise(few)
    return F.greatest(s + k * F.sqrt(s), F.lit(1e-10))


def binomial_upper_column(delta: float, n: Column, fraction: Column) -> Column:
    """binomial_upper over columns."""
    g = F.lit(-log(delta)) / n
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-10), fraction + g + F.sqrt(g * (g + 2 * fraction))))


def size_code(size: Column) -> Column:
    """A size as a power of LOG_BASE, in 0..255: 0 is 0, 1 is 1, others round up."""
    power = F.ceil(F.log(size.cast("double")) / F.lit(log(LOG_BASE)))
    return F.when(size == 0, 0).when(size <= 1, 1).otherwise(F.least(F.lit(255), power)).cast("int")


def size_decode(code: Column) -> Column:
    """The size that a code stands for."""
    return F.when(code == 0, 0).otherwise(F.floor(F.pow(F.lit(LOG_BASE), code.cast("double")))).cast("long")
