"""Critical values and tail probabilities as literals or closed forms."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=64)
def z_critical(level: float) -> float:
    """Two-sided normal critical value."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def _t_inside(t: float, df: int) -> float:
    """P(|T| < t) for whole degrees of freedom (finite trigonometric sum)."""
    theta = math.atan(t / math.sqrt(df))
    cos2 = math.cos(theta) ** 2
    if df == 1:
        return 2 * theta / math.pi
    term = total = math.cos(theta) if df % 2 else 1.0
    for k in range(3 if df % 2 else 2, df, 2):
        term *= cos2 * (k - 1) / k
        total += term
    inside = math.sin(theta) * total
    return 2 / math.pi * (theta + inside) if df % 2 else inside


@lru_cache(maxsize=512)
def t_critical(level: float, df: int) -> float:
    """Two-sided Student critical value by bisection."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_inside(mid, df) < level else (lo, mid)
    return (lo + hi) / 2


def critical_value(n: Column, level: float, small: int = 30) -> Column:
    """t with n-1 degrees below ``small`` observations, z from there on; NULL below two."""
    table = F.array(*[F.lit(t_critical(level, k)) for k in range(1, small - 1)])
    return F.when(n < 2, None).when(n < small, F.try_element_at(table, (n - 1).cast("int"))).otherwise(z_critical(level))


def chi2_tail_even(q: Column, df: int) -> Column:
    """P(X > q) for an even number of degrees of freedom."""
    half = q / 2
    total = term = F.lit(1.0)
    for k in range(1, df // 2):
        term = term * half / k
        total = total + term
    return F.exp(-half) * total
