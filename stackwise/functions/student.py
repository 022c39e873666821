"""Quantiles of Student's t distribution, by bisection on the regularised incomplete beta function.

The continued fraction is the usual one (modified Lentz); the values are needed for one table per (count, level) only.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, lgamma, log, log1p, sqrt


def regularised_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - regularised_beta(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def upper_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    return 0.5 * regularised_beta(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=100_000)
def quantile_from_tail(tail: float, df: float) -> float:
    """t with P(T > t) = tail, for tail up to one half."""
    low, high = 0.0, 1.0
    while upper_tail(high, df) > tail:
        high *= 2
        if high > 1e300:
            return high
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if upper_tail(mid, df) > tail else (low, mid)
    return (low + high) / 2


def esd_critical_value(count: int, significance: float) -> float:
    """The bound that the largest of ``count`` studentised residuals must exceed to be an outlier (two-sided)."""
    df = count - 2
    t = quantile_from_tail(significance / (2 * count), df)
    return (count - 1) * t / sqrt((df + t * t) * count)
