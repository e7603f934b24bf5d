"""Distribution functions for p-values; evaluated on the driver for one row per feature."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by the Lentz method."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    total = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > floor else floor)
            c = 1.0 + numerator / c
            c = c if abs(c) > floor else floor
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return total


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_upper_tail(f: float, df1: float, df2: float) -> float:
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t by bisection on the two-sided tail (p > 0.5)."""
    tail = 2.0 * (1.0 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_two_sided(mid, df) > tail:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse normal CDF by bisection; exact to double precision for 0 < p < 1."""
    lo, hi = -40.0, 40.0
    for _ in range(120):
        mid = 0.5 * (lo + hi)
        if normal_cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson or point-biserial correlation."""
    if n <= 2:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)
