"""Distribution functions and small solves, on the driver or inside a task, for what aggregates have reduced to a few numbers."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def two_sided(estimate: float, se: float, df: float | None = None) -> float:
    if not se > 0:
        return float("nan")
    z = abs(estimate / se)
    return 2 * (1 - (t_cdf(z, df) if df else normal_cdf(z)))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x): the ladder of two degrees at a time from df 1 or 2."""
    if x <= 0:
        return 1.0
    tail, k = (math.erfc(math.sqrt(x / 2)), 1) if df % 2 else (math.exp(-x / 2), 2)
    while k < df:
        tail += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        k += 2
    return min(tail, 1.0)


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 10.0 + 10 * df
    while chi2_tail(high, df) > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2
