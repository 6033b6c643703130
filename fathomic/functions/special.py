"""Special functions that neither Spark nor the standard library has."""

from __future__ import annotations

import math

import numpy as np


def digamma(x):
    """Digamma for positive arguments: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (low := x < 6).any():
        shift = shift - np.where(low, 1 / np.where(low, x, 1), 0)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


lgamma = np.vectorize(math.lgamma, otypes=[float])


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if math.isnan(x) or math.isnan(a):
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if math.isnan(x):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h / a


def f_sf(f: float, d1: float, d2: float) -> float:
    """Survival function of the F distribution."""
    if math.isnan(f):
        return math.nan
    if math.isinf(f):
        return 0.0
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    return gammaincc(k / 2, x / 2)


def norm_ppf(p: float) -> float:
    """Normal quantile: bisection on erfc, exact to the last bits."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2
