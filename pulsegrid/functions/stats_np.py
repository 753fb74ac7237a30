"""Tails of distributions in numpy."""

from __future__ import annotations

import math

import numpy as np


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified method of Lentz."""
    tiny, steps = 1e-300, 500
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for k in range(1, steps):
        for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1.0 + term * d, 1.0 + term / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised: the chance that a beta variable of (a, b) is at most x."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _fraction(b, a, 1 - x) / b


def correlation_p(rho: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of correlations of ``n`` pairs, by the t distribution with n - 2 degrees; NaN under three pairs or without a correlation, 0 for a perfect one."""
    out = np.full(len(rho), np.nan)
    for k, (r, m) in enumerate(zip(rho, n, strict=True)):
        if m >= 3 and np.isfinite(r):
            out[k] = incomplete_beta((m - 2) / 2, 0.5, max(0.0, 1.0 - float(r) ** 2))  # v / (v + t^2)
    return out
