"""Tails of distributions, as plain functions of a number; for summary figures on the driver."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, forward by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, dof: float) -> float:
    """The chance of a t at least as far from 0."""
    return beta_share(dof / 2, 0.5, dof / (dof + t * t))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))
