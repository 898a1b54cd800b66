"""Scalar special functions for the few statistics evaluated per group.

scipy is not available; the Student-t tail is computed from the regularised
incomplete beta function by its continued fraction (Lentz's method).
"""

from __future__ import annotations

import math


def _betacf(a: float, b: float, x: float, iters: int = 300, eps: float = 3e-16) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(r, n) -> float:
    """Two-sided p-value of a Pearson coefficient ``r`` over ``n`` pairs."""
    if r is None or n is None or (isinstance(r, float) and math.isnan(r)) or n < 3:
        return float("nan")
    df = n - 2.0
    r = max(min(float(r), 1.0), -1.0)
    if abs(r) == 1.0:
        return 0.0
    t2 = r * r * df / (1.0 - r * r)
    return betainc(df / 2.0, 0.5, df / (df + t2))
