"""Tails of common distributions, for a handful of driver-side statistics."""

from __future__ import annotations

import math


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """z with P(Z < z) = p, by bisection on the tail."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - normal_tail(mid) < p else (lo, mid)
    return (lo + hi) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, 1e-300) if 1 + num * d > 0 else 1 / (1 + num * d or 1e-300)
        c = 1 + num / c if c else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > t)."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_tail(x: float, k: float) -> float:
    """P(X > x), by the series of the incomplete gamma function or its continued fraction."""
    if x <= 0:
        return 1.0
    a, h = k / 2, x / 2
    front = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= h / n
            total += term
        return 1 - front * total
    b, c, d = h + 1 - a, 1e300, 1 / (h + 1 - a)
    f = d
    for i in range(1, 500):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def e_value(rr: float) -> float:
    """Strength of confounding that could explain a risk ratio away."""
    r = 1 / rr if rr < 1 else rr
    return r + math.sqrt(r * (r - 1))


def joint_leads(estimates: list[tuple[float, float]]) -> tuple[float, float]:
    """Chi-squared statistic and p of (coefficient, standard error) pairs taken as independent."""
    s = sum((b / e) ** 2 for b, e in estimates if e > 0)
    return s, chi2_tail(s, max(1, len(estimates)))
