"""Distribution functions that neither Spark nor SQL has, on single numbers of the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = 1 + num / (c or 1e-300)
        out *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (out - 1)


def t_cdf(t: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return 1 - half if t > 0 else half


def t_two_sided(t: float | None, df: float) -> float | None:
    return None if t is None or df <= 0 else 2 * (1 - t_cdf(abs(t), df))


def noncentral_t_cdf(t: float, df: float, delta: float) -> float:
    """By Poisson-weighted incomplete beta functions; for t < 0 mirrored."""
    if t < 0:
        return 1 - noncentral_t_cdf(-t, df, -delta)
    x, h = t * t / (t * t + df), delta * delta / 2
    total = NORMAL.cdf(-delta)
    for j in range(1000):
        p = math.exp(-h + j * math.log(h) - math.lgamma(j + 1)) if h > 0 else float(j == 0)
        q = delta / math.sqrt(2) * (math.exp(-h + j * math.log(h) - math.lgamma(j + 1.5)) if h > 0 else 0.0)
        step = 0.5 * (p * beta_inc(j + 0.5, df / 2, x) + q * beta_inc(j + 1, df / 2, x))
        total += step
        if j > h and abs(step) < 1e-15:
            break
    return min(1.0, max(0.0, total))


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def power(effect: float, n: int, alpha: float = 0.05) -> float:
    """Of a two-sided one-sample t test for an effect in deviations."""
    c = t_quantile(1 - alpha / 2, n - 1)
    d = effect * math.sqrt(n)
    return 1 - noncentral_t_cdf(c, n - 1, d) + noncentral_t_cdf(-c, n - 1, d)


def detectable(n: int, target: float = 0.8) -> float:
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if power(mid, n) < target else (lo, mid)
    return hi


def required_n(effect: float, target: float = 0.8, most: int = 100_000) -> int:
    lo, hi = 2, most
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if power(effect, mid) < target else (lo, mid)
    return lo
