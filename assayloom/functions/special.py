"""Special functions in vectorised numpy: gamma family, incomplete beta and gamma, tails of t, normal, chi-square and F."""

from __future__ import annotations

import math

import numpy as np


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta, by its continued fraction on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (z > 0) & (z < 1)
    zz = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(zz) + q * np.log1p(-zz)) / p
    tiny = 1e-300
    c, d = np.ones_like(zz), 1 - (p + q) * zz / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * zz / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * zz / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    out = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(flip, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|); infinite df means normal, NaN stays."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    normal = np.isinf(df)
    d = np.where(normal | ~(df > 0), 1.0, df)
    tt = np.where(np.isfinite(t), t, 0.0)
    p = np.where(normal, _erfc(np.abs(tt) / math.sqrt(2)), betainc(d / 2, 0.5, d / (d + tt * tt)))
    return np.where(np.isnan(t) | ~(df > 0), np.nan, np.where(np.isinf(t), 0.0, p))


def bisect(f, lo: float, hi: float, steps: int = 200) -> float:
    """Root of an increasing f."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return (lo + hi) / 2


def normal_quantile(p: float) -> float:
    return bisect(lambda z: 1 - 0.5 * math.erfc(z / math.sqrt(2)) - p, -40, 40)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of t for 0.5 <= p < 1."""
    if math.isinf(df):
        return normal_quantile(p)
    hi = 1.0
    while float(t_two_sided(hi, df)) / 2 > 1 - p:
        hi *= 2
    return bisect(lambda x: (1 - p) - float(t_two_sided(x, df)) / 2, 0, hi, 100)


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2, x / 2)


def hypergeometric_sf(k: int, population: int, success: int, draws: int) -> float:
    """P(X >= k)."""
    top = min(success, draws)
    if k <= max(0, draws + success - population):
        return 1.0
    if k > top:
        return 0.0
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    whole = choose(population, draws)
    return min(1.0, math.fsum(math.exp(choose(success, i) + choose(population - success, draws - i) - whole) for i in range(k, top + 1)))
