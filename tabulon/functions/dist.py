"""Distribution functions in NumPy and the standard library: normal, t, chi-square, F, binomial, studentized range."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

NAN = float("nan")


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: a series for small x, a continued fraction for large."""
    if not (a > 0 and x >= 0):
        return NAN
    if x == 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    return _gamma_series(a, x) if x < a + 1 else 1.0 - _gamma_fraction(a, x)


def gamma_q(a: float, x: float) -> float:
    if not (a > 0 and x >= 0):
        return NAN
    if x == 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    return 1.0 - _gamma_series(a, x) if x < a + 1 else _gamma_fraction(a, x)


def _gamma_series(a: float, x: float) -> float:
    term = total = 1.0 / a
    n = a
    for _ in range(100_000):
        n += 1
        term *= x / n
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if not (a > 0 and b > 0) or math.isnan(x):
        return NAN
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_pdf(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _inverse(cdf, p: float, low: float, high: float) -> float:
    """The point at which a rising function reaches p, by bisection."""
    while cdf(low) > p and low > -1e300:
        low *= 2
    while cdf(high) < p and high < 1e300:
        high *= 2
    for _ in range(400):
        mid = 0.5 * (low + high)
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return 0.5 * (low + high)


def norm_inv(p: float) -> float:
    if not 0 < p < 1:
        return NAN if not 0 <= p <= 1 else math.copysign(math.inf, p - 0.5)
    return -_inverse(norm_cdf, 1 - p, -1.0, 1.0) if p > 0.5 else _inverse(norm_cdf, p, -1.0, 1.0)


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else (0.0 if df > 0 and math.isinf(t) else NAN)


def t_cdf(t: float, df: float) -> float:
    half = 0.5 * t_two_sided(t, df)
    return 1 - half if t > 0 else half


def t_inv(p: float, df: float) -> float:
    return _inverse(lambda x: t_cdf(x, df), p, -1.0, 1.0)


def chi2_upper(x: float, df: float) -> float:
    return gamma_q(df / 2, max(0.0, x) / 2) if df > 0 else NAN


def chi2_inv(p: float, df: float) -> float:
    return _inverse(lambda x: 1 - chi2_upper(x, df), p, 0.0, max(1.0, df))


def f_upper(f: float, d1: float, d2: float) -> float:
    if not (d1 > 0 and d2 > 0) or math.isnan(f):
        return NAN
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def binom_pmf(k: int, n: int, p: float) -> float:
    if p in (0.0, 1.0):
        return float(k == n * p)
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binom_test(k: int, n: int, p: float = 0.5, side: str = "two") -> float:
    """The exact binomial test; two-sided: all outcomes no likelier than k. Tails are incomplete beta functions, and the
    other tail's end is found by bisection, so that n may be large."""
    lower = lambda i: 0.0 if i < 0 else 1.0 if i >= n else beta_inc(n - i, i + 1, 1 - p)
    upper = lambda i: 1.0 if i <= 0 else 0.0 if i > n else beta_inc(i, n - i + 1, p)
    if side == "less":
        return lower(k)
    if side == "greater":
        return upper(k)
    limit, mode = binom_pmf(k, n, p) * (1 + 1e-12 + 1e-15 * n), min(n, int((n + 1) * p))
    if binom_pmf(mode, n, p) <= limit:
        return 1.0
    falls = k < mode  # the other tail is above the mode: its first outcome that is no likelier; else below: its last one
    a, b = (mode, n + 1) if falls else (-1, mode)
    while b - a > 1:
        mid = (a + b) // 2
        if (binom_pmf(mid, n, p) <= limit) == falls:
            b = mid
        else:
            a = mid
    return min(1.0, lower(k) + upper(b)) if falls else min(1.0, lower(a) + upper(k))


def hypergeom_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2 x 2 table: all tables of these margins that are no likelier."""
    r1, c1, n = a + b, a + c, a + b + c + d
    ln = lambda k: math.lgamma(r1 + 1) + math.lgamma(n - r1 + 1) + math.lgamma(c1 + 1) + math.lgamma(n - c1 + 1) - math.lgamma(n + 1) - sum(math.lgamma(x + 1) for x in (k, r1 - k, c1 - k, n - r1 - c1 + k))
    p = [math.exp(ln(k)) for k in range(max(0, r1 + c1 - n), min(r1, c1) + 1)]
    seen = math.exp(ln(a))
    return min(1.0, sum(x for x in p if x <= seen * (1 + 1e-7)))


@lru_cache
def _legendre(n: int):
    return np.polynomial.legendre.leggauss(n)


def _range_cdf(w: float, k: int) -> float:
    """The chance that the range of k standard normals is at most w."""
    if w <= 0:
        return 0.0
    x, weight = _legendre(96)
    z = 8.0 * x
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    upper = np.array([norm_cdf(v) for v in z])
    lower = np.array([norm_cdf(v - w) for v in z])
    return float(min(1.0, 8.0 * np.sum(weight * k * phi * np.maximum(0.0, upper - lower) ** (k - 1))))


def q_range_upper(q: float, k: int, df: float) -> float:
    """The upper tail of the studentized range of k means with df degrees of freedom."""
    if not (k >= 2 and df > 0) or math.isnan(q):
        return NAN
    if q <= 0:
        return 1.0
    if df > 5000:
        return max(0.0, 1 - _range_cdf(q, k))
    x, weight = _legendre(64)
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - spread), 1 + spread + 1 / df
    s = 0.5 * (high - low) * x + 0.5 * (high + low)
    density = np.exp(math.log(2) + 0.5 * df * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - 0.5 * df * s * s)
    inner = np.array([_range_cdf(q * v, k) for v in s])
    return float(min(1.0, max(0.0, 1 - 0.5 * (high - low) * np.sum(weight * density * inner))))


def q_range_inv(p: float, k: int, df: float) -> float:
    return _inverse(lambda q: 1 - q_range_upper(q, k, df), p, 0.0, 4.0)


def kolmogorov_upper(x: float) -> float:
    """The asymptotic tail of Kolmogorov's statistic."""
    if x <= 0:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))
