"""Small matrices on the driver, from one aggregation over the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cross_products(df: DataFrame, cols: list[Column | str], weight: Column | None = None) -> tuple[np.ndarray, float]:
    """X'WX of the given columns and the number of rows, in one pass. The result is as wide as the model, however many
    rows there are. The sums are of deviations from the columns' means, put back afterwards, so large means cost no digits."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    k = len(cs)
    w = F.lit(1.0) if weight is None else weight
    m = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cs))).collect()[0]
    if not m.n:
        return np.zeros((k, k)), 0
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(k)])
    d = [c - F.lit(float(x)) for c, x in zip(cs, mean)]
    aggs = [F.sum(w).alias("w")] + [F.sum(w * x).alias(f"s{i}") for i, x in enumerate(d)] + [F.sum(w * d[i] * d[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    s = df.agg(*aggs).collect()[0]
    sums = np.array([s[f"s{i}"] for i in range(k)])
    c = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            c[i, j] = c[j, i] = s[f"c{i}_{j}"]
    return c + np.outer(sums, mean) + np.outer(mean, sums) + s["w"] * np.outer(mean, mean), m.n


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, sample covariance matrix and n of complete rows, in one pass."""
    k = len(cols)
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))]
    r = df.agg(*aggs).collect()[0]
    c = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(i, k):
            v = r[f"c{i}_{j}"]
            c[i, j] = c[j, i] = np.nan if v is None else v
    return np.array([np.nan if r[f"m{i}"] is None else r[f"m{i}"] for i in range(k)]), c, r.n


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """a^-1 b, or None for a singular a."""
    d = np.sqrt(np.abs(np.diag(a)))
    d[d == 0] = 1
    scaled = a / np.outer(d, d)
    if not np.all(np.isfinite(scaled)) or np.linalg.cond(scaled) > 1e14:
        return None
    return np.linalg.solve(scaled, (b.T / d).T).T.__truediv__(d).T if b.ndim > 1 else np.linalg.solve(scaled, b / d) / d


def inverse(a: np.ndarray) -> np.ndarray | None:
    return solve(a, np.eye(len(a)))
