"""Rank tests, exact tests and tests of normality."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ROW, num, numbers, text, with_row, table
from ..functions import dist
from .describe import points, ranked_counts
from .running import running_sums

ENUMERATED = 2_000_000


def one_row(df: DataFrame, kind: str, *values) -> DataFrame:
    """A result of one row, or of none if the values are missing."""
    return table(df.sparkSession, [values] if values else [], kind)


def midranks(values: DataFrame, col: str) -> DataFrame:
    """Distinct values with their count _c, midrank rank and the number of values _n."""
    return ranked_counts(values, col).withColumn("rank", F.col("_cum") - (F.col("_c") - 1) / 2)


def group_ranks(df: DataFrame, value: str, key: str) -> tuple[list, float, int]:
    """Per group n, rank sum; and the tie term and the number of values. Ranks come from distinct values with counts."""
    v = numbers(df, value, keep=(key,))
    counts = v.groupBy(F.col(key).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    all_ = running_sums(counts.groupBy("v").agg(F.sum("k").alias("_c")), "v", {"_cum": "_c"}).withColumn("rank", F.col("_cum") - (F.col("_c") - 1) / 2)
    ties = all_.agg(F.sum(F.pow("_c", 3) - F.col("_c")).alias("t"), F.sum("_c").alias("n")).collect()[0]
    groups = counts.join(all_, "v").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r")).orderBy("g").collect()  # a row per group
    return groups, float(ties.t or 0), int(ties.n or 0)


def mann_whitney(df: DataFrame, value: str, key: str, compat: bool = False) -> DataFrame:
    """U of the first group, z with ties and continuity, normal p. compat: at U = mu the correction still applies."""
    g, t, n = group_ranks(df, value, key)
    kind = "group1 string, group2 string, n1 long, n2 long, rank_sum1 double, rank_sum2 double, u double, z double, p double"
    if len(g) != 2:
        return one_row(df, kind)
    n1, n2 = g[0].n, g[1].n
    u1 = g[0].r - n1 * (n1 + 1) / 2
    u, mu = min(u1, n1 * n2 - u1), n1 * n2 / 2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))) if n > 1 else 0.0
    shift = 0.5 if u < mu or compat else 0.0
    z = (u - mu + shift) / sd if sd else 0.0
    return one_row(df, kind, g[0].g, g[1].g, n1, n2, float(g[0].r), float(g[1].r), float(u), float(z), dist.norm_two_sided(z))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of the differences that aren't 0, five at least."""
    d = numbers(df, a, b).select((F.col(b) - F.col(a)).alias("d")).where("abs(d) >= 1e-12").withColumn("v", F.abs("d"))
    r = midranks(d, "v")
    s = d.groupBy("v").agg(F.sum((F.col("d") > 0).cast("long")).alias("up"), F.sum((F.col("d") < 0).cast("long")).alias("down")).join(r, "v").agg(F.sum(F.col("up") * F.col("rank")).alias("plus"), F.sum(F.col("down") * F.col("rank")).alias("minus"), F.sum("_c").alias("n"), F.sum(F.pow("_c", 3) - F.col("_c")).alias("t")).collect()[0]
    kind = "n long, w_plus double, w_minus double, z double, p double"
    if (s.n or 0) < 5:
        return one_row(df, kind)
    n, mu = s.n, s.n * (s.n + 1) / 4
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - s.t / 48)
    diff = s.plus - mu
    z = (diff - math.copysign(0.5, diff)) / sd if diff and sd else 0.0
    return one_row(df, kind, n, float(s.plus), float(s.minus), z, dist.norm_two_sided(z))


def kruskal(df: DataFrame, value: str, key: str) -> DataFrame:
    g, t, n = group_ranks(df, value, key)
    kind = "h double, df long, p double, n long"
    if len(g) < 2 or n < 3:
        return one_row(df, kind)
    h = 12 / (n * (n + 1)) * sum(x.r**2 / x.n for x in g) - 3 * (n + 1)
    h /= (1 - t / (n**3 - n)) or 1
    return one_row(df, kind, float(h), len(g) - 1, dist.chi2_upper(h, len(g) - 1), n)


def _row_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Complete rows' midranks across the columns (r), and the row's tie term (t)."""
    v = numbers(df, *cols).select(F.array(*cols).alias("a"))
    rank = lambda x: F.aggregate("a", F.lit(0.0), lambda s, y: s + F.when(y < x, 1.0).when(y == x, 0.5).otherwise(0.0)) + 0.5
    same = lambda x: F.aggregate("a", F.lit(0.0), lambda s, y: s + (y == x).cast("double"))
    return v.select(F.transform("a", rank).alias("r"), F.aggregate("a", F.lit(0.0), lambda s, x: s + same(x) * same(x) - 1).alias("t"))


def friedman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Friedman's chi-square with ties, and Kendall's W = chi2 / (n (k - 1))."""
    k = len(cols)
    s = _row_ranks(df, cols).agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"), *(F.sum(F.col("r")[i]).alias(f"r{i}") for i in range(k))).collect()[0]
    kind = "chi2 double, df long, p double, n long, kendall_w double"
    if k < 3 or s.n < 2:
        return one_row(df, kind)
    n = s.n
    chi = 12 / (n * k * (k + 1)) * sum(s[f"r{i}"] ** 2 for i in range(k)) - 3 * n * (k + 1)
    c = 1 - s.t / (n * k * (k * k - 1))
    chi = chi / c if c > 0 else 0.0
    return one_row(df, kind, chi, k - 1, dist.chi2_upper(chi, k - 1), n, chi / (n * (k - 1)))


def kendall_w(df: DataFrame, cols: Sequence[str], compat: bool = False) -> DataFrame:
    """Agreement of n rows on the ranks of k columns. compat: W = chi2 / (k (n - 1)) with n - 1 degrees of freedom."""
    f = friedman(df, cols).collect()
    kind = "w double, chi2 double, df long, p double, n long"
    if not f:
        return one_row(df, kind)
    chi, n, k = f[0].chi2, f[0].n, len(cols)
    w, d = (chi / (k * (n - 1)), n - 1) if compat else (chi / (n * (k - 1)), k - 1)
    return one_row(df, kind, w, chi, d, dist.chi2_upper(chi, d), n)


def cochran_q(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells above 0.5 are successes; missing ones are not."""
    k, v = len(cols), df.select(*((F.coalesce(num(df, c), F.lit(0.0)) > 0.5).cast("long").alias(c) for c in cols))
    row = sum((F.col(c) for c in cols), F.lit(0))
    s = v.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("g"), F.sum(row * row).alias("r2"), *(F.sum(c).alias(f"c{i}") for i, c in enumerate(cols))).collect()[0]
    below = k * (s.g or 0) - (s.r2 or 0)
    q = (k - 1) * (k * sum((s[f"c{i}"] or 0) ** 2 for i in range(k)) - (s.g or 0) ** 2) / below if below else 0.0
    return one_row(df, "q double, df long, p double, n long", float(q), k - 1, dist.chi2_upper(q, k - 1), s.n)


def sign_test(df: DataFrame, a: str, b: str) -> DataFrame:
    s = numbers(df, a, b).agg(F.count_if(F.col(b) > F.col(a)).alias("up"), F.count_if(F.col(b) < F.col(a)).alias("down"), F.count_if(F.col(b) == F.col(a)).alias("same")).collect()[0]
    n = s.up + s.down
    return one_row(df, "plus long, minus long, ties long, p double", s.up, s.down, s.same, dist.binom_test(min(s.up, s.down), n) if n else 1.0)


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a) > 0.5, F.col(b) > 0.5
    s = numbers(df, a, b).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d")).collect()[0]
    n = s.b + s.c
    chi = (abs(s.b - s.c) - 1) ** 2 / n if n else 0.0
    return one_row(df, "n11 long, n10 long, n01 long, n00 long, chi2 double, p double, exact_p double", s.a, s.b, s.c, s.d, float(chi), dist.chi2_upper(chi, 1), dist.binom_test(min(s.b, s.c), n) if n else 1.0)


def runs_test(df: DataFrame, col: str, order: list[str], cut: float | str = "median") -> DataFrame:
    """Runs of values at or above the cut, in row order; a continuity correction below 50 values."""
    v = df.select(num(df, col).alias("v"), *(c for c in order if c != col)).where("v IS NOT NULL")
    at = cut if not isinstance(cut, str) else points(v, "v", (0.5,))[0] if cut == "median" else v.agg(F.avg("v")).collect()[0][0]
    kind = "cut double, n1 long, n0 long, runs long, z double, p double"
    if at is None:
        return one_row(df, kind)
    w = with_row(v, [c for c in order if c in v.columns]).withColumn("x", (F.col("v") >= at).cast("int"))
    # the row before is found by number: a window without partitions would put all rows in one task
    prev = w.select((F.col(ROW) + 1).alias(ROW), F.col("x").alias("p"))
    s = w.join(prev, ROW, "left").agg(F.count_if(F.col("x") == 1).alias("n1"), F.count_if(F.col("x") == 0).alias("n0"), F.count_if(F.col("p").isNull() | (F.col("p") != F.col("x"))).alias("runs")).collect()[0]
    n1, n0, n = s.n1, s.n0, s.n1 + s.n0
    if not n1 or not n0:
        return one_row(df, kind, float(at), n1, n0, s.runs, 0.0, 1.0)
    mu, var = 2 * n1 * n0 / n + 1, 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
    diff = s.runs - mu
    if n < 50:
        diff = 0.0 if abs(diff) <= 0.5 else diff - math.copysign(0.5, diff)
    z = diff / math.sqrt(var) if var > 0 else 0.0
    return one_row(df, kind, float(at), n1, n0, s.runs, z, dist.norm_two_sided(z))


def binomial(df: DataFrame, col: str, success: str, p: float = 0.5, side: str = "two") -> DataFrame:
    s = df.select(text(F.col(col)).alias("t")).dropna().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == success).alias("k")).collect()[0]
    return one_row(df, "k long, n long, share double, p double", s.k, s.n, s.k / s.n if s.n else None, dist.binom_test(s.k, s.n, p, side) if s.n else None)


def proportion(df: DataFrame, col: str, success: str, p0: float = 0.5, level: float = 0.95) -> DataFrame:
    """Wilson interval, z and exact test of one share."""
    s = df.select(text(F.col(col)).alias("t")).dropna().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == success).alias("k")).collect()[0]
    kind = "k long, n long, share double, low double, high double, z double, p double, exact_p double"
    if not s.n:
        return one_row(df, kind)
    p, n, q = s.k / s.n, s.n, dist.norm_inv(0.5 + level / 2)
    mid, half = (p + q * q / (2 * n)) / (1 + q * q / n), q / (1 + q * q / n) * math.sqrt(p * (1 - p) / n + q * q / (4 * n * n))
    z = (p - p0) / math.sqrt(p0 * (1 - p0) / n)
    return one_row(df, kind, s.k, n, p, mid - half, mid + half, z, dist.norm_two_sided(z), dist.binom_test(s.k, n, p0))


def two_proportions(df: DataFrame, col: str, key: str, success: str, level: float = 0.95) -> DataFrame:
    """Difference, z, chi-square, Fisher's p, odds and risk ratios with intervals, for two groups."""
    g = df.select(text(F.col(col)).alias("t"), text(F.col(key)).alias("g")).dropna().groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t") == success).alias("k")).orderBy("g").collect()  # a row per group
    kind = "share1 double, share2 double, difference double, z double, p double, chi2 double, fisher_p double, odds_ratio double, or_low double, or_high double, risk_ratio double, rr_low double, rr_high double"
    if len(g) != 2:
        return one_row(df, kind)
    a, b, c, d = g[0].k, g[0].n - g[0].k, g[1].k, g[1].n - g[1].k
    p1, p2, pool = a / g[0].n, c / g[1].n, (a + c) / (g[0].n + g[1].n)
    se = math.sqrt(pool * (1 - pool) * (1 / g[0].n + 1 / g[1].n))
    z, q = ((p1 - p2) / se if se else 0.0), dist.norm_inv(0.5 + level / 2)
    e = [x + 0.5 for x in (a, b, c, d)] if 0 in (a, b, c, d) else [a, b, c, d]
    odds, so = e[0] * e[3] / (e[1] * e[2]), math.sqrt(sum(1 / x for x in e))
    n1, n2 = e[0] + e[1], e[2] + e[3]
    rr, sr = (e[0] / n1) / (e[2] / n2), math.sqrt(1 / e[0] - 1 / n1 + 1 / e[2] - 1 / n2)
    return one_row(df, kind, p1, p2, p1 - p2, z, dist.norm_two_sided(z), z * z, dist.hypergeom_two_sided(a, b, c, d), odds, odds * math.exp(-q * so), odds * math.exp(q * so), rr, rr * math.exp(-q * sr), rr * math.exp(q * sr))


def moses(df: DataFrame, value: str, key: str) -> DataFrame:
    """Extreme reactions: the span of the control group's (the smaller one's) ranks, and its exact one-sided p."""
    v = numbers(df, value, keep=(key,))
    sizes = v.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy("n", key).collect()  # a row per group
    kind = "control string, n_control long, n_other long, span long, p double"
    if len(sizes) != 2 or sizes[0].n < 2:
        return one_row(df, kind)
    control, m, n = sizes[0][key], sizes[0].n, sizes[1].n
    r = midranks(v, value)
    s = v.where(F.col(key) == control).select(F.col(value)).distinct().join(r, value).agg(F.min("rank").alias("a"), F.max("rank").alias("b")).collect()[0]
    span = int(math.floor(s.b - s.a + 1 + 1e-9))
    ln = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    # of all choices of m ranks: those of span w leave m - 2 between the ends, in N - w + 1 places
    total = m + n
    p = sum(math.exp(ln(w - 2, m - 2) + math.log(total - w + 1) - ln(total, m)) for w in range(m, min(span, total) + 1))
    return one_row(df, kind, control, m, n, span, min(1.0, p))


def ks_two(df: DataFrame, value: str, key: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov: the largest distance of cumulative shares over distinct values."""
    v = numbers(df, value, keep=(key,))
    g = [r[0] for r in v.select(key).distinct().orderBy(key).limit(3).collect()]
    kind = "d double, n1 long, n2 long, z double, p double"
    if len(g) != 2:
        return one_row(df, kind)
    c = v.groupBy(value).agg(F.count_if(F.col(key) == g[0]).alias("a"), F.count_if(F.col(key) == g[1]).alias("b"))
    s = running_sums(c, value, {"ca": "a", "cb": "b"}, totals={"na": "ca", "nb": "cb"}).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb")).collect()[0]
    z = s.d * math.sqrt(s.na * s.nb / (s.na + s.nb))
    return one_row(df, kind, s.d, s.na, s.nb, z, ks_p(s.d, round(s.na * s.nb / (s.na + s.nb))))


def ks_p(d: float, n: int) -> float:
    """The tail of Kolmogorov's statistic of n values: by powers of a matrix up to 600, beyond by the limit."""
    if n * d * d > 18 or n > 600:
        return dist.kolmogorov_upper((math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d) if n > 600 else dist.kolmogorov_upper(math.sqrt(n) * d)
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    a = np.tril(np.ones((m, m)), 1)
    for i in range(m):
        a[i, 0] -= h ** (i + 1)
        a[m - 1, i] -= h ** (m - i)
    a[m - 1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    i, j = np.indices((m, m))
    a = a / np.vectorize(lambda x: math.exp(math.lgamma(x + 1)))(np.maximum(0, i - j + 1))
    power, scale = np.eye(m), 0.0
    for _ in range(n):
        power = power @ a
        top = np.abs(power).max()
        power, scale = power / top, scale + math.log(top)
    p = power[k - 1, k - 1]
    return min(1.0, max(0.0, 1 - p * math.exp(scale + math.lgamma(n + 1) - n * math.log(n)))) if p > 0 else 1.0


def ks_normal(df: DataFrame, col: str, replications: int = 10_000, seed: int = 20260924) -> DataFrame:
    """Distance from the fitted normal, its asymptotic p, and Lilliefors' p by simulation of the fixed seed."""
    v = df.select(num(df, col).alias("v")).dropna()
    s = v.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()[0]
    kind = "d double, n long, p_asymptotic double, p_lilliefors double"
    if s.n < 3 or not s.s:
        return one_row(df, kind)
    cdf = F.pandas_udf(lambda x: x.map(dist.norm_cdf), "double")  # distinct values only
    c = ranked_counts(v, "v").withColumn("f", cdf((F.col("v") - s.m) / s.s))
    d = c.agg(F.max(F.greatest(F.abs(F.col("_cum") / F.col("_n") - F.col("f")), F.abs((F.col("_cum") - F.col("_c")) / F.col("_n") - F.col("f")))).alias("d")).collect()[0].d
    n = min(int(s.n), 1000)  # beyond, sqrt(n) D has settled
    scaled = d * math.sqrt(s.n)
    rng, above, erf = np.random.default_rng(seed), 0, np.vectorize(math.erf)
    for a in range(0, replications, 500):
        x = np.sort(rng.standard_normal((min(500, replications - a), n)), 1)
        z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
        f = 0.5 + 0.5 * erf(z / math.sqrt(2)) if n <= 50 else _phi(z)
        i = np.arange(1, n + 1)
        above += int((np.maximum(i / n - f, f - (i - 1) / n).max(1) * math.sqrt(n) >= scaled).sum())
    return one_row(df, kind, d, s.n, dist.kolmogorov_upper(scaled), (above + 1) / (replications + 1))


_GRID = np.linspace(-9, 9, 36001)
_CDF = np.array([dist.norm_cdf(z) for z in _GRID])


def _phi(z: np.ndarray) -> np.ndarray:
    """The normal distribution by interpolation of a fine table; off by less than 1e-8."""
    return np.interp(z, _GRID, _CDF)


def median_test(df: DataFrame, value: str, key: str) -> DataFrame:
    """Chi-square of being above the grand median."""
    v = numbers(df, value, keep=(key,))
    med = points(v, value, (0.5,))[0]
    g = v.groupBy(key).agg(F.count_if(F.col(value) > F.lit(med)).alias("a"), F.count_if(F.col(value) <= F.lit(med)).alias("b")).collect() if med is not None else []  # a row per group
    kind = "median double, chi2 double, df long, p double, n long"
    a, b = sum(x.a for x in g), sum(x.b for x in g)
    if len(g) < 2 or not a or not b:
        return one_row(df, kind)
    chi = sum((o - (x.a + x.b) * t / (a + b)) ** 2 / ((x.a + x.b) * t / (a + b)) for x in g for o, t in ((x.a, a), (x.b, b)))
    return one_row(df, kind, med, chi, len(g) - 1, dist.chi2_upper(chi, len(g) - 1), a + b)


def exact_table(df: DataFrame, row: str, col: str, replications: int = 10_000, seed: int = 20260924) -> DataFrame:
    """Fisher-Freeman-Halton: all tables of the margins where their number stays below ENUMERATED, and a permutation
    estimate with a 99 % interval."""
    c = df.select(text(F.col(row)).alias("r"), text(F.col(col)).alias("c")).dropna().groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row per cell
    kind = "exact_p double, monte_carlo_p double, low double, high double, n long"
    t = c.pivot(index="r", columns="c", values="n").fillna(0).to_numpy(int) if len(c) else np.zeros((0, 0), int)
    if min(t.shape) < 2:
        return one_row(df, kind)
    rows, cols, n = t.sum(1), t.sum(0), int(t.sum())
    lf = np.array([math.lgamma(i + 1) for i in range(n + 1)])
    seen = -lf[t].sum()
    left = [ENUMERATED]

    def walk(i: int, free: tuple, score: float):
        if i == len(rows) - 1:
            yield score - lf[list(free)].sum()
            return

        def fill(j: int, need: int, made: tuple):
            if left[0] <= 0:
                return
            if j == len(free) - 1:
                if need <= free[j]:
                    left[0] -= 1
                    yield made + (need,)
                return
            for k in range(min(need, free[j]) + 1):
                yield from fill(j + 1, need - k, made + (k,))

        for made in fill(0, int(rows[i]), ()):
            yield from walk(i + 1, tuple(f - m for f, m in zip(free, made)), score - lf[list(made)].sum())

    const = lf[rows].sum() + lf[cols].sum() - lf[n]
    exact = sum(math.exp(const + s) for s in walk(0, tuple(map(int, cols)), 0.0) if s <= seen + 1e-7) if n <= 2000 else None
    if left[0] <= 0:
        exact = None
    rng, hits = np.random.default_rng(seed), 0
    r_of, c_of = np.repeat(np.arange(len(rows)), rows), np.repeat(np.arange(len(cols)), cols)
    reps = replications if n <= 100_000 else min(replications, 200)
    for _ in range(reps):
        x = np.bincount(r_of * len(cols) + rng.permutation(c_of), minlength=t.size)
        hits += -lf[x].sum() <= seen + 1e-7
    p = hits / reps
    half = 2.5758293035489 * math.sqrt(p * (1 - p) / reps)
    return one_row(df, kind, None if exact is None else min(1.0, exact), p, max(0.0, p - half), min(1.0, p + half), n)


def shapiro_wilk(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """W and p by Royston's approximation, per group. Weights follow from a value's rank, so distinct values with
    counts are enough: the weights of tied ranks are added up."""
    c = ranked_counts(df, value, by)
    keys = list(by) or ["_all"]
    c = c if by else c.withColumn("_all", F.lit("all"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        n = int(pdf["_n"].iloc[0])
        x = np.repeat(pdf[value].to_numpy(float), pdf["_c"].to_numpy(int))
        w, p = shapiro_of(x)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "n": [n], "w": [w], "p": [p]})

    out = c.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} string" for k in keys) + ", n long, w double, p double")
    return out if by else out.drop("_all")


def shapiro_of(x: np.ndarray) -> tuple[float | None, float | None]:
    """W and p of sorted values, three at least and not all equal."""
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return None, None
    m = np.array([dist.norm_inv(p) for p in (np.arange(1, n + 1) - 0.375) / (n + 0.25)]) if n <= 5000 else np.interp((np.arange(1, n + 1) - 0.375) / (n + 0.25), _CDF, _GRID)
    mm, u = float(m @ m), 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[:] = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        c = m / math.sqrt(mm)
        last = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u))
        if n > 5:
            second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u))
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = last, -last
    d = x - x.mean()
    w = float((a @ x) ** 2 / (d @ d))
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(1.0, w))) - math.asin(math.sqrt(0.75)))))
    ln = math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        if g <= math.log1p(-min(w, 1 - 1e-15)):
            return w, 0.0
        y = -math.log(g - math.log1p(-min(w, 1 - 1e-15)))
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sd = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        y = math.log1p(-min(w, 1 - 1e-15))
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sd = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    return w, 1 - dist.norm_cdf((y - mu) / sd)


def qq_points(df: DataFrame, col: str) -> DataFrame:
    """Normal quantile and probability plot points by Blom's positions, one per distinct value, and their detrended forms."""
    v = df.select(num(df, col).alias("v")).dropna()
    s = v.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    inv, cdf = F.pandas_udf(lambda p: p.map(dist.norm_inv), "double"), F.pandas_udf(lambda z: z.map(dist.norm_cdf), "double")  # distinct values only
    c = ranked_counts(v, "v").crossJoin(F.broadcast(s)).withColumn("p", (F.col("_cum") - (F.col("_c") - 1) / 2 - 0.375) / (F.col("_n") + 0.25))
    c = c.withColumns({"expected": inv("p"), "z": (F.col("v") - F.col("m")) / F.col("s")})
    return c.select("v", F.col("_c").alias("count"), "p", "expected", "z", (F.col("z") - F.col("expected")).alias("detrended_q"), cdf("z").alias("expected_p"), (F.col("p") - cdf("z")).alias("detrended_p"))
