"""Comparisons of means: t tests, analysis of variance and covariance, repeated measures, MANOVA, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import num, numbers, table
from ..functions import dist
from ..functions.linalg import covariance, inverse
from .nonparam import one_row
from .running import running_sums


def group_moments(df: DataFrame, value: str, key: str) -> list:
    """n, mean, variance, minimum and maximum per group, in the order of the groups' names; a row per group."""
    v = numbers(df, value, keep=(key,))
    return v.groupBy(F.col(key).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi")).orderBy("g").collect()


def t_one(df: DataFrame, col: str, mu: float = 0.0, level: float = 0.95) -> DataFrame:
    s = df.select(num(df, col).alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()[0]
    kind = "n long, mean double, sd double, se double, t double, df long, p double, difference double, low double, high double, d double"
    if s.n < 2 or not s.s:
        return one_row(df, kind)
    se, d, q = s.s / math.sqrt(s.n), s.m - mu, dist.t_inv(0.5 + level / 2, s.n - 1)
    return one_row(df, kind, s.n, s.m, s.s, se, d / se, s.n - 1, dist.t_two_sided(d / se, s.n - 1), d, d - q * se, d + q * se, d / s.s)


def t_independent(df: DataFrame, value: str, key: str, level: float = 0.95) -> DataFrame:
    """Pooled and Welch t of two groups, each of two values at least: a row each, with Levene's F and Cohen's d."""
    g = group_moments(df, value, key)
    kind = "test string, t double, df double, p double, difference double, se double, low double, high double, d double, levene_f double, levene_p double"
    if len(g) != 2 or min(x.n for x in g) < 2:
        return one_row(df, kind)
    a, b = g
    diff, pooled = a.m - b.m, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)
    lev = levene(df, value, key).where("center = 'mean'").collect()
    f, fp = (lev[0].f, lev[0].p) if lev else (None, None)
    out = []
    va, vb = a.v / a.n, b.v / b.n
    welch_df = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1)) if va + vb else a.n + b.n - 2.0
    for name, se, d in (("pooled", math.sqrt(pooled * (1 / a.n + 1 / b.n)), a.n + b.n - 2.0), ("welch", math.sqrt(va + vb), welch_df)):
        t, q = (diff / se if se else 0.0), dist.t_inv(0.5 + level / 2, d)
        out.append((name, t, float(d), dist.t_two_sided(t, d), diff, se, diff - q * se, diff + q * se, diff / math.sqrt(pooled) if pooled else None, f, fp))
    return table(df.sparkSession, out, kind)


def t_paired(df: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    v = numbers(df, a, b)
    s = v.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(a) - F.col(b)).alias("m"), F.stddev_samp(F.col(a) - F.col(b)).alias("s"), F.corr(a, b).alias("r")).collect()[0]
    kind = "n long, mean_difference double, sd double, se double, t double, df long, p double, low double, high double, dz double, r double, r_p double"
    if s.n < 2 or not s.s:
        return one_row(df, kind)
    se, q = s.s / math.sqrt(s.n), dist.t_inv(0.5 + level / 2, s.n - 1)
    rp = dist.t_two_sided(s.r * math.sqrt((s.n - 2) / max(1e-300, 1 - s.r**2)), s.n - 2) if s.n > 2 and s.r is not None and not math.isnan(s.r) else None
    return one_row(df, kind, s.n, s.m, s.s, se, s.m / se, s.n - 1, dist.t_two_sided(s.m / se, s.n - 1), s.m - q * se, s.m + q * se, s.m / s.s, s.r, rp)


def _f_of(g: list) -> tuple[float, float, int, int]:
    """Sums of squares between and within, and their degrees of freedom; a group of one value has none within."""
    n = sum(x.n for x in g)
    grand = sum(x.n * x.m for x in g) / n
    return sum(x.n * (x.m - grand) ** 2 for x in g), sum((x.n - 1) * (x.v or 0.0) for x in g), len(g) - 1, n - len(g)


def levene(df: DataFrame, value: str, key: str) -> DataFrame:
    """Levene's test about the mean, the median and the 5 % trimmed mean, and about the median with adjusted df."""
    v = numbers(df, value, keep=(key,)).select(F.col(key).alias("g"), F.col(value).alias("v"))
    # a trimmed mean drops 5 % of a group's values at either end: by cumulative counts of distinct values
    from .describe import quantiles, ranked_counts

    c = ranked_counts(v, "v", ["g"]).withColumn("_k", F.floor(0.05 * F.col("_n")))
    inside = F.greatest(F.lit(0), F.least("_cum", F.col("_n") - F.col("_k")) - F.greatest(F.col("_cum") - F.col("_c"), F.col("_k")))
    trimmed = c.groupBy("g").agg((F.sum(inside * F.col("v")) / F.sum(inside)).alias("trimmed"))
    centers = v.groupBy("g").agg(F.avg("v").alias("mean")).join(quantiles(v, "v", (0.5,), ["g"], "type7", ["median"]), "g").join(trimmed, "g")
    d = v.join(centers, "g").select("g", *(F.abs(F.col("v") - F.col(x)).alias(x) for x in ("mean", "median", "trimmed")))
    rows = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(e for x in ("mean", "median", "trimmed") for e in (F.avg(x).alias(f"m_{x}"), F.var_samp(x).alias(f"v_{x}")))).collect()  # a row per group
    kind = "center string, f double, df1 double, df2 double, p double"
    out = []
    if len(rows) > 1 and sum(r.n for r in rows) > len(rows):
        for x in ("mean", "median", "trimmed"):
            n, k = sum(r.n for r in rows), len(rows)
            grand = sum(r.n * r[f"m_{x}"] for r in rows) / n
            between, within = sum(r.n * (r[f"m_{x}"] - grand) ** 2 for r in rows), [(r.n - 1) * (r[f"v_{x}"] or 0.0) for r in rows]
            if not sum(within):
                continue
            f = between / (k - 1) / (sum(within) / (n - k))
            out.append((x, f, float(k - 1), float(n - k), dist.f_upper(f, k - 1, n - k)))
            if x == "median":
                adj = sum(within) ** 2 / sum(w * w / (r.n - 1) for w, r in zip(within, rows) if r.n > 1)
                out.append(("median_adjusted", f, float(k - 1), adj, dist.f_upper(f, k - 1, adj)))
    return table(df.sparkSession, out, kind)


def anova(df: DataFrame, value: str, key: str) -> DataFrame:
    """The one-way table with effect sizes in the row "between", and Welch's F in the row "welch"."""
    g = group_moments(df, value, key)
    kind = "source string, ss double, df double, ms double, f double, df2 double, p double, eta2 double, omega2 double"
    if len(g) < 2 or sum(x.n for x in g) <= len(g):
        return one_row(df, kind)
    b, w, d1, d2 = _f_of(g)
    f = (b / d1) / (w / d2) if w else None
    out = [("between", b, float(d1), b / d1, f, float(d2), dist.f_upper(f, d1, d2) if w else None, b / (b + w) if b + w else None, (b - d1 * w / d2) / (b + w + w / d2) if b + w else None), ("within", w, float(d2), w / d2, None, None, None, None, None), ("total", b + w, float(d1 + d2), None, None, None, None, None, None)]
    if all(x.n > 1 and x.v for x in g):
        k, weight = len(g), [x.n / x.v for x in g]
        u = sum(weight)
        m = sum(wi * x.m for wi, x in zip(weight, g)) / u
        lam = sum((1 - wi / u) ** 2 / (x.n - 1) for wi, x in zip(weight, g))
        fw = sum(wi * (x.m - m) ** 2 for wi, x in zip(weight, g)) / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
        dw = (k * k - 1) / (3 * lam)
        out.append(("welch", None, float(k - 1), None, fw, dw, dist.f_upper(fw, k - 1, dw), None, None))
    return table(df.sparkSession, out, kind)


def group_table(df: DataFrame, value: str, key: str, level: float = 0.95) -> DataFrame:
    kind = "group string, n long, mean double, sd double, se double, low double, high double, min double, max double"
    out = []
    for x in group_moments(df, value, key):
        sd = math.sqrt(x.v) if x.v is not None and x.n > 1 else None
        h = dist.t_inv(0.5 + level / 2, x.n - 1) * sd / math.sqrt(x.n) if sd is not None else None
        out.append((x.g, x.n, x.m, sd, sd / math.sqrt(x.n) if sd is not None else None, x.m - h if sd is not None else None, x.m + h if sd is not None else None, x.lo, x.hi))
    return table(df.sparkSession, out, kind)


def tukey_hsd(df: DataFrame, value: str, key: str, level: float = 0.95) -> DataFrame:
    """Tukey-Kramer comparisons of all pairs of groups."""
    g = group_moments(df, value, key)
    kind = "group1 string, group2 string, difference double, se double, q double, p double, low double, high double"
    if len(g) < 2 or sum(x.n for x in g) <= len(g):
        return one_row(df, kind)
    _, w, _, d2 = _f_of(g)
    k, ms, out = len(g), w / d2, []
    crit = dist.q_range_inv(level, k, d2) if ms else None
    for i in range(k):
        for j in range(i + 1, k):
            d, se = g[i].m - g[j].m, math.sqrt(ms / 2 * (1 / g[i].n + 1 / g[j].n))
            q = abs(d) / se if se else None
            out.append((g[i].g, g[j].g, d, se, q, dist.q_range_upper(q, k, d2) if se else None, d - crit * se if se else d, d + crit * se if se else d))
    return table(df.sparkSession, out, kind)


def _sse(x: np.ndarray, n: np.ndarray, m: np.ndarray, within: float) -> float:
    """The residual sum of squares of a model of cells, from their sizes, means and the sum within."""
    w = np.sqrt(n)
    beta, *_ = np.linalg.lstsq(x * w[:, None], m * w, rcond=None)
    return within + float(((m - x @ beta) ** 2 * n).sum())


def _effect(codes: np.ndarray, k: int) -> np.ndarray:
    """Effect coding: a column for each level but the last, which is -1 in all."""
    x = np.zeros((len(codes), k - 1))
    for i, c in enumerate(codes):
        x[i] = -1 if c == k - 1 else 0
        if c < k - 1:
            x[i, c] = 1
    return x


def anova_two_way(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """Two factors with interaction, effect coded: sums of squares of types I, II and III and the type III tests. No
    empty cell, n of 8 or more and a residual degree of freedom, else no rows."""
    v = numbers(df, value, keep=(a, b))
    cells = v.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).orderBy("a", "b").toPandas()  # a row per cell
    kind = "source string, ss1 double, ss2 double, ss3 double, df long, ms double, f double, p double, partial_eta2 double"
    la, lb = sorted(set(cells["a"])), sorted(set(cells["b"]))
    n = int(cells["n"].sum()) if len(cells) else 0
    if len(la) < 2 or len(lb) < 2 or len(cells) < len(la) * len(lb) or n < 8 or n <= len(cells):
        return one_row(df, kind)
    size, mean = cells["n"].to_numpy(float), cells["m"].to_numpy(float)
    within = float(((size - 1) * cells["v"].fillna(0.0)).sum())
    xa, xb = _effect(cells["a"].map(la.index).to_numpy(), len(la)), _effect(cells["b"].map(lb.index).to_numpy(), len(lb))
    xi, one = np.einsum("ni,nj->nij", xa, xb).reshape(len(cells), -1), np.ones((len(cells), 1))
    sse = lambda *p: _sse(np.hstack([one, *p]), size, mean, within)
    full, add = sse(xa, xb, xi), sse(xa, xb)
    ss = {"A": (sse() - sse(xa), sse(xb) - add, sse(xb, xi) - full), "B": (sse(xa) - add, sse(xa) - add, sse(xa, xi) - full), "A:B": (add - full,) * 3}
    d2 = n - len(cells)
    out = []
    for name, d in (("A", len(la) - 1), ("B", len(lb) - 1), ("A:B", (len(la) - 1) * (len(lb) - 1))):
        s = ss[name]
        f = (s[2] / d) / (full / d2) if full else None
        out.append((name, *map(float, s), d, s[2] / d, f, dist.f_upper(f, d, d2) if full else None, s[2] / (s[2] + full) if full else None))
    out.append(("error", full, full, full, d2, full / d2, None, None, None))
    return table(df.sparkSession, out, kind)


def cell_means(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """n and mean per cell, with weighted and unweighted margins of either factor."""
    v = numbers(df, value, keep=(a, b)).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("v"))
    c = v.groupBy("a", "b").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    weighted = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    margin = lambda k, o: c.groupBy(k).agg(F.sum("n").alias("n"), weighted.alias("mean"), F.avg("mean").alias("unweighted_mean")).withColumn(o, F.lit(None).cast("string"))
    cols = ["a", "b", "n", "mean", "unweighted_mean"]
    return c.withColumn("unweighted_mean", F.col("mean")).select(cols).union(margin("a", "b").select(cols)).union(margin("b", "a").select(cols))


def ancova(df: DataFrame, value: str, factor: str, covariate: str) -> DataFrame:
    """One factor and one covariate, by dropping each from the model; means adjusted to the covariate's mean. Rows:
    factor, covariate, error, slope, then a row per level with its raw and adjusted mean."""
    v = numbers(df, value, covariate, keep=(factor,)).select(F.col(factor).alias("g"), F.col(value).alias("y"), F.col(covariate).alias("x"))
    g = v.groupBy("g").agg(F.count("y").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("c")).orderBy("g").collect()  # a row per group
    kind = "term string, ss double, df long, f double, p double, estimate double, se double, t double, n long, raw_mean double, adjusted_mean double"
    n, k = sum(r.n for r in g), len(g)
    if n < 8 or k < 2 or n - k - 1 < 1:
        return one_row(df, kind)
    sxx, sxy, syy = (sum(r.n * r[c] for r in g) for c in ("vx", "c", "vy"))
    if not sxx:
        return one_row(df, kind)
    mx, my = sum(r.n * r.mx for r in g) / n, sum(r.n * r.my for r in g) / n
    txx, txy, tyy = sxx + sum(r.n * (r.mx - mx) ** 2 for r in g), sxy + sum(r.n * (r.mx - mx) * (r.my - my) for r in g), syy + sum(r.n * (r.my - my) ** 2 for r in g)
    b, sse, d2 = sxy / sxx, syy - sxy**2 / sxx, n - k - 1
    ms, ssf, ssc = sse / d2, (tyy - txy**2 / txx) - sse, sxy**2 / sxx
    f = lambda s, d: (s / d / ms, dist.f_upper(s / d / ms, d, d2)) if ms else (None, None)
    se = math.sqrt(ms / sxx)
    none = (None,) * 6
    out = [("factor", ssf, k - 1, *f(ssf, k - 1), *none), ("covariate", ssc, 1, *f(ssc, 1), *none), ("error", sse, d2, None, None, *none), ("slope", None, d2, None, dist.t_two_sided(b / se, d2) if se else None, b, se, b / se if se else None, None, None, None)]
    out += [(f"level {r.g}", None, None, None, None, None, None, None, r.n, r.my, r.my - b * (r.mx - mx)) for r in g]
    return table(df.sparkSession, out, kind)


def anova_repeated(df: DataFrame, value: str, subject: str, time: str) -> DataFrame:
    """Long rows to one row per subject with every time (a repeated pair of subject and time is missing); F with
    Greenhouse-Geisser, Huynh-Feldt and lower-bound corrections, and Mauchly's test. Four complete subjects at least."""
    v = numbers(df, value, keep=(subject, time)).groupBy(F.col(subject).alias("s"), F.col(time).alias("t")).agg(F.count(value).alias("c"), F.first(value).alias("v")).where("c = 1")
    times = [r.t for r in v.select("t").distinct().orderBy("t").collect()]  # a row per time
    kind = "correction string, ss double, ss_error double, epsilon double, df1 double, df2 double, f double, p double, mauchly_w double, mauchly_p double, n long"
    k = len(times)
    if k < 2:
        return one_row(df, kind)
    wide = v.groupBy("s").pivot("t", times).agg(F.first("v")).dropna().toDF("s", *(f"t{i}" for i in range(k)))
    means, s, n = covariance(wide, [f"t{i}" for i in range(k)])
    if n < 4:
        return one_row(df, kind)
    q = np.linalg.qr(np.column_stack([np.ones(k), np.eye(k)[:, : k - 1]]))[0][:, 1:]  # contrasts
    m = q.T @ s @ q
    ss, sse = n * float(((means - means.mean()) ** 2).sum()), (n - 1) * float(np.trace(m))
    d1, d2 = k - 1, (k - 1) * (n - 1)
    f = (ss / d1) / (sse / d2) if sse else None
    gg = np.trace(m) ** 2 / ((k - 1) * (m**2).sum()) if sse else 1.0
    hf = min(1.0, (n * (k - 1) * gg - 2) / ((k - 1) * (n - 1 - (k - 1) * gg)))
    w = float(np.linalg.det(m) / (np.trace(m) / d1) ** d1) if sse else None
    mp = None
    if w is not None and k > 2 and w > 0:
        c = 1 - (2 * d1 * d1 + d1 + 2) / (6 * d1 * (n - 1))
        mp = dist.chi2_upper(-(n - 1) * c * math.log(w), d1 * (d1 + 1) / 2 - 1)
    out = [(name, ss, sse, e, d1 * e, d2 * e, f, dist.f_upper(f, d1 * e, d2 * e) if f is not None else None, w, mp, n) for name, e in (("none", 1.0), ("greenhouse_geisser", float(gg)), ("huynh_feldt", float(hf)), ("lower_bound", 1 / (k - 1)))]
    return table(df.sparkSession, out, kind)


def manova(df: DataFrame, values: Sequence[str], key: str) -> DataFrame:
    """Wilks, Pillai, Hotelling-Lawley and Roy with F approximations, and Box's M, from one aggregation per group."""
    p = len(values)
    v = numbers(df, *values, keep=(key,))
    g = v.groupBy(F.col(key).alias("g")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(values)), *(F.covar_pop(values[i], values[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).orderBy("g").collect()  # a row per group
    kind = "test string, value double, f double, df1 double, df2 double, p double"
    n, k = sum(r.n for r in g), len(g)
    if p < 2 or k < 2 or n - k < p + 1:
        return one_row(df, kind)
    mean = np.array([[r[f"m{i}"] for i in range(p)] for r in g])
    size = np.array([r.n for r in g], float)
    s = [np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) for r in g]
    e = sum(x * r.n for x, r in zip(s, g))
    d = mean - (size @ mean) / n
    h = (d * size[:, None]).T @ d
    inv = inverse(e)
    if inv is None:
        return one_row(df, kind)
    lam = np.sort(np.maximum(0, np.linalg.eigvals(inv @ h).real))[::-1]
    q, ve = k - 1, n - k
    out = multivariate_tests(lam, p, q, ve)
    if all(r.n > p for r in g):
        logs = [np.linalg.slogdet(x * r.n / (r.n - 1))[1] for x, r in zip(s, g)]
        m = ve * np.linalg.slogdet(e / ve)[1] - sum((r.n - 1) * x for r, x in zip(g, logs))
        c = (2 * p * p + 3 * p - 1) / (6 * (p + 1) * q) * (sum(1 / (r.n - 1) for r in g) - 1 / ve)
        f = p * (p + 1) * q / 2
        out.append(("box_m", float(m), None, f, None, dist.chi2_upper(m * (1 - c), f)))
    return table(df.sparkSession, out, kind)


def multivariate_tests(lam: np.ndarray, p: int, q: int, ve: float) -> list[tuple]:
    """(test, value, F, df1, df2, p) of the eigenvalues of E^-1 H."""
    s = min(p, q)
    lam = lam[:s]
    m, n = (abs(p - q) - 1) / 2, (ve - p - 1) / 2
    wilks, pillai, hot, roy = float(np.prod(1 / (1 + lam))), float((lam / (1 + lam)).sum()), float(lam.sum()), float(lam[0])
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q > 5 else 1.0
    w, out = ve + q - (p + q + 1) / 2, []
    d1, d2 = p * q, w * t - (p * q - 2) / 2
    y = wilks ** (1 / t)
    for name, value, f, a, b in (
        ("wilks", wilks, (1 - y) / y * d2 / d1 if y else None, d1, d2),
        ("pillai", pillai, (2 * n + s + 1) / (2 * m + s + 1) * pillai / (s - pillai) if s > pillai else None, s * (2 * m + s + 1), s * (2 * n + s + 1)),
        ("hotelling_lawley", hot, 2 * (s * n + 1) * hot / (s * s * (2 * m + s + 1)), s * (2 * m + s + 1), 2 * (s * n + 1)),
        ("roy", roy, roy * (ve - max(p, q) + q) / max(p, q), max(p, q), ve - max(p, q) + q),
    ):
        out.append((name, value, f, float(a), float(b), dist.f_upper(f, a, b) if f is not None and a > 0 and b > 0 else None))
    return out


def bootstrap(df: DataFrame, cols: Sequence[str], stat: str = "mean", replications: int = 2000, level: float = 0.95, seed: int = 20260924) -> DataFrame:
    """Poisson bootstrap intervals (percentile and bias-corrected) of mean, sd or median per variable.

    A row's weight in replication b is a Poisson draw seeded by its content and b; for means and deviations, tasks send sums for
    each replication, not rows, so data of any size need one pass."""
    out = None
    for c in cols:
        v = df.select(num(df, c).alias("v")).dropna()
        counts = v.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        point = {"mean": F.avg("v"), "sd": F.stddev_samp("v"), "median": F.median("v")}[stat]
        est = v.agg(point.alias("e"), F.count("v").alias("n"), F.avg("v").alias("m")).collect()[0]
        if est.n < 2:
            continue

        def sums(frames, center=est.m):
            total = None
            for frame in frames:
                x, n = frame["v"].to_numpy(float) - center, frame["n"].to_numpy(float)
                seeds = pd.util.hash_array(x) ^ np.uint64(seed)
                acc = np.zeros((replications, 3))
                for i in range(len(x)):
                    w = np.random.default_rng(seeds[i]).poisson(n[i], replications)
                    acc += w[:, None] * np.array([1.0, x[i], x[i] * x[i]])
                total = acc if total is None else total + acc
            if total is not None:
                yield pd.DataFrame({"b": np.arange(replications), "w": total[:, 0], "s": total[:, 1], "q": total[:, 2]})

        if stat == "median":
            reps = _median_replications(counts, replications, seed)
        else:
            r = counts.mapInPandas(sums, "b int, w double, s double, q double").groupBy("b").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q")).toPandas()  # a row per replication
            m = r["s"] / r["w"]
            reps = (m + est.m if stat == "mean" else np.sqrt((r["q"] - r["w"] * m * m) / (r["w"] - 1))).to_numpy()
        z0 = dist.norm_inv(min(max((reps < est.e).mean(), 1 / (2 * len(reps))), 1 - 1 / (2 * len(reps))))
        za = dist.norm_inv(0.5 + level / 2)
        lo, hi = np.quantile(reps, [0.5 - level / 2, 0.5 + level / 2])
        blo, bhi = np.quantile(reps, [dist.norm_cdf(2 * z0 - za), dist.norm_cdf(2 * z0 + za)])
        row = one_row(df, "variable string, statistic string, estimate double, se double, bias double, low double, high double, bc_low double, bc_high double", c, stat, float(est.e), float(reps.std(ddof=1)), float(reps.mean() - est.e), float(lo), float(hi), float(blo), float(bhi))
        out = row if out is None else out.union(row)
    return out


def _median_replications(counts: DataFrame, replications: int, seed: int) -> np.ndarray:
    """Medians of resamples: the place of a resample's middle value among the sorted values is that of a beta order statistic,
    and the next one of an even number is the least of the uniform draws above it, so that only the values at the drawn
    places are looked up."""
    n = counts.agg(F.sum("n")).collect()[0][0]
    k = (n + 1) // 2
    rng = np.random.default_rng(seed)
    low = rng.beta(k, n - k + 1, replications)
    high = low if n % 2 else low + (1 - low) * (1 - rng.random(replications) ** (1 / (n - k)))
    places = np.minimum(n, np.floor(np.stack([low, high]) * n).astype(np.int64) + 1)
    cum = running_sums(counts, "v", {"_cum": "n"})
    wanted = table(counts.sparkSession, [(int(p),) for p in np.unique(places)], "p long")
    hit = cum.select("v", (F.col("_cum") - F.col("n")).alias("lo"), F.col("_cum").alias("hi")).join(F.broadcast(wanted), (F.col("p") > F.col("lo")) & (F.col("p") <= F.col("hi"))).collect()  # replications at most
    of = {r.p: r.v for r in hit}
    return np.vectorize(of.__getitem__, otypes=[float])(places).mean(0)


def permutation_test(df: DataFrame, value: str, key: str, replications: int = 2000, seed: int = 20260924) -> DataFrame:
    """The difference of two groups' means under random labels: (c + 1) / (B + 1), two-sided. Per replication a row is
    dealt to the first group with that group's share, and sums are compared, so tasks send sums only."""
    g = group_moments(df, value, key)
    kind = "difference double, p double, replications int"
    if len(g) != 2:
        return one_row(df, kind)
    n, n1 = g[0].n + g[1].n, g[0].n
    center = (g[0].n * g[0].m + g[1].n * g[1].m) / n
    counts = numbers(df, value).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def sums(frames):
        total = np.zeros((replications, 2))
        for frame in frames:
            x, m = frame["v"].to_numpy(float) - center, frame["n"].to_numpy(int)
            seeds = pd.util.hash_array(x) ^ np.uint64(seed)
            for i in range(len(x)):
                w = np.random.default_rng(seeds[i]).binomial(m[i], n1 / n, replications)
                total += w[:, None] * np.array([1.0, x[i]])
        yield pd.DataFrame({"b": np.arange(replications), "w": total[:, 0], "s": total[:, 1]})

    r = counts.mapInPandas(sums, "b int, w double, s double").groupBy("b").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).toPandas()
    w = np.clip(r["w"], 1, n - 1)
    diff = r["s"] / w + r["s"] / (n - w)  # all values add up to 0 about the mean
    seen = g[0].m - g[1].m
    return one_row(df, kind, seen, float(((np.abs(diff) >= abs(seen) - 1e-12).sum() + 1) / (replications + 1)), replications)


