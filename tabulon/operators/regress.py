"""Correlation and regression: linear, penalised, instrumental, robust, quantile, generalised, mixed, marginal, nonlinear."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ROW, numbers, settled, table, with_row
from ..functions import dist
from ..functions.linalg import covariance, cross_products, inverse, solve
from .compare import multivariate_tests
from .describe import points, ranked_counts
from .nonparam import one_row
from .running import running_sums

COEF = "term string, estimate double, se double, statistic double, p double"


def _table(df: DataFrame, terms: Sequence[str], beta, se, d: float | None = None, extra: str = "", more: Sequence = ()) -> DataFrame:
    """Coefficients with t (d degrees of freedom) or Wald z."""
    out = []
    for i, (t, b, s) in enumerate(zip(terms, beta, se)):
        z = float(b / s) if s and math.isfinite(s) else None
        p = None if z is None else dist.t_two_sided(z, d) if d is not None else dist.norm_two_sided(z)
        out.append((t, float(b), float(s), z, p, *(m[i] for m in more)))
    return table(df.sparkSession, out, COEF + extra)


def _names(xs: Sequence[str]) -> list[str]:
    return ["(intercept)", *xs]


def _lin(xs: Sequence[str], beta: np.ndarray) -> Column:
    return sum((F.lit(float(b)) * F.col(x) for x, b in zip(xs, beta[1:])), F.lit(float(beta[0])))


# correlation


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairs of complete rows: r, t and p; three rows at least."""
    return _pairs(df, numbers(df, *cols), cols, "pearson")


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson's r of midranks; ranks come from distinct values with counts."""
    v = numbers(df, *cols)
    for c in cols:
        r = ranked_counts(v, c).select(F.col(c).alias("_v"), (F.col("_cum") - (F.col("_c") - 1) / 2).alias("_r"))
        v = v.join(r, v[c] == r["_v"]).withColumn(c, F.col("_r")).drop("_v", "_r")
    return _pairs(df, v, cols, "spearman")


def _pairs(df: DataFrame, v: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    _, c, n = covariance(v, list(cols))
    kind, out = "x string, y string, method string, r double, n long, p double", []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            d = math.sqrt(c[i, i] * c[j, j]) if n > 2 else 0
            r = max(-1.0, min(1.0, c[i, j] / d)) if d else None
            out.append((cols[i], cols[j], method, r, n, None if r is None else 0.0 if abs(r) == 1 else dist.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)))
    return table(df.sparkSession, out if n > 2 else [], kind)


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b with a normal p, by merge counting over the distinct pairs and their counts.

    The pairs are cut at quantiles of x into ranges; discordant pairs within a range are counted there, and those between
    ranges from each range's counts over distinct values of y."""
    v = numbers(df, x, y).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    kind = "tau_b double, z double, p double, n long"
    s = v.agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("both")).collect()[0]
    if (s.n or 0) < 3:
        return one_row(df, kind)
    n = float(s.n)
    ties = lambda k: v.groupBy(k).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("a"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("v"), F.sum(F.col("t") * (F.col("t") - 1) * (F.col("t") - 2)).alias("w")).collect()[0]
    tx, ty = ties("x"), ties("y")
    cuts = v.approxQuantile("x", [i / 32 for i in range(1, 32)], 0.01)
    part = sum((F.when(F.col("x") >= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    ranged = v.withColumn("g", part)

    def inside(frame):
        import pandas as pd

        f = frame.sort_values(["x", "y"])
        yr = np.unique(f["y"], return_inverse=True)[1]
        tree, total, bad = np.zeros(yr.max() + 2, np.int64), 0, 0
        xs, cs = f["x"].to_numpy(), f["c"].to_numpy(np.int64)
        i = 0
        while i < len(f):
            j = i
            while j < len(f) and xs[j] == xs[i]:
                below, k = 0, yr[j] + 1
                while k > 0:
                    below += tree[k]
                    k -= k & -k
                bad += int(cs[j]) * int(total - below)
                j += 1
            for m in range(i, j):
                k = yr[m] + 1
                while k < len(tree):
                    tree[k] += cs[m]
                    k += k & -k
                total += cs[m]
            i = j
        return pd.DataFrame({"d": [float(bad)]})

    within = ranged.groupBy("g").applyInPandas(inside, "d double").agg(F.sum("d")).collect()[0][0] or 0.0
    # between ranges: a pair is discordant if the one in the higher range has the smaller y
    by_y = ranged.groupBy("g", "y").agg(F.sum("c").alias("c"))
    cells = by_y.groupBy("y").pivot("g", list(range(len(set(cuts)) + 1))).agg(F.sum("c")).fillna(0)
    k = len(set(cuts)) + 1
    lower = running_sums(cells, "y", {f"u{i}": str(i) for i in range(k)}).select(*(F.col(str(i)) for i in range(k)), *((F.col(f"u{i}") - F.col(str(i))).alias(f"b{i}") for i in range(k)))
    between = lower.agg(F.sum(sum((F.col(str(i)) * sum((F.col(f"b{j}") for j in range(i + 1, k)), F.lit(0)) for i in range(k - 1)), F.lit(0)).cast("double"))).collect()[0][0] or 0.0
    disc = within + between
    n0 = n * (n - 1) / 2
    conc = n0 - tx.a - ty.a + s.both - disc
    below = math.sqrt((n0 - tx.a) * (n0 - ty.a))
    tau = (conc - disc) / below if below else None
    var = (n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18 + 2 * tx.a * ty.a / (n * (n - 1)) + tx.w * ty.w / (9 * n * (n - 1) * (n - 2))
    z = (conc - disc) / math.sqrt(var) if var > 0 else None
    return one_row(df, kind, tau, z, dist.norm_two_sided(z) if z is not None else None, s.n)


def partial_correlation(df: DataFrame, cols: Sequence[str], controls: Sequence[str]) -> DataFrame:
    """Of all pairs, given the controls: from the inverse of the covariance matrix of the pair and the controls."""
    names = [*cols, *controls]
    _, c, n = covariance(numbers(df, *names), names)
    kind, out, q = "x string, y string, r double, partial_r double, t double, df long, p double", [], len(controls)
    if n - 2 - q < 1:
        return one_row(df, kind)
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            at = [i, j, *range(len(cols), len(names))]
            inv = inverse(c[np.ix_(at, at)])
            if inv is None:
                continue
            r = -inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1])
            t = r * math.sqrt((n - 2 - q) / max(1e-300, 1 - r * r))
            out.append((cols[i], cols[j], c[i, j] / math.sqrt(c[i, i] * c[j, j]), float(r), t, n - 2 - q, dist.t_two_sided(t, n - 2 - q)))
    return table(df.sparkSession, out, kind)


# linear models


def _xy(df: DataFrame, y: str, xs: Sequence[str], keep: tuple[str, ...] = ()) -> DataFrame:
    return numbers(df, y, *xs, keep=keep)


def _fit(v: DataFrame, y: str, xs: Sequence[str], weight: Column | None = None, penalty: float = 0.0):
    """beta, (X'WX + penalty)^-1, residual sum of squares, total sum of squares, n; None for a singular model."""
    a, n = cross_products(v, [F.lit(1.0), *xs, y], weight)
    k = len(xs) + 1
    xtx, xty, yty = a[:k, :k], a[:k, k], a[k, k]
    ridge = penalty * np.diag([0.0] + [1.0] * len(xs))
    beta = solve(xtx + ridge, xty) if n else None
    if beta is None:
        return None
    return beta, inverse(xtx + ridge), max(0.0, yty - 2 * beta @ xty + beta @ xtx @ beta), yty - xty[0] ** 2 / xtx[0, 0], n, xtx


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Coefficients with standardised ones and variance inflation; n of p + 2 at least, else no rows."""
    v = _xy(df, y, xs)
    fit = _fit(v, y, xs)
    if fit is None or fit[4] < len(xs) + 2:
        return one_row(df, COEF + ", std_beta double, vif double")
    beta, inv, sse, sst, n, xtx = fit
    d = n - len(xs) - 1
    sxx = np.diag(xtx)[1:] - xtx[0, 1:] ** 2 / n
    vif = [None, *(float(inv[i + 1, i + 1] * sxx[i]) for i in range(len(xs)))]
    std = [None, *(float(beta[i + 1] * math.sqrt(sxx[i] / sst)) if sst > 0 else None for i in range(len(xs)))]
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv) * sse / d), d, ", std_beta double, vif double", (std, vif))


def ols_summary(df: DataFrame, y: str, xs: Sequence[str], order: list[str] | None = None) -> DataFrame:
    """R2, adjusted R2, F and its p, standard error, and Durbin-Watson where rows have an order."""
    v = _xy(df, y, xs)
    fit = _fit(v, y, xs)
    kind = "n long, r2 double, adj_r2 double, f double, df1 long, df2 long, p double, sigma double, durbin_watson double"
    if fit is None or fit[4] < len(xs) + 2:
        return one_row(df, kind)
    beta, _, sse, sst, n, _ = fit
    p, d = len(xs), n - len(xs) - 1
    r2 = 1 - sse / sst if sst > 0 else None
    f = (sst - sse) / p / (sse / d) if sse > 0 else None
    dw = None
    if order and sse > 0:
        named = df.select(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), *dict.fromkeys([y, *xs]))
        base = numbers(named, y, *xs, listwise=False).columns
        rows = named.select(*(F.col(c).cast("double").alias(c) for c in base), *(f"_o{i}" for i in range(len(order)))).dropna(subset=base)
        e = with_row(rows, [f"_o{i}" for i in range(len(order))]).select(ROW, (F.col(y) - _lin(xs, beta)).alias("e"))
        prev = e.select((F.col(ROW) + 1).alias(ROW), F.col("e").alias("q"))
        dw = e.join(prev, ROW).agg(F.sum(F.pow(F.col("e") - F.col("q"), 2))).collect()[0][0] / sse
    return one_row(df, kind, n, r2, 1 - (1 - r2) * (n - 1) / d if r2 is not None else None, f, p, d, dist.f_upper(f, p, d) if f is not None else None, math.sqrt(sse / d), dw)


def ridge(df: DataFrame, y: str, xs: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """The penalty is added to X'X as it is, not to the intercept."""
    v = _xy(df, y, xs)
    fit = _fit(v, y, xs, penalty=penalty)
    if fit is None or fit[4] < len(xs) + 2:
        return one_row(df, COEF)
    beta, inv, sse, _, n, xtx = fit
    d = n - len(xs) - 1
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv @ xtx @ inv) * sse / d), d)


def wls(df: DataFrame, y: str, xs: Sequence[str], weight: str) -> DataFrame:
    v = numbers(df, y, *xs, weight).where(F.col(weight) > 0)
    fit = _fit(v, y, xs, F.col(weight))
    if fit is None or fit[4] <= len(xs) + 1:
        return one_row(df, COEF)
    beta, inv, sse, _, n, _ = fit
    d = n - len(xs) - 1
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv) * sse / d), d)


def two_stage(df: DataFrame, y: str, endogenous: Sequence[str], exogenous: Sequence[str], instruments: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Two-stage least squares, and first-stage F, Sargan's and the Durbin-Wu-Hausman test, from one matrix of products."""
    kind = "test string, variable string, statistic double, df1 double, df2 double, p double"
    names = [*exogenous, *endogenous, *instruments, y]
    a, n = cross_products(numbers(df, *names), [F.lit(1.0), *names])
    ix = {c: i + 1 for i, c in enumerate(names)}
    X = [0, *(ix[c] for c in [*exogenous, *endogenous])]
    Z = [0, *(ix[c] for c in [*exogenous, *instruments])]
    at, k = ix[y], len(X)
    if len(instruments) < len(endogenous) or n <= max(len(X), len(Z)) + len(endogenous):
        return one_row(df, COEF), one_row(df, kind)
    first = solve(a[np.ix_(Z, Z)], a[np.ix_(Z, X)])
    if first is None:
        return one_row(df, COEF), one_row(df, kind)
    m = a[np.ix_(X, Z)] @ first
    inv = inverse(m)
    if inv is None:
        return one_row(df, COEF), one_row(df, kind)
    beta = inv @ (first.T @ a[Z, at])
    xx = a[np.ix_(X, X)]
    sse = a[at, at] - 2 * beta @ a[X, at] + beta @ xx @ beta
    s2, d, out = sse / (n - k), n - k, []
    sse_of = lambda cols, t: a[t, t] - a[cols, t] @ solve(a[np.ix_(cols, cols)], a[cols, t])
    W = [0, *(ix[c] for c in exogenous)]
    for c in endogenous:
        full, small, q = sse_of(Z, ix[c]), sse_of(W, ix[c]), len(instruments)
        f = (small - full) / q / (full / (n - len(Z)))
        out.append(("first_stage", c, float(f), float(q), float(n - len(Z)), dist.f_upper(f, q, n - len(Z))))
    ze = a[Z, at] - a[np.ix_(Z, X)] @ beta
    over = len(instruments) - len(endogenous)
    if over:
        j = float(ze @ solve(a[np.ix_(Z, Z)], ze) / (sse / n))
        out.append(("sargan", "", j, float(over), None, dist.chi2_upper(j, over)))
    # residuals of the first stage as further regressors: their products follow from the same matrix
    v = np.zeros((len(a), len(endogenous)))
    for i, c in enumerate(endogenous):
        v[ix[c], i] = 1
        v[Z, i] -= solve(a[np.ix_(Z, Z)], a[Z, ix[c]])
    pick = np.zeros((len(a), k))
    pick[X, range(k)] = 1
    both = np.hstack([pick, v])
    b2 = solve(both.T @ a @ both, both.T @ a[:, at])
    if b2 is not None:
        full, small, q = a[at, at] - b2 @ (both.T @ a[:, at]), sse_of(X, at), len(endogenous)
        f = (small - full) / q / (full / (n - k - q))
        out.append(("durbin_wu_hausman", "", float(f), float(q), float(n - k - q), dist.f_upper(f, q, n - k - q)))
    return _table(df, ["(intercept)", *exogenous, *endogenous], beta, np.sqrt(np.diag(inv) * s2), d), table(df.sparkSession, out, kind)


def robust(df: DataFrame, y: str, xs: Sequence[str], method: str = "huber", most: int = 200, tol: float = 1e-10) -> DataFrame:
    """Huber (1.345) or Tukey (4.685) M estimates by reweighting; the scale is the median of |residual| / 0.6745."""
    v = _xy(df, y, xs).cache()
    fit = _fit(v, y, xs)
    if fit is None or fit[4] < 10:
        return one_row(df, COEF)
    beta, n = fit[0], fit[4]
    for _ in range(most):
        r = F.abs(F.col(y) - _lin(xs, beta))
        s = v.agg(F.median(r)).collect()[0][0] / 0.6745
        if s < 1e-12:
            break
        u = r / s
        w = F.when(u <= 1.345, 1.0).otherwise(1.345 / u) if method == "huber" else F.when(u < 4.685, F.pow(1 - F.pow(u / 4.685, 2), 2)).otherwise(0.0)
        new = _fit(v, y, xs, w)
        if new is None:
            break
        step, beta = np.abs(new[0] - beta).max(), new[0]
        if step < tol * max(1.0, np.abs(beta).max()):
            break
    k = len(xs) + 1
    if s >= 1e-12:
        u = (F.col(y) - _lin(xs, beta)) / s
        au = F.abs(u)
        psi = F.when(au <= 1.345, u).otherwise(1.345 * F.signum(u)) if method == "huber" else F.when(au < 4.685, u * F.pow(1 - F.pow(u / 4.685, 2), 2)).otherwise(0.0)
        dpsi = F.when(au <= 1.345, 1.0).otherwise(0.0) if method == "huber" else F.when(au < 4.685, (1 - F.pow(u / 4.685, 2)) * (1 - 5 * F.pow(u / 4.685, 2))).otherwise(0.0)
        m = v.agg(F.avg(psi * psi).alias("a"), F.avg(dpsi).alias("b")).collect()[0]
        var = s * s * m.a / (m.b * m.b) * n / (n - k) if m.b else float("nan")
    else:
        var = 0.0
    out = _table(df, _names(xs), beta, np.sqrt(np.diag(fit[1]) * var), n - k)
    v.unpersist()
    return out


def quantile_regression(df: DataFrame, y: str, xs: Sequence[str], taus: Sequence[float] = (0.5,), most: int = 200, tol: float = 1e-6) -> DataFrame:
    """Reweighted least squares of the check loss, with kernel standard errors and a pseudo R2 per quantile."""
    v = _xy(df, y, xs).cache()
    fit, out, kind = _fit(v, y, xs), None, COEF + ", tau double, pseudo_r2 double"
    for tau in taus if fit is not None and fit[4] > len(xs) + 2 else ():
        beta, n = fit[0], fit[4]
        for _ in range(most):
            r = F.col(y) - _lin(xs, beta)
            w = F.when(r >= 0, tau).otherwise(1 - tau) / F.greatest(F.abs(r), F.lit(1e-6))
            new = _fit(v, y, xs, w)
            if new is None:
                break
            step, beta = np.abs(new[0] - beta).max(), new[0]
            if step < tol * max(1.0, np.abs(beta).max()):
                break
        z = dist.norm_inv(tau)
        h = n ** (-1 / 3) * dist.norm_inv(0.975) ** (2 / 3) * (1.5 * dist.norm_pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
        r = F.col(y) - _lin(xs, beta)
        sd, q = v.agg(F.stddev_samp(r).alias("s")).collect()[0].s, points(v.select(r.alias("r")), "r", (0.25, 0.75))
        width = max(1e-9, (dist.norm_inv(min(0.999, tau + h)) - dist.norm_inv(max(0.001, tau - h))) * min(sd or 0, (q[1] - q[0]) / 1.34 or sd or 1e-9))
        kernel = F.when(F.abs(r) < width, 0.75 * (1 - F.pow(r / width, 2)) / width).otherwise(0.0)
        a, _ = cross_products(v, [F.lit(1.0), *xs], kernel)
        hinv = inverse(a)
        check = lambda e: F.sum(e * F.when(e >= 0, tau).otherwise(tau - 1))
        base = points(v, y, (tau,))[0]
        loss = v.agg(check(r).alias("a"), check(F.col(y) - F.lit(base)).alias("b")).collect()[0]
        se = np.sqrt(np.maximum(0, np.diag(tau * (1 - tau) * hinv @ fit[5] @ hinv))) if hinv is not None else np.full(len(beta), np.nan)
        t = _table(df, _names(xs), beta, se, n - len(beta), ", tau double, pseudo_r2 double", ([tau] * len(beta), [1 - loss.a / loss.b if loss.b else None] * len(beta)))
        out = t if out is None else out.union(t)
    v.unpersist()
    return out if out is not None else one_row(df, kind)


def nonlinear(df: DataFrame, y: str, x: str, curve: str = "exponential", most: int = 200) -> DataFrame:
    """a exp(b x) or a x^b by Levenberg-Marquardt, from the fit of the logarithms; each step is one aggregation."""
    v = numbers(df, y, x).where("true" if curve == "exponential" else f"`{x}` > 0").cache()
    base = F.col(x) if curve == "exponential" else F.log(x)
    s = v.where(F.col(y) > 0).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.log(y), base).alias("b"), F.regr_intercept(F.log(y), base).alias("a")).collect()[0]
    kind = COEF + ", r2 double, sse double, n long"
    if s.n < 3 or s.b is None:
        return one_row(df, kind)
    beta, lam = np.array([math.exp(s.a), s.b]), 1e-3

    def step(b):
        e = F.exp(F.lit(float(b[1])) * base)
        r = F.col(y) - F.lit(float(b[0])) * e
        j = [e, F.lit(float(b[0])) * base * e]
        q = v.agg(F.sum(r * r).alias("s"), F.sum(j[0] * j[0]).alias("aa"), F.sum(j[0] * j[1]).alias("ab"), F.sum(j[1] * j[1]).alias("bb"), F.sum(j[0] * r).alias("ar"), F.sum(j[1] * r).alias("br"), F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("v")).collect()[0]
        return q.s, np.array([[q.aa, q.ab], [q.ab, q.bb]]), np.array([q.ar, q.br]), q.n, q.v

    sse, h, g, n, var = step(beta)
    for _ in range(most):
        d = np.linalg.solve(h + lam * np.diag(np.diag(h)), g)
        new = step(beta + d)
        if math.isfinite(new[0]) and new[0] <= sse:
            done = np.abs(d).max() < 1e-10 * max(1.0, np.abs(beta).max())
            beta, lam = beta + d, max(1e-12, lam / 10)
            sse, h, g, n, var = new
            if done:
                break
        else:
            lam *= 10
            if lam > 1e12:
                break
    v.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(h)) * sse / (n - 2))
    return _table(df, ["a", "b"], beta, se, n - 2, ", r2 double, sse double, n long", ([1 - sse / (var * n) if var else None] * 2, [sse] * 2, [n] * 2))


# generalised linear models: each step is one aggregation with the coefficients as literals


def _irls(v: DataFrame, y: str, xs: Sequence[str], link: Callable, most: int = 100, tol: float = 1e-10, start: np.ndarray | None = None):
    """link(eta column) gives (working weight, working response). Returns beta, (X'WX)^-1, converged."""
    beta = np.zeros(len(xs) + 1) if start is None else start
    inv = None
    for _ in range(most):
        w, z = link(_lin(xs, beta))
        a, _ = cross_products(v, [F.lit(1.0), *xs, z], w)
        k = len(beta)
        new = solve(a[:k, :k], a[:k, k])
        if new is None or not np.all(np.isfinite(new)):
            return beta, inv, False
        inv = inverse(a[:k, :k])
        step, beta = np.abs(new - beta).max(), new
        if step < tol * max(1.0, np.abs(beta).max()):
            return beta, inv, True
    return beta, inv, False


def _clip(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))


def _sigmoid(eta: Column) -> Column:
    return _clip(1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(35.0)), F.lit(-35.0)))))


_pdf = lambda e: F.exp(-e * e / 2) / math.sqrt(2 * math.pi)


def _ncdf(e: Column) -> Column:
    """The normal distribution as a column: erf's rational form, off by 1.2e-7 of the tail at most, relatively."""
    t = 1 / (1 + 0.5 * F.abs(e) / math.sqrt(2))
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = 0.5 * t * F.exp(-e * e / 2 + poly)
    return _clip(F.when(e > 0, 1 - tail).otherwise(tail))


def _binary(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame | None:
    """Rows with y as 0 and 1, the higher of two values being 1; None for other than two."""
    v = numbers(df, y, *xs)
    s = v.agg(F.min(y).alias("a"), F.max(y).alias("b")).collect()[0]
    if s.a is None or s.a == s.b or v.where((F.col(y) != s.a) & (F.col(y) != s.b)).limit(1).count():
        return None
    return v.withColumn(y, (F.col(y) == s.b).cast("double")).cache()


def _fit_stats(v: DataFrame, y: str, p: Column) -> tuple:
    """Log-likelihood, that of the share alone, and n."""
    s = v.agg(F.sum(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p)).alias("ll"), F.avg(y).alias("m"), F.count(F.lit(1)).alias("n")).collect()[0]
    return s.ll, s.n * (s.m * math.log(s.m) + (1 - s.m) * math.log(1 - s.m)), s.n


def _binary_model(df, y, xs, link, p_of):
    v = _binary(df, y, xs)
    kind = COEF + ", exp_estimate double, log_likelihood double, null_log_likelihood double, n long, converged boolean"
    if v is None:
        return one_row(df, kind)
    beta, inv, ok = _irls(v, y, xs, link)
    ll, l0, n = _fit_stats(v, y, p_of(_lin(xs, beta)))
    v.unpersist()
    if inv is None:
        return one_row(df, kind)
    k = len(beta)
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv)), None, kind[len(COEF):], ([math.exp(min(700, b)) for b in beta], [ll] * k, [l0] * k, [n] * k, [ok] * k))


def logistic(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    def link(eta):
        p = _sigmoid(eta)
        w = F.greatest(p * (1 - p), F.lit(1e-12))
        return w, eta + (F.col(y) - p) / w

    return _binary_model(df, y, xs, link, _sigmoid)


def probit(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    def link(eta):
        e = F.greatest(F.least(eta, F.lit(8.0)), F.lit(-8.0))
        p, f = _ncdf(e), F.greatest(_pdf(e), F.lit(1e-12))
        return f * f / (p * (1 - p)), eta + (F.col(y) - p) / f

    return _binary_model(df, y, xs, link, _ncdf)


def poisson(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Log link; deviance, Pearson's chi-square, and AIC with the constant counted."""
    v = numbers(df, y, *xs).where(F.col(y) >= 0).cache()
    m = v.agg(F.avg(y), F.count(F.lit(1))).collect()[0]
    kind = COEF + ", exp_estimate double, deviance double, pearson double, aic double, n long"
    if not m[0] or m[1] <= len(xs) + 1:
        return one_row(df, kind)
    mu_of = lambda eta: F.exp(F.greatest(F.least(eta, F.lit(50.0)), F.lit(-50.0)))
    start = np.zeros(len(xs) + 1)
    start[0] = math.log(m[0])
    beta, inv, _ = _irls(v, y, xs, lambda eta: (mu_of(eta), eta + (F.col(y) - mu_of(eta)) / mu_of(eta)), start=start)
    mu, c = mu_of(_lin(xs, beta)), F.col(y)
    lgamma = F.udf(lambda x: math.lgamma(x + 1), "double")  # distinct counts only
    fact = v.groupBy(y).agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.col("k") * lgamma(y))).collect()[0][0]
    s = v.agg(F.sum(2 * (F.when(c > 0, c * F.log(c / mu)).otherwise(0.0) - (c - mu))).alias("d"), F.sum(F.pow(c - mu, 2) / mu).alias("p"), F.sum(c * F.log(mu) - mu).alias("l")).collect()[0]
    v.unpersist()
    k = len(beta)
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv)), None, kind[len(COEF):], ([math.exp(b) for b in beta], [s.d] * k, [s.p] * k, [-2 * (s.l - fact) + 2 * k] * k, [m[1]] * k))


def glm_gamma(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Gamma with a log link; the dispersion is Pearson's chi-square over its degrees of freedom."""
    v = numbers(df, y, *xs).where(F.col(y) > 0).cache()
    m = v.agg(F.avg(y), F.count(F.lit(1))).collect()[0]
    kind = COEF + ", dispersion double, deviance double, n long"
    if not m[0] or m[1] <= len(xs) + 1:
        return one_row(df, kind)
    start = np.zeros(len(xs) + 1)
    start[0] = math.log(m[0])
    beta, inv, _ = _irls(v, y, xs, lambda eta: (F.lit(1.0), eta + F.col(y) / F.exp(eta) - 1), start=start)
    mu, c, d = F.exp(_lin(xs, beta)), F.col(y), m[1] - len(xs) - 1
    s = v.agg(F.sum(F.pow((c - mu) / mu, 2)).alias("p"), F.sum(2 * ((c - mu) / mu - F.log(c / mu))).alias("d")).collect()[0]
    v.unpersist()
    k = len(beta)
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv) * s.p / d), None, kind[len(COEF):], ([s.p / d] * k, [s.d] * k, [m[1]] * k))


def glm_binomial(df: DataFrame, successes: str, trials: str, xs: Sequence[str]) -> DataFrame:
    """k successes of m trials with a logit link."""
    v = numbers(df, successes, trials, *xs).where((F.col(trials) > 0) & (F.col(successes) <= F.col(trials))).cache()
    kind, k, m = COEF + ", deviance double, n long", F.col(successes), F.col(trials)

    def link(eta):
        p = _sigmoid(eta)
        return m * p * (1 - p), eta + (k - m * p) / (m * p * (1 - p))

    beta, inv, _ = _irls(v, successes, xs, link)
    if inv is None:
        return one_row(df, kind)
    p = _sigmoid(_lin(xs, beta))
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    s = v.agg(F.sum(2 * (part(k, m * p) + part(m - k, m * (1 - p)))).alias("d"), F.count(F.lit(1)).alias("n")).collect()[0]
    v.unpersist()
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv)), None, kind[len(COEF):], ([s.d] * len(beta), [s.n] * len(beta)))


def _newton(v: DataFrame, start: np.ndarray, loss: Callable, most: int = 100, tol: float = 1e-9):
    """Minimises a sum over rows by BHHH steps with halving: loss(theta) gives the row's log-likelihood and the columns of its
    gradient. The last matrix of gradient products gives the standard errors."""
    theta, k = start, len(start)

    def at(t):
        ll, g = loss(t)
        s = v.agg(F.sum(ll).alias("l"), *(F.sum(x).alias(f"g{i}") for i, x in enumerate(g)), *(F.sum(g[i] * g[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).collect()[0]
        h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return s.l, np.array([s[f"g{i}"] for i in range(k)]), h

    now = at(theta)
    for _ in range(most):
        d = np.linalg.solve(now[2] + 1e-10 * np.eye(k) * np.trace(now[2]), now[1])
        size = 1.0
        while size > 1e-6:
            new = at(theta + size * d)
            if new[0] is not None and math.isfinite(new[0]) and new[0] >= now[0]:
                break
            size /= 2
        else:
            break
        gain, theta, now = new[0] - now[0], theta + size * d, new
        if gain < tol * max(1.0, abs(now[0])):
            break
    return theta, now


def multinomial(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Baseline logits against the smallest category."""
    v = numbers(df, y, *xs).cache()
    cats = [r[0] for r in v.select(y).distinct().orderBy(y).limit(21).collect()]
    kind = "category double, " + COEF + ", log_likelihood double"
    if not 2 <= len(cats) <= 20:
        return one_row(df, kind)
    k, x = len(xs) + 1, [F.lit(1.0), *(F.col(c) for c in xs)]

    def loss(t):
        eta = [_lin(xs, t[i * k : (i + 1) * k]) for i in range(len(cats) - 1)]
        top = F.greatest(F.lit(0.0), *eta) if len(eta) else F.lit(0.0)
        total = sum((F.exp(e - top) for e in eta), F.exp(-top))
        ll = sum((F.when(F.col(y) == c, e).otherwise(0.0) for c, e in zip(cats[1:], eta)), F.lit(0.0)) - top - F.log(total)
        return ll, [((F.col(y) == c).cast("double") - F.exp(e - top) / total) * xi for c, e in zip(cats[1:], eta) for xi in x]

    theta, (ll, _, h) = _newton(v, np.zeros(k * (len(cats) - 1)), loss)
    inv = inverse(h)
    v.unpersist()
    se = np.sqrt(np.diag(inv)) if inv is not None else np.full(len(theta), np.nan)
    out = []
    for i, c in enumerate(cats[1:]):
        for j, t in enumerate(_names(xs)):
            b, s = float(theta[i * k + j]), float(se[i * k + j])
            z = b / s if s and math.isfinite(s) else None
            out.append((c, t, b, s, z, dist.norm_two_sided(z) if z is not None else None, ll))
    return table(df.sparkSession, out, kind)


def ordinal(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Cumulative logits of three ordered categories or more: thresholds and common slopes."""
    v = numbers(df, y, *xs).cache()
    g = v.groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy(y).limit(21).collect()
    kind = COEF + ", log_likelihood double"
    if not 3 <= len(g) <= 20:
        return one_row(df, kind)
    cats, total, q = [r[0] for r in g], sum(r.n for r in g), len(g) - 1
    share = np.cumsum([r.n for r in g])[:-1] / total
    cut = np.log(share / (1 - share))
    start = np.concatenate([[cut[0]], np.log(np.diff(cut)), np.zeros(len(xs))])  # thresholds by their gaps' logarithms, so they stay in order

    def loss(t):
        a = np.concatenate([[t[0]], t[0] + np.cumsum(np.exp(t[1:q]))])
        s = sum((F.lit(float(b)) * F.col(x) for x, b in zip(xs, t[q:])), F.lit(0.0))
        at = lambda i: F.lit(0.0) if i < 0 else F.lit(1.0) if i >= q else _sigmoid(F.lit(float(a[i])) - s)
        of = lambda f: sum((F.when(F.col(y) == c, f(i)).otherwise(0.0) for i, c in enumerate(cats)), F.lit(0.0))
        hi, lo = of(at), of(lambda i: at(i - 1))
        p = F.greatest(hi - lo, F.lit(1e-12))
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        da = [(of(lambda i, j=j: dhi if i == j else F.lit(0.0)) - of(lambda i, j=j: dlo if i - 1 == j else F.lit(0.0))) / p for j in range(q)]
        gaps = [sum(da, F.lit(0.0))] + [math.exp(t[m]) * sum(da[m:], F.lit(0.0)) for m in range(1, q)]
        return F.log(p), gaps + [-(dhi - dlo) / p * F.col(x) for x in xs]

    theta, (ll, _, h) = _newton(v, start, loss)
    v.unpersist()
    a = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:q]))])
    j = np.eye(len(theta))
    j[:q, 0] = 1
    for m in range(1, q):
        j[m:q, m] = math.exp(theta[m])
        j[0, m] = 0
    inv = inverse(h)
    se = np.sqrt(np.diag(j @ inv @ j.T)) if inv is not None else np.full(len(theta), np.nan)
    return _table(df, [*(f"threshold {c:g}" for c in cats[:-1]), *xs], np.concatenate([a, theta[q:]]), se, None, ", log_likelihood double", ([ll] * len(theta),))


def negative_binomial(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    return _count_model(df, y, xs, True, False)


def zero_inflated(df: DataFrame, y: str, xs: Sequence[str], negative: bool = False) -> DataFrame:
    """Zero-inflated Poisson or negative binomial with a constant share of extra zeros."""
    return _count_model(df, y, xs, negative, True)


def _count_model(df, y, xs, negative: bool, inflated: bool) -> DataFrame:
    """Likelihood steps over distinct (x, y) rows; for counts the logarithms of factorials are sums over the count."""
    v = numbers(df, y, *xs).where((F.col(y) >= 0) & (F.col(y) == F.floor(y))).cache()
    m = v.agg(F.avg(y).alias("m"), F.var_samp(y).alias("v"), F.avg((F.col(y) == 0).cast("double")).alias("z"), F.count(F.lit(1)).alias("n")).collect()[0]
    kind = COEF + ", log_likelihood double, n long"
    if not m.m or m.n <= len(xs) + 3:
        return one_row(df, kind)
    k, c = len(xs) + 1, F.col(y)
    start = np.zeros(k)
    start[0] = math.log(m.m)
    names = _names(xs)
    if negative:
        start, names = np.append(start, math.log(max(0.05, (m.v - m.m) / m.m**2))), [*names, "log(alpha)"]
    if inflated:
        extra = min(0.9, max(0.02, m.z - math.exp(-m.m)))
        start, names = np.append(start, math.log(extra / (1 - extra))), [*names, "zero_logit"]
        start[0] = math.log(m.m / (1 - extra))
    up = F.sequence(F.lit(0), F.greatest(c.cast("int") - 1, F.lit(0)))

    def loss(t):
        eta = _lin(xs, t[:k])
        mu = F.exp(F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0)))
        fact = F.when(c > 0, F.aggregate(up, F.lit(0.0), lambda s, i: s + F.log(i + 1.0))).otherwise(0.0)
        if negative:
            al = math.exp(min(20, max(-20, t[k])))
            r = 1 / al
            rising = F.when(c > 0, F.aggregate(up, F.lit(0.0), lambda s, i: s + F.log(i + r))).otherwise(0.0)
            drise = F.when(c > 0, F.aggregate(up, F.lit(0.0), lambda s, i: s + 1 / (i + r))).otherwise(0.0)
            lp = rising - fact - r * F.log(1 + al * mu) + c * (F.log(al * mu) - F.log(1 + al * mu))
            d_eta = (c - mu) / (1 + al * mu)
            d_al = -r * drise + r * F.log(1 + al * mu) + (c - mu) / (1 + al * mu)
        else:
            lp, d_eta, d_al = c * F.log(mu) - mu - fact, c - mu, None
        if not inflated:
            ll, factor, dz = lp, F.lit(1.0), None
        else:
            p = 1 / (1 + math.exp(-min(30, max(-30, t[-1]))))
            p0 = F.exp(lp)
            ll = F.when(c == 0, F.log(p + (1 - p) * p0)).otherwise(math.log(1 - p) + lp)
            factor = F.when(c == 0, (1 - p) * p0 / (p + (1 - p) * p0)).otherwise(1.0)
            dz = F.when(c == 0, p * (1 - p) * (1 - p0) / (p + (1 - p) * p0)).otherwise(-p)
        g = [factor * d_eta * x for x in (F.lit(1.0), *(F.col(x) for x in xs))]
        return ll, g + ([factor * d_al] if negative else []) + ([dz] if inflated else [])

    theta, (ll, _, h) = _newton(v, start, loss)
    inv = inverse(h)
    v.unpersist()
    se = np.sqrt(np.abs(np.diag(inv))) if inv is not None else np.full(len(theta), np.nan)
    return _table(df, names, theta, se, None, kind[len(COEF):], ([ll] * len(theta), [m.n] * len(theta)))


# groups


def _group_sums(v: DataFrame, y: Column, xs: Sequence[str], key: str, weight: Column | None = None) -> DataFrame:
    """Per group its rows n and the products a0_0, a0_1, ... of (1, x, y): a row per group, as wide as the model."""
    c = [F.lit(1.0), *(F.col(x) for x in xs), y]
    w = F.lit(1.0) if weight is None else weight
    k = len(c)
    return v.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(w * c[i] * c[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)))


def _square(r, k: int, name: str = "a") -> np.ndarray:
    return np.array([[r[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])


def _group_products(v: DataFrame, y: Column, xs: Sequence[str], key: str, weight: Column | None = None) -> list:
    """Per group the products of (1, x, y); a row per group, each as wide as the model."""
    return [(r[key], r.n, _square(r, len(xs) + 2)) for r in _group_sums(v, y, xs, key, weight).collect()]


def _size_terms(groups: DataFrame, k: int) -> list:
    """Of groups of one size: the size, their number, the sum of their products, and that of the products of their sums. The ratio
    of variances acts on a group through its size alone, so these give every value of the criterion. Different sizes add up to
    the number of rows at most, so that n rows have fewer than sqrt(2 n) of them."""
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    by = groups.groupBy("n").agg(F.count(F.lit(1)).alias("c"), *(F.sum(f"a{i}_{j}").alias(f"a{i}_{j}") for i, j in upper), *(F.sum(F.col(f"a0_{i}") * F.col(f"a0_{j}")).alias(f"o{i}_{j}") for i, j in upper))
    return [(r.n, r.c, _square(r, k), _square(r, k, "o")) for r in by.orderBy("n").collect()]


def _reml(terms: list, k: int, lam: float, reml: bool = True):
    """Profile criterion, beta, its inverse information and the residual variance for a ratio lam of group to residual variance."""
    a, logs, n = np.zeros((k + 1, k + 1)), 0.0, 0.0
    for size, many, m, o in terms:
        a += m - lam / (1 + lam * size) * o
        logs += many * math.log1p(lam * size)
        n += many * size
    beta = solve(a[:k, :k], a[:k, k])
    if beta is None:
        return math.inf, None, None, None
    rss = max(1e-300, a[k, k] - beta @ a[:k, k])
    d = n - k if reml else n
    return 0.5 * (d * math.log(rss / d) + logs + (np.linalg.slogdet(a[:k, :k])[1] if reml else 0)), beta, inverse(a[:k, :k]), rss / d


def _golden(f: Callable, low: float, high: float) -> float:
    r = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(200):
        if b - a < 1e-10:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return 0.5 * (a + b)


def mixed(df: DataFrame, y: str, xs: Sequence[str], key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A random intercept per group by REML: fixed effects, variance components with the ICC, and predicted intercepts (a row per
    group, which stays on the cluster: the driver gets a row per size of group). Rows that miss a value or the group take no
    part; with fewer than two groups, or no more rows than coefficients and one, the tables are empty."""
    k = len(xs) + 1
    groups = settled(_group_sums(numbers(df, y, *xs, keep=(key,)), F.col(y), xs, key))
    terms = _size_terms(groups, k + 1)
    kinds = ("component string, value double", "group string, n long, effect double")
    n, many = sum(t[0] * t[1] for t in terms), sum(t[1] for t in terms)
    if many < 2 or n <= k + 1:
        return one_row(df, COEF), one_row(df, kinds[0]), one_row(df, kinds[1])
    t = _golden(lambda t: _reml(terms, k, math.exp(t))[0], -15.0, 10.0)
    lam = math.exp(t) if _reml(terms, k, math.exp(t))[0] < _reml(terms, k, 0.0)[0] else 0.0
    _, beta, inv, s2 = _reml(terms, k, lam)
    left = F.col(f"a0_{k}") - sum((F.col(f"a0_{i}") * float(beta[i]) for i in range(k)), F.lit(0.0))
    effects = groups.select(F.col(key).alias("group"), "n", (lam / (1 + lam * F.col("n")) * left).alias("effect"))
    comp = [("group", lam * s2), ("residual", s2), ("icc", lam / (1 + lam))]
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv) * s2), n - k), table(df.sparkSession, [(a, float(x)) for a, x in comp], kinds[0]), effects


def glmm(df: DataFrame, y: str, xs: Sequence[str], key: str, family: str = "binomial", most: int = 100, tol: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """A random intercept in a binomial or Poisson model by penalised quasi-likelihood: working responses per group, then
    the variance by the profile of the linear mixed model. The groups' effects are joined to the rows, not broadcast."""
    v = numbers(df, y, *xs, keep=(key,)).cache()
    k, beta, lam = len(xs) + 1, np.zeros(len(xs) + 1), 0.1
    spark = df.sparkSession
    m = v.agg(F.avg(y)).collect()[0][0]
    if not m:
        return one_row(df, COEF), one_row(df, "component string, value double")
    beta[0] = math.log(m) if family == "poisson" else math.log(m / max(1e-9, 1 - m)) if m < 1 else 5.0
    effects: dict[str, float] = {}
    inv = None
    for _ in range(most):
        e = table(spark, [(a, b) for a, b in effects.items()] or [("", 0.0)], f"`{key}` string, _u double")
        rows = v.join(e, key, "left").withColumn("_u", F.coalesce("_u", F.lit(0.0)))
        eta = F.greatest(F.least(_lin(xs, beta) + F.col("_u"), F.lit(30.0)), F.lit(-30.0))
        mu = F.exp(eta) if family == "poisson" else _sigmoid(eta)
        w = mu if family == "poisson" else mu * (1 - mu)
        groups = _group_products(rows, eta + (F.col(y) - mu) / w, xs, key, w)
        # weighted: the residual variance is 1, so the criterion keeps it fixed
        def crit(t, groups=groups):
            s, a = math.exp(t), np.zeros((k + 1, k + 1))
            logs = 0.0
            for _, _, g in groups:
                a += g - s / (1 + s * g[0, 0]) * np.outer(g[0], g[0])
                logs += math.log1p(s * g[0, 0])
            b = solve(a[:k, :k], a[:k, k])
            return math.inf if b is None else 0.5 * (a[k, k] - b @ a[:k, k] + logs + np.linalg.slogdet(a[:k, :k])[1])

        lam = math.exp(_golden(crit, -12.0, 5.0))
        a = sum(g - lam / (1 + lam * g[0, 0]) * np.outer(g[0], g[0]) for _, _, g in groups)
        new, inv = solve(a[:k, :k], a[:k, k]), inverse(a[:k, :k])
        if new is None:
            break
        b = np.append(new, -1)
        effects = {g: float(lam / (1 + lam * m_[0, 0]) * -(m_[0] @ b)) for g, _, m_ in groups}
        step, beta = np.abs(new - beta).max(), new
        if step < tol:
            break
    v.unpersist()
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv))), table(spark, [("group", float(lam))], "component string, value double")


def gee(df: DataFrame, y: str, xs: Sequence[str], key: str, family: str = "gaussian", structure: str = "exchangeable", most: int = 100, tol: float = 1e-9) -> DataFrame:
    """Marginal models with sandwich errors; every group of two rows at least. The exchangeable inverse needs only sums per group,
    so a step is one grouped aggregation."""
    v = numbers(df, y, *xs, keep=(key,)).cache()
    kind = COEF + ", naive_se double, alpha double"
    k, x = len(xs) + 1, [F.lit(1.0), *(F.col(c) for c in xs)]
    if v.groupBy(key).count().where("count < 2").limit(1).count() or not v.limit(1).count():
        return one_row(df, kind)
    beta, alpha, phi = np.zeros(k), 0.0, 1.0
    for _ in range(most):
        eta = _lin(xs, beta)
        mu = eta if family == "gaussian" else _sigmoid(eta)
        sd = F.lit(1.0) if family == "gaussian" else F.sqrt(mu * (1 - mu))
        r, z = (F.col(y) - mu) / sd, [sd * c if family != "gaussian" else c for c in x]
        g = v.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("r"), F.sum(r * r).alias("rr"), *(F.sum(c).alias(f"z{i}") for i, c in enumerate(z)), *(F.sum(c * r).alias(f"zr{i}") for i, c in enumerate(z)), *(F.sum(z[i] * z[j]).alias(f"zz{i}_{j}") for i in range(k) for j in range(i, k)))
        s = g.agg(F.sum("n").alias("n"), F.sum("rr").alias("rr"), F.sum(F.col("r") * F.col("r") - F.col("rr")).alias("off"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).collect()[0]
        phi = s.rr / (s.n - k)
        alpha = max(-0.9, min(0.95, s.off / ((s.pairs / 2 - k) * 2 * phi))) if structure == "exchangeable" and s.pairs / 2 > k else 0.0
        # R^-1 = (I - c J) / (1 - alpha), with c = alpha / (1 + (n - 1) alpha)
        c = F.lit(alpha) / (1 + (F.col("n") - 1) * alpha)
        score = [(F.col(f"zr{i}") - c * F.col(f"z{i}") * F.col("r")) / (1 - alpha) for i in range(k)]
        info = {(i, j): (F.col(f"zz{i}_{j}") - c * F.col(f"z{i}") * F.col(f"z{j}")) / (1 - alpha) for i in range(k) for j in range(i, k)}
        t = g.agg(*(F.sum(e).alias(f"s{i}") for i, e in enumerate(score)), *(F.sum(e).alias(f"i{i}_{j}") for (i, j), e in info.items()), *(F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).collect()[0]
        full = lambda n: np.array([[t[f"{n}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        inv = inverse(full("i"))
        if inv is None:
            return one_row(df, kind)
        d = inv @ np.array([t[f"s{i}"] for i in range(k)])
        beta = beta + d
        if np.abs(d).max() < tol * max(1.0, np.abs(beta).max()):
            break
    v.unpersist()
    return _table(df, _names(xs), beta, np.sqrt(np.diag(inv @ full("m") @ inv)), None, ", naive_se double, alpha double", (np.sqrt(np.diag(inv) * phi).tolist(), [float(alpha)] * k))


def canonical_correlation(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical correlations with Bartlett's sequential tests, the four multivariate statistics, and loadings."""
    names = [*left, *right]
    _, c, n = covariance(numbers(df, *names), names)
    kinds = ("root int, r double, wilks double, chi2 double, df double, p double", "test string, value double, f double, df1 double, df2 double, p double", "root int, side string, variable string, loading double")
    p, q = len(left), len(right)
    if n <= p + q + 1 or np.any(np.diag(c) <= 0):
        return tuple(one_row(df, k) for k in kinds)
    d = np.sqrt(np.diag(c))
    r = c / np.outer(d, d)
    rx, ry, rxy = r[:p, :p], r[p:, p:], r[:p, p:]
    half = lambda m: (lambda w, v: v @ np.diag(1 / np.sqrt(w)) @ v.T)(*np.linalg.eigh(m))
    hx, hy = half(rx), half(ry)
    u, s, vt = np.linalg.svd(hx @ rxy @ hy)
    k = min(p, q)
    s = np.minimum(s[:k], 1 - 1e-15)
    spark, out, loads = df.sparkSession, [], []
    for i in range(k):
        w = float(np.prod(1 - s[i:] ** 2))
        chi, dd = -(n - 1 - (p + q + 1) / 2) * math.log(w), (p - i) * (q - i)
        out.append((i + 1, float(s[i]), w, chi, float(dd), dist.chi2_upper(chi, dd)))
        for side, m, a, nm in (("left", rx, hx @ u[:, i], left), ("right", ry, hy @ vt[i], right)):
            loads += [(i + 1, side, name, float(x)) for name, x in zip(nm, m @ a)]
    tests = multivariate_tests(s**2 / (1 - s**2), p, q, n - 1 - q)
    return table(spark, out, kinds[0]), table(spark, tests, kinds[1]), table(spark, loads, kinds[2])
