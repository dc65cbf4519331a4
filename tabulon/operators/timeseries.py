"""Time series: autocorrelation, decomposition, Holt-Winters, ARIMA by an exact filter, and a tournament of orders.

A series is one column in row order with missing values closed up. Lags are joined by row number, which spreads a long
series over tasks; recursions that go through a series value by value run in one task per series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ROW, num, with_row, table
from ..functions import dist
from .nonparam import one_row


def series(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """(_rid, v): the column's values in order, without missing ones."""
    v = df.select(num(df, col).alias("v"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order))).where("v IS NOT NULL")
    return with_row(v, [f"_o{i}" for i in range(len(order))]).select(ROW, "v")


def acf_pacf(df: DataFrame, col: str, order: Sequence[str], lags: int = 20) -> DataFrame:
    """Autocorrelations over the total sum of squares, partial ones by Durbin and Levinson, bounds, and Ljung-Box."""
    s = series(df, col, order).cache()
    m = s.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("v")).collect()[0]
    kind = "lag int, acf double, pacf double, bound double, ljung_box double, p double"
    if m.n < 3 or not m.v:
        s.unpersist()
        return one_row(df, kind)
    lags = min(lags, m.n - 1)
    d = s.select(ROW, (F.col("v") - m.m).alias("v"))
    pairs = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(lags)))).select((F.col(ROW) + F.col("k")).alias(ROW), "k", F.col("v").alias("u"))
    c = {r.k: r.c for r in pairs.join(d, ROW).groupBy("k").agg(F.sum(F.col("u") * F.col("v")).alias("c")).collect()}  # a row per lag
    s.unpersist()
    r = np.array([1.0] + [c.get(k, 0.0) / (m.n * m.v) for k in range(1, lags + 1)])
    phi, out, q = np.zeros((lags + 1, lags + 1)), [], 0.0
    for k in range(1, lags + 1):
        below = 1 - phi[k - 1, 1:k] @ r[1:k]
        phi[k, k] = (r[k] - phi[k - 1, 1:k] @ r[1:k][::-1]) / below if abs(below) > 1e-300 else 0.0
        phi[k, 1:k] = phi[k - 1, 1:k] - phi[k, k] * phi[k - 1, 1:k][::-1]
        q += r[k] ** 2 / (m.n - k)
        lb = m.n * (m.n + 2) * q
        out.append((k, float(r[k]), float(phi[k, k]), 1.96 / math.sqrt(m.n), float(lb), dist.chi2_upper(lb, k)))
    return table(df.sparkSession, out, kind)


def decompose(df: DataFrame, col: str, order: Sequence[str], period: int) -> DataFrame:
    """Additive decomposition: a centred moving average (2 x m for an even period), centred seasonal means, the rest."""
    s = series(df, col, order)
    half = period // 2
    n = s.count()
    if n < 2 * period:
        return one_row(df, "position long, value double, trend double, seasonal double, remainder double")
    weight = [(k, (0.5 if period % 2 == 0 and abs(k) == half else 1.0) / period) for k in range(-half, half + 1)]
    spread = s.select(F.explode(F.array(*(F.struct((F.col(ROW) + F.lit(k)).alias(ROW), (F.col("v") * w).alias("w")) for k, w in weight))).alias("x")).select("x.*")
    trend = spread.groupBy(ROW).agg(F.sum("w").alias("trend"), F.count(F.lit(1)).alias("c")).where(F.col("c") == len(weight)).drop("c")
    j = s.join(trend, ROW, "left").withColumn("phase", F.pmod(ROW, F.lit(period)))
    season = j.groupBy("phase").agg(F.avg(F.col("v") - F.col("trend")).alias("s"))
    mean = season.agg(F.avg("s").alias("ms"))
    season = season.crossJoin(F.broadcast(mean)).select("phase", (F.col("s") - F.col("ms")).alias("seasonal"))  # one row of means, a row per phase
    return j.join(F.broadcast(season), "phase").select((F.col(ROW) + 1).alias("position"), F.col("v").alias("value"), "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("remainder"))


def _whole(df: DataFrame, col: str, order: Sequence[str], run, kind: str, by: str | None = None) -> DataFrame:
    """A recursion over whole series: one task per series, which must fit there."""
    if by is None:
        s = series(df, col, order).withColumn("_s", F.lit(0))
        return s.groupBy("_s").applyInPandas(lambda f: run(f.sort_values(ROW)["v"].to_numpy(float)), kind)
    v = df.select(F.col(by).cast("string").alias("series"), num(df, col).alias("v"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order))).where("v IS NOT NULL")

    def one(f: pd.DataFrame) -> pd.DataFrame:
        out = run(f.sort_values([f"_o{i}" for i in range(len(order))])["v"].to_numpy(float))
        out.insert(0, "series", f["series"].iloc[0])
        return out

    return v.groupBy("series").applyInPandas(one, "series string, " + kind)


def holt_winters(df: DataFrame, col: str, order: Sequence[str], period: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.1, horizon: int = 12, by: str | None = None) -> DataFrame:
    """Additive smoothing with fixed parameters: fitted values, then forecasts (value missing)."""

    def run(x: np.ndarray) -> pd.DataFrame:
        n = len(x)
        if n < 2 * period:
            return pd.DataFrame({"position": pd.Series(dtype="int64"), "value": pd.Series(dtype=float), "fitted": pd.Series(dtype=float)})
        level, trend = x[:period].mean(), (x[period : 2 * period].mean() - x[:period].mean()) / period
        season, fit = list(x[:period] - level), np.empty(n + horizon)
        for t in range(n):
            s = season[t % period]
            fit[t] = level + trend + s
            new = alpha * (x[t] - s) + (1 - alpha) * (level + trend)
            trend, level = beta * (new - level) + (1 - beta) * trend, new
            season[t % period] = gamma * (x[t] - level) + (1 - gamma) * s
        for h in range(horizon):
            fit[n + h] = level + (h + 1) * trend + season[(n + h) % period]
        return pd.DataFrame({"position": np.arange(1, n + horizon + 1), "value": np.append(x, np.full(horizon, np.nan)), "fitted": fit})

    return _whole(df, col, order, run, "position long, value double, fitted double", by)


def _poly(small: np.ndarray, large: np.ndarray, period: int, sign: float) -> np.ndarray:
    """Coefficients of (1 + sign a L ..)(1 + sign A L^s ..), after the leading one."""
    a = np.zeros(len(small) + 1)
    a[0], a[1:] = 1, sign * small
    b = np.zeros(len(large) * period + 1)
    b[0] = 1
    for i, x in enumerate(large):
        b[(i + 1) * period] = sign * x
    return np.convolve(a, b)[1:]


def _stable(raw: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary polynomial from free numbers, by partial autocorrelations."""
    out = np.zeros(0)
    for x in np.tanh(raw):
        out = np.append(out - x * out[::-1], x)
    return out


def _filter(x: np.ndarray, ar: np.ndarray, ma: np.ndarray, ahead: int = 0):
    """Exact Gaussian likelihood of a stationary ARMA by a state-space filter: (sum of squares, sum of logs, forecasts, their variances)."""
    r = max(len(ar), len(ma) + 1)
    t = np.zeros((r, r))
    t[: len(ar), 0] = ar
    t[np.arange(r - 1), np.arange(1, r)] = 1
    g = np.zeros(r)
    g[0], g[1 : len(ma) + 1] = 1, ma
    q = np.outer(g, g)
    p, a = q.copy(), t.copy()
    for _ in range(60):  # doubling: the sum of T^i Q T^i'
        step = a @ p @ a.T
        p, a = p + step, a @ a
        if np.abs(step).max() < 1e-13 * np.abs(p).max():
            break
    s, ss, logs = np.zeros(r), 0.0, 0.0
    for v in x:
        f = p[0, 0]
        e = v - s[0]
        k = t @ p[:, 0] / f
        ss, logs = ss + e * e / f, logs + math.log(f)
        s = t @ s + k * e
        p = t @ p @ t.T + q - np.outer(k, k) * f
    fore, var = [], []
    for _ in range(ahead):
        fore.append(s[0])
        var.append(p[0, 0])
        s, p = t @ s, t @ p @ t.T + q
    return ss, logs, np.array(fore), np.array(var)


def nelder_mead(f, start: np.ndarray, most: int = 400, tol: float = 1e-8) -> np.ndarray:
    k = len(start)
    pts = [start] + [start + 0.3 * np.eye(k)[i] for i in range(k)]
    val = [f(p) for p in pts]
    for _ in range(most):
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < tol * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], 0)
        r = 2 * mid - pts[-1]
        fr = f(r)
        if fr < val[0]:
            e = 3 * mid - 2 * pts[-1]
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = 0.5 * (mid + (r if fr < val[-1] else pts[-1]))
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [0.5 * (p + pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


def fit_arima(x: np.ndarray, order=(1, 0, 0), seasonal=(0, 0, 0), period: int = 0, horizon: int = 12):
    """(names, values, log-likelihood, aic, forecasts, errors), or None for too short a series."""
    (p, d, q), (P, D, Q) = order, seasonal
    if not (p <= 2 and d <= 1 and q <= 2 and max(P, D, Q) <= 1 and period <= 12):
        raise ValueError("p and q up to 2, d, P, D and Q up to 1, a period up to 12")
    least = (24, 20) if max(P, D, Q) else (12, 10)
    w = np.diff(x) if d else x.copy()
    if D:
        w = w[period:] - w[:-period]
    if len(x) < least[0] or len(w) < least[1]:
        return None
    mean = 0.0 if d or D else w.mean()
    y, n = w - mean, len(w)

    def split(t):
        ar = _poly(_stable(t[:p]), np.tanh(t[p + q : p + q + P]), period, -1.0)
        ma = _poly(-_stable(t[p : p + q]), np.tanh(t[p + q + P :]), period, 1.0)
        return -ar, ma

    def loss(t):
        ss, logs, _, _ = _filter(y, *split(t))
        return 0.5 * (n * math.log(max(ss, 1e-300) / n) + logs)

    t = nelder_mead(loss, np.full(p + q + P + Q, 0.1)) if p + q + P + Q else np.zeros(0)
    ar, ma = split(t)
    ss, logs, fore, var = _filter(y, ar, ma, horizon)
    s2 = ss / n
    ll = -0.5 * (n * math.log(2 * math.pi * s2) + logs + n)
    # the forecasts' errors add up as differences are undone
    psi = np.zeros(horizon)
    full = ar
    for k, lag in ((d, 1), (D, period)):
        if k:
            c = np.zeros(lag)
            c[-1] = -1.0
            full = -np.convolve(np.append(1, -full), np.append(1, c))[1:]
    for h in range(horizon):
        psi[h] = 1.0 if h == 0 else (ma[h - 1] if h <= len(ma) else 0.0) + sum(full[i] * psi[h - 1 - i] for i in range(min(h, len(full))))
    f = fore + mean
    if D:
        base = np.diff(x) if d else x
        for h in range(horizon):
            f[h] += base[len(base) - period + h] if h < period else f[h - period]
    if d:
        f = x[-1] + np.cumsum(f)
    names = [*(f"ar{i + 1}" for i in range(p)), *(f"ma{i + 1}" for i in range(q)), *(f"sar{i + 1}" for i in range(P)), *(f"sma{i + 1}" for i in range(Q)), "mean", "sigma2"]
    values = [*_stable(t[:p]), *(-_stable(t[p : p + q])), *np.tanh(t[p + q : p + q + P]), *np.tanh(t[p + q + P :]), mean, s2]
    return names, values, ll, -2 * ll + 2 * (len(t) + 1 + (mean != 0)), f, np.sqrt(s2 * np.cumsum(psi**2))


def arima(df: DataFrame, col: str, order_by: Sequence[str], order=(1, 0, 0), seasonal=(0, 0, 0), period: int = 0, horizon: int = 12, by: str | None = None) -> DataFrame:
    """Parameters (kind "parameter") and forecasts (kind "forecast", with errors) per series; short series give none."""

    def run(x: np.ndarray) -> pd.DataFrame:
        fit = fit_arima(x, order, seasonal, period, horizon)
        rows = []
        if fit:
            rows = [("parameter", a, float(b), None) for a, b in zip(fit[0], fit[1])] + [("fit", "log_likelihood", fit[2], None), ("fit", "aic", fit[3], None)] + [("forecast", str(h + 1), float(a), float(b)) for h, (a, b) in enumerate(zip(fit[4], fit[5]))]
        return pd.DataFrame(rows, columns=["kind", "name", "value", "se"]).astype({"value": float, "se": float})

    return _whole(df, col, order_by, run, "kind string, name string, value double, se double", by)


#: The orders of the tournament.
ORDERS = [(0, 0, 0), (1, 0, 0), (0, 0, 1), (1, 0, 1), (2, 0, 0), (0, 1, 0), (1, 1, 0), (0, 1, 1), (1, 1, 1), (2, 1, 0), (0, 1, 2), (2, 1, 1)]


def tournament(df: DataFrame, col: str, order_by: Sequence[str], horizon: int = 12) -> DataFrame:
    """Mean RMSE of each order over three rolling origins against the naive forecast; orders are fitted in parallel."""
    s = series(df, col, order_by)
    jobs = table(df.sparkSession, [(i, *o) for i, o in enumerate(ORDERS)], "i int, p int, d int, q int")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values(ROW)["v"].to_numpy(float)
        o = tuple(int(f[c].iloc[0]) for c in "pdq")
        errs, naive = [], []
        for back in (3, 2, 1):
            cut = len(x) - back * horizon
            fit = fit_arima(x[:cut], o, horizon=horizon) if cut >= 12 else None
            if fit:
                real = x[cut : cut + horizon]
                errs.append(math.sqrt(((fit[4] - real) ** 2).mean()))
                naive.append(math.sqrt(((x[cut - 1] - real) ** 2).mean()))
        return pd.DataFrame({"model": [f"({o[0]},{o[1]},{o[2]})"], "origins": [len(errs)], "rmse": [float(np.mean(errs)) if errs else np.nan], "naive_rmse": [float(np.mean(naive)) if naive else np.nan]})

    return s.crossJoin(F.broadcast(jobs)).groupBy("i").applyInPandas(run, "model string, origins int, rmse double, naive_rmse double").orderBy("rmse")  # twelve orders, one series
