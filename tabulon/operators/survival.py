"""Survival analysis and ROC curves, over distinct times or scores with counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import numbers, table
from ..functions import dist
from ..functions.linalg import inverse
from .nonparam import one_row
from .running import running_sums


def _times(df: DataFrame, time: str, status: str, key: str | None) -> DataFrame:
    """Per group and distinct time: events d, rows c, and the number at risk n."""
    v = numbers(df, time, status, keep=(key,) if key else ()).select((F.col(key) if key else F.lit("all")).alias("group"), F.col(time).alias("time"), (F.col(status) > 0.5).cast("long").alias("d"))
    t = v.groupBy("group", "time").agg(F.sum("d").alias("d"), F.count(F.lit(1)).alias("c"))
    return running_sums(t, "time", {"n": "c"}, ["group"], descending=True)


def kaplan_meier(df: DataFrame, time: str, status: str, key: str | None = None) -> DataFrame:
    """Product-limit survival with Greenwood's error and a log-log interval, at each event time."""
    t = _times(df, time, status, key).where("d > 0")
    last = F.col("n") == F.col("d")
    logs = F.when(~last, F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)
    green = F.when(~last, F.col("d") / (F.col("n") * (F.col("n") - F.col("d")))).otherwise(0.0)
    s = running_sums(t, "time", {"_l": logs, "_g": green, "_z": last.cast("long")}, ["group"]).withColumn("survival", F.when(F.col("_z") > 0, 0.0).otherwise(F.exp("_l")))
    half = 1.96 * F.sqrt("_g") / F.abs(F.log("survival"))
    ok = (F.col("survival") > 0) & (F.col("survival") < 1)
    return s.select("group", "time", "n", "d", "survival", (F.col("survival") * F.sqrt("_g")).alias("se"), F.when(ok, F.pow("survival", F.exp(half))).alias("low"), F.when(ok, F.pow("survival", F.exp(-half))).alias("high"))


def survival_summary(df: DataFrame, time: str, status: str, key: str | None = None) -> DataFrame:
    """Rows, events and the median survival time per group."""
    t = _times(df, time, status, key).groupBy("group").agg(F.sum("c").alias("n"), F.sum("d").alias("events"))
    med = kaplan_meier(df, time, status, key).where("survival <= 0.5").groupBy("group").agg(F.min("time").alias("median"))
    return t.join(med, "group", "left")


def log_rank(df: DataFrame, time: str, status: str, key: str, compat: bool = False) -> DataFrame:
    """Observed and expected events by the times of all groups; the quadratic form, or (compat) the sum of U^2 / V."""
    t = _times(df, time, status, key)
    kind = "chi2 double, df long, p double"
    groups = [r[0] for r in t.select("group").distinct().orderBy("group").collect()]  # a row per group
    k = len(groups)
    if k < 2:
        return one_row(df, kind)
    wide = t.groupBy("time").pivot("group", groups).agg(F.sum("d").alias("d"), F.sum("c").alias("c")).fillna(0)
    wide = wide.toDF("time", *(f"{x}{i}" for i in range(k) for x in ("d", "c")))
    risk = running_sums(wide, "time", {f"n{i}": f"c{i}" for i in range(k)}, descending=True)
    d, n = sum((F.col(f"d{i}") for i in range(k)), F.lit(0)), sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
    e = [d * F.col(f"n{i}") / n for i in range(k)]
    factor = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    s = risk.where(d > 0).agg(*(F.sum(F.col(f"d{i}") - e[i]).alias(f"u{i}") for i in range(k)), *(F.sum(factor * (F.col(f"n{i}") / n) * (F.lit(float(i == j)) - F.col(f"n{j}") / n)).alias(f"v{i}_{j}") for i in range(k) for j in range(k))).collect()[0]
    if s.u0 is None:
        return one_row(df, kind)
    u = np.array([s[f"u{i}"] for i in range(k)])
    v = np.array([[s[f"v{i}_{j}"] for j in range(k)] for i in range(k)])
    if compat and k > 2:
        chi = float(sum(u[i] ** 2 / v[i, i] for i in range(k) if v[i, i] > 0))
    else:
        inv = inverse(v[:-1, :-1])
        chi = float(u[:-1] @ inv @ u[:-1]) if inv is not None else None
    return one_row(df, kind, chi, k - 1, dist.chi2_upper(chi, k - 1) if chi is not None else None)


def nelson_aalen(df: DataFrame, time: str, status: str) -> DataFrame:
    t = _times(df, time, status, None).where("d > 0")
    return running_sums(t, "time", {"hazard": F.col("d") / F.col("n")}).select("time", "n", "d", "hazard")


def _cox_step(v: DataFrame, xs: Sequence[str], beta: np.ndarray) -> DataFrame:
    """Sums per distinct time, and over the risk set at it: s0, s1 and s2."""
    k = len(xs)
    e = F.exp(sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, xs)), F.lit(0.0)))
    parts = {"s0": F.lit(1.0)} | {f"s1_{i}": F.col(x) for i, x in enumerate(xs)} | {f"s2_{i}_{j}": F.col(xs[i]) * F.col(xs[j]) for i in range(k) for j in range(i, k)}
    t = v.groupBy("_t").agg(F.sum("_d").alias("d"), *(F.sum(e * c).alias(n) for n, c in parts.items()), *(F.sum(F.col("_d") * F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)))
    return running_sums(t, "_t", {n: n for n in parts}, descending=True).where("d > 0")


def cox(df: DataFrame, time: str, status: str, xs: Sequence[str], most: int = 100, tol: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """Proportional hazards with Breslow's ties, five events at least: coefficients, and the baseline hazard. Covariates are centred."""
    kind = "term string, estimate double, se double, z double, p double, hazard_ratio double, low double, high double, log_likelihood double, null_log_likelihood double"
    base = "time double, hazard double, survival double"
    v = numbers(df, time, status, *xs)
    m = v.agg(F.sum((F.col(status) > 0.5).cast("long")).alias("e"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(xs))).collect()[0]
    if (m.e or 0) < 5:
        return one_row(df, kind), one_row(df, base)
    v = v.select(F.col(time).alias("_t"), (F.col(status) > 0.5).cast("double").alias("_d"), *((F.col(x) - m[f"m{i}"]).alias(x) for i, x in enumerate(xs))).cache()
    k, beta, l0 = len(xs), np.zeros(len(xs)), None

    def at(b):
        r = _cox_step(v, xs, b)
        mean = [F.col(f"s1_{i}") / F.col("s0") for i in range(k)]
        s = r.agg(F.sum(sum((F.lit(float(x)) * F.col(f"x{i}") for i, x in enumerate(b)), F.lit(0.0)) - F.col("d") * F.log("s0")).alias("l"), *(F.sum(F.col(f"x{i}") - F.col("d") * mean[i]).alias(f"u{i}") for i in range(k)), *(F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / F.col("s0") - mean[i] * mean[j])).alias(f"i{i}_{j}") for i in range(k) for j in range(i, k))).collect()[0]
        return s.l, np.array([s[f"u{i}"] for i in range(k)]), np.array([[s[f"i{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    now = at(beta)
    l0 = now[0]
    for _ in range(most):
        inv = inverse(now[2])
        if inv is None:
            v.unpersist()
            return one_row(df, kind), one_row(df, base)
        d, size = inv @ now[1], 1.0
        while size > 1e-4 and (new := at(beta + size * d))[0] < now[0] - 1e-9:
            size /= 2
        beta, now = beta + size * d, new
        if np.abs(d).max() < tol:
            break
    se, out = np.sqrt(np.diag(inverse(now[2]))), []
    for x, b, s in zip(xs, beta, se):
        out.append((x, float(b), float(s), float(b / s), dist.norm_two_sided(b / s), math.exp(b), math.exp(b - 1.96 * s), math.exp(b + 1.96 * s), now[0], l0))
    shift = math.exp(-sum(float(b) * m[f"m{i}"] for i, b in enumerate(beta)))
    hz = running_sums(_cox_step(v, xs, beta), "_t", {"hazard": F.lit(shift) * F.col("d") / F.col("s0")}).select(F.col("_t").alias("time"), "hazard")
    return table(df.sparkSession, out, kind), hz.withColumn("survival", F.exp(-F.col("hazard")))


def roc_points(df: DataFrame, score: str, label: str, positive: str) -> DataFrame:
    """Sensitivity and specificity at each distinct score taken as the least positive one."""
    v = numbers(df, score, keep=(label,))
    c = v.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == positive).alias("p"), F.count_if(F.col(label) != positive).alias("q"))
    c = running_sums(c, "threshold", {"tp": "p", "fp": "q"}, descending=True, totals={"np": "tp", "nn": "fp"})
    return c.select("threshold", "tp", "fp", (F.col("tp") / F.col("np")).alias("sensitivity"), (1 - F.col("fp") / F.col("nn")).alias("specificity"), (F.col("tp") / F.col("np") - F.col("fp") / F.col("nn")).alias("youden"))


def roc(df: DataFrame, score: str, label: str, positive: str) -> DataFrame:
    """Area with Hanley-McNeil error, interval and p, U, and the best threshold by Youden's index."""
    v = numbers(df, score, keep=(label,))
    c = v.groupBy(score).agg(F.count_if(F.col(label) == positive).cast("double").alias("p"), F.count_if(F.col(label) != positive).cast("double").alias("q"))
    s = running_sums(c, score, {"b": "q"}).withColumn("b", F.col("b") - F.col("q")).agg(F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("q").alias("q")).collect()[0]
    kind = "auc double, se double, low double, high double, p double, u double, n_positive long, n_negative long, threshold double, youden double"
    if not s.p or not s.q:
        return one_row(df, kind)
    a = s.u / (s.p * s.q)
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    se = math.sqrt(max(0.0, (a * (1 - a) + (s.p - 1) * (q1 - a * a) + (s.q - 1) * (q2 - a * a)) / (s.p * s.q)))
    best = roc_points(df, score, label, positive).orderBy(F.desc("youden"), F.desc("threshold")).limit(1).collect()[0]
    z0 = math.sqrt((s.p + s.q + 1) / (12 * s.p * s.q))
    return one_row(df, kind, a, se, max(0.0, a - 1.96 * se), min(1.0, a + 1.96 * se), dist.norm_two_sided((a - 0.5) / z0), s.u, int(s.p), int(s.q), best.threshold, best.youden)
