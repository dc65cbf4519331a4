"""Multivariate analysis: reliability, factors, correspondence, optimal scaling, clusters, classification.

Matrices of the variables' size come from one aggregation. Hierarchical clusters, over all pairs of rows, take `max_rows` and refuse more."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ROW, numbers, settled, stored, table, text, with_row
from ..functions import dist
from ..functions.linalg import covariance, inverse
from .nearest import nearest
from .nonparam import one_row
from .running import running_sums


class TooManyRows(ValueError):
    """A method over all pairs of rows was given more rows than its bound."""


def _bounded(df: DataFrame, max_rows: int) -> DataFrame:
    n = df.limit(max_rows + 1).count()
    if n > max_rows:
        raise TooManyRows(f"this method compares all pairs of rows; it takes {max_rows} at most")
    return df


def reliability(df: DataFrame, items: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cronbach's alpha, raw and standardised, and per item: mean, sd, item-rest correlation, alpha without it."""
    m, c, n = covariance(numbers(df, *items), list(items))
    k = len(items)
    kinds = ("alpha double, standardised_alpha double, items int, n long", "item string, mean double, sd double, rest_r double, alpha_without double")
    if n < 3 or k < 2 or c.sum() <= 0:
        return one_row(df, kinds[0]), one_row(df, kinds[1])
    a = lambda x: len(x) / (len(x) - 1) * (1 - np.trace(x) / x.sum()) if len(x) > 1 and x.sum() > 0 else float("nan")
    d = np.sqrt(np.diag(c))
    r = c / np.outer(d, d) if np.all(d > 0) else None
    mean_r = (r.sum() - k) / (k * (k - 1)) if r is not None else float("nan")
    out = []
    for i in range(k):
        o = [j for j in range(k) if j != i]
        rest = c[np.ix_(o, o)]
        cov = c[i, o].sum()
        out.append((items[i], float(m[i]), float(d[i]), float(cov / (d[i] * math.sqrt(rest.sum()))) if d[i] and rest.sum() > 0 else None, float(a(rest))))
    return one_row(df, kinds[0], float(a(c)), float(k * mean_r / (1 + (k - 1) * mean_r)), k, n), table(df.sparkSession, out, kinds[1])


def varimax(load: np.ndarray, most: int = 500) -> np.ndarray:
    """Kaiser's rotation of normalised loadings, by planes."""
    h = np.sqrt((load**2).sum(1))
    h[h == 0] = 1
    x = load / h[:, None]
    p, k = x.shape
    for _ in range(most):
        moved = 0.0
        for i in range(k):
            for j in range(i + 1, k):
                u, v = x[:, i] ** 2 - x[:, j] ** 2, 2 * x[:, i] * x[:, j]
                num, den = 2 * (u @ v) - 2 * u.sum() * v.sum() / p, (u @ u - v @ v) - (u.sum() ** 2 - v.sum() ** 2) / p
                t = math.atan2(num, den) / 4
                if abs(t) > 1e-10:
                    moved = max(moved, abs(t))
                    x[:, [i, j]] = x[:, [i, j]] @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
        if moved < 1e-9:
            break
    return x * h[:, None]


def _signs(x: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive."""
    at = np.abs(x).argmax(0)
    return x * np.where(x[at, range(x.shape[1])] < 0, -1, 1)


def factor(df: DataFrame, cols: Sequence[str], k: int | None = None, method: str = "pca", rotate: bool = True) -> dict[str, DataFrame]:
    """Components or principal axes: tests (KMO, Bartlett), loadings with communalities, variance; scores() uses the weights."""
    m, c, n = covariance(numbers(df, *cols), list(cols))
    p, spark = len(cols), df.sparkSession
    kinds = {"tests": "kmo double, chi2 double, df long, p double, n long", "loadings": "variable string, factor int, loading double, communality double, weight double, kmo double", "variance": "factor int, eigenvalue double, loading_ss double, percent double, cumulative double"}
    if n < p + 1 or p < 2 or np.any(np.diag(c) <= 0):
        return {a: table(spark, [], b) for a, b in kinds.items()}
    d = np.sqrt(np.diag(c))
    r = c / np.outer(d, d)
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = k or max(1, int((values > 1).sum()))
    inv = inverse(r)
    kmo, each = float("nan"), np.full(p, np.nan)
    if inv is not None:
        q = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
        off = ~np.eye(p, dtype=bool)
        a, b = (r**2 * off).sum(1), (q**2 * off).sum(1)
        kmo, each = float(a.sum() / (a.sum() + b.sum())), a / (a + b)
    det = np.linalg.slogdet(r)[1]
    chi, dd = -(n - 1 - (2 * p + 5) / 6) * det, p * (p - 1) // 2
    if method == "pca" or inv is None:
        load = vectors[:, :k] * np.sqrt(np.maximum(0, values[:k]))
    else:
        h = np.clip(1 - 1 / np.diag(inv), 0.05, 0.99)
        for _ in range(200):
            w, u = np.linalg.eigh(r - np.eye(p) + np.diag(h))
            load = u[:, ::-1][:, :k] * np.sqrt(np.maximum(0, w[::-1][:k]))
            new = np.clip((load**2).sum(1), 0.05, 0.99)
            if np.abs(new - h).max() < 1e-10:
                break
            h = new
    load = _signs(varimax(load) if rotate and k > 1 else load)
    weight = (inv @ load) if inv is not None else load
    com, ss = (load**2).sum(1), (load**2).sum(0)
    return {
        "tests": table(spark, [(kmo, float(chi), dd, dist.chi2_upper(chi, dd), n)], kinds["tests"]),
        "loadings": table(spark, [(cols[i], j + 1, float(load[i, j]), float(com[i]), float(weight[i, j]), float(each[i])) for i in range(p) for j in range(k)], kinds["loadings"]),
        "variance": table(spark, [(i + 1, float(values[i]), float(ss[i]) if i < k else None, float(100 * ss[i] / p) if i < k else None, float(100 * ss[: i + 1].sum() / p) if i < k else None) for i in range(p)], kinds["variance"]),
    }


def factor_scores(df: DataFrame, cols: Sequence[str], loadings: DataFrame) -> DataFrame:
    """The complete rows with their scores: sums of standardised variables times the loadings table's weights."""
    v = numbers(df, *cols)
    s = v.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cols))).collect()[0]
    w = {(r.variable, r.factor): r.weight for r in loadings.collect()}  # variables by factors
    k = max(f for _, f in w)
    return v.select("*", *(sum((F.lit(w[c, f]) * (F.col(c) - s[f"m{i}"]) / s[f"s{i}"] for i, c in enumerate(cols)), F.lit(0.0)).alias(f"factor{f}") for f in range(1, k + 1)))


def correspondence(df: DataFrame, row: str, col: str) -> DataFrame:
    """Coordinates of rows and columns on each axis, with the axis' inertia; total inertia is chi-square / n."""
    t = df.select(text(F.col(row)).alias("r"), text(F.col(col)).alias("c")).dropna().groupBy("r", "c").agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row per cell
    kind = "side string, level string, axis int, coordinate double, mass double, inertia double, percent double"
    m = t.pivot(index="r", columns="c", values="n").fillna(0) if len(t) else pd.DataFrame()
    if min(m.shape) < 2:
        return one_row(df, kind)
    p = m.to_numpy(float) / m.to_numpy().sum()
    r, c = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    k = min(m.shape) - 1
    u, out = u[:, :k], []
    turn = np.where(u[np.abs(u).argmax(0), range(k)] < 0, -1, 1)
    for side, lev, mass, x in (("row", m.index, r, u * turn * s[:k] / np.sqrt(r)[:, None]), ("column", m.columns, c, vt[:k].T * turn * s[:k] / np.sqrt(c)[:, None])):
        out += [(side, str(lev[i]), j + 1, float(x[i, j]), float(mass[i]), float(s[j] ** 2), float(100 * s[j] ** 2 / (s[:k] ** 2).sum())) for i in range(len(lev)) for j in range(k)]
    return table(df.sparkSession, out, kind)


def princals(df: DataFrame, cols: Sequence[str], levels: dict[str, str] | None = None, dims: int = 2, most: int = 500, max_categories: int = 200) -> dict[str, DataFrame]:
    """Optimal scaling by alternating least squares over distinct rows with counts: quantifications and loadings. A
    column is nominal, ordinal (monotone) or numeric; each may have max_categories values."""
    levels, spark = levels or {}, df.sparkSession
    kinds = {"quantifications": "variable string, category string, quantification double, n long", "loadings": "variable string, dimension int, loading double", "fit": "dimension int, eigenvalue double"}
    t = df.select(*(text(F.col(c)).alias(c) for c in cols)).dropna().groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    rows = t.limit(200_001).toPandas()
    if len(rows) > 200_000:
        raise TooManyRows("more than 200,000 distinct rows")
    if len(rows) < 3:
        return {a: table(spark, [], b) for a, b in kinds.items()}
    w, n = rows["_n"].to_numpy(float), float(rows["_n"].sum())
    codes, names, q = [], [], []
    for c in cols:
        number = pd.to_numeric(rows[c], errors="coerce")
        lv = sorted(rows[c].unique(), key=(lambda s: (float(s), s)) if number.notna().all() else (lambda s: (0.0, s)))
        if len(lv) > max_categories:
            raise TooManyRows(f"{c} has more than {max_categories} categories")
        names.append(lv)
        codes.append(rows[c].map({x: i for i, x in enumerate(lv)}).to_numpy())
        q.append(np.array([float(x) for x in lv]) if number.notna().all() else np.arange(len(lv), dtype=float))

    def standard(x, code):
        size = np.bincount(code, w, len(x))
        x = x - (size @ x) / n
        s = math.sqrt((size @ x**2) / n)
        return x / s if s > 1e-12 else x

    q = [standard(x, c) for x, c in zip(q, codes)]
    numeric, last = [x.copy() for x in q], -1.0
    for _ in range(most):
        h = np.column_stack([x[c] for x, c in zip(q, codes)])
        values, vectors = np.linalg.eigh((h * w[:, None]).T @ h / n)
        values, vectors = values[::-1][:dims], _signs(vectors[:, ::-1][:, :dims])
        if abs(values.sum() - last) < 1e-10:
            break
        last = values.sum()
        score = h @ vectors
        for j, (c, lv) in enumerate(zip(codes, names)):
            size = np.bincount(c, w, len(lv))
            y = np.bincount(c, w * (score @ vectors[j]), len(lv)) / size
            kind = levels.get(cols[j], "nominal")
            if kind == "numeric":
                y = numeric[j]
            elif kind == "ordinal":
                y = monotone(y, size)
            q[j] = standard(y, c)
    load = vectors * np.sqrt(np.maximum(0, values))
    return {
        "quantifications": table(spark, [(c, str(lv), float(q[j][i]), int(np.bincount(codes[j], w, len(names[j]))[i])) for j, c in enumerate(cols) for i, lv in enumerate(names[j])], kinds["quantifications"]),
        "loadings": table(spark, [(c, d + 1, float(load[j, d])) for j, c in enumerate(cols) for d in range(load.shape[1])], kinds["loadings"]),
        "fit": table(spark, [(d + 1, float(x)) for d, x in enumerate(values)], kinds["fit"]),
    }


def monotone(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest rising sequence, by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for v, w in zip(y, weight):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(k), v) for v, _, k in blocks])


# clusters


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42, most: int = 100, tol: float = 1e-9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """k-means++ from a hash-drawn sample of 2,000 rows at most, then Lloyd's steps, one aggregation each with the centres
    as literals; an empty cluster keeps its centre. Centres, the trace of the within sum of squares, and the rows."""
    v = numbers(df, *cols).cache()
    p = len(cols)
    sample = v.withColumn("_h", F.xxhash64(F.lit(seed), *cols)).orderBy("_h", *cols).limit(2000).select(*cols).toPandas().to_numpy(float)
    kinds = ("cluster int, n long, " + ", ".join(f"`{c}` double" for c in cols), "step int, within_ss double")
    if len(sample) < k:
        return one_row(df, kinds[0]), one_row(df, kinds[1]), v.withColumn("cluster", F.lit(0))
    rng = np.random.default_rng(seed)
    centre = [sample[rng.integers(len(sample))]]
    while len(centre) < k:
        d = np.min([((sample - c) ** 2).sum(1) for c in centre], 0)
        centre.append(sample[rng.choice(len(sample), p=d / d.sum())] if d.sum() > 0 else sample[rng.integers(len(sample))])
    centre, trace, size = np.array(centre), [], np.zeros(k, int)

    def nearest(c):
        ds = [sum((F.pow(F.col(x) - F.lit(float(m)), 2) for x, m in zip(cols, row)), F.lit(0.0)) for row in c]
        best, at = ds[0], F.lit(1)
        for i, d in enumerate(ds[1:], 2):
            at, best = F.when(d < best, i).otherwise(at), F.least(best, d)
        return at, best

    for _ in range(most):
        at, d = nearest(centre)
        g = v.groupBy(at.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("s"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols))).collect()  # a row per cluster
        new, size = centre.copy(), np.zeros(k, int)
        for r in g:
            new[r.g - 1], size[r.g - 1] = [r[f"m{i}"] for i in range(p)], r.n
        trace.append(sum(r.s for r in g))
        if np.abs(new - centre).max() < tol:
            break
        centre = new
    v.unpersist()
    spark = df.sparkSession
    return table(spark, [(i + 1, int(size[i]), *map(float, centre[i])) for i in range(k)], kinds[0]), table(spark, [(i + 1, float(s)) for i, s in enumerate(trace)], kinds[1]), v.withColumn("cluster", nearest(centre)[0])


def hierarchical(df: DataFrame, cols: Sequence[str], method: str = "ward", k: int = 3, standardise: bool = True, max_rows: int = 3000) -> dict[str, DataFrame]:
    """Merges (ids from 0; a merge makes the next id), clusters at the cut into k, and the cophenetic correlation."""
    v = _bounded(numbers(df, *cols), max_rows)
    x = v.orderBy(*cols).toPandas().to_numpy(float)
    spark, n = df.sparkSession, len(x)
    kinds = {"merges": "step int, a int, b int, distance double, size int", "clusters": "row int, cluster int", "quality": "cophenetic double"}
    if n < 3:
        return {a: table(spark, [], b) for a, b in kinds.items()}
    if standardise:
        s = x.std(0, ddof=1)
        x = (x - x.mean(0)) / np.where(s > 0, s, 1)
    d = np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(2)))
    first = d.copy()
    squared = method in ("ward", "centroid", "median")
    d = d**2 if squared else d
    np.fill_diagonal(d, np.inf)
    ids, size, members, merges = list(range(n)), np.ones(n), {i: [i] for i in range(n)}, []
    coph = np.zeros((n, n))
    at = np.arange(n)
    for step in range(n - 1):
        i, j = divmod(int(d[np.ix_(at, at)].argmin()), len(at))
        i, j = sorted((at[i], at[j]))
        dist_ = d[i, j]
        a, b, si, sj = d[i], d[j], size[i], size[j]
        new = {"single": lambda: np.minimum(a, b), "complete": lambda: np.maximum(a, b), "average": lambda: (si * a + sj * b) / (si + sj), "centroid": lambda: (si * a + sj * b) / (si + sj) - si * sj * dist_ / (si + sj) ** 2, "median": lambda: (a + b) / 2 - dist_ / 4, "ward": lambda: ((si + size) * a + (sj + size) * b - size * dist_) / (si + sj + size)}[method]()
        height = math.sqrt(max(0.0, dist_)) if squared else float(dist_)
        mi, mj = members.pop(ids[i]), members.pop(ids[j])
        coph[np.ix_(mi, mj)] = coph[np.ix_(mj, mi)] = height
        merges.append((step + 1, ids[i], ids[j], height, len(mi) + len(mj)))
        ids[i], size[i] = n + step, si + sj
        members[n + step] = mi + mj
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        at = at[at != j]
    cut = {i: [i] for i in range(n)}
    for step, a, b, _, _ in merges[: n - k]:
        cut[n + step - 1] = cut.pop(a) + cut.pop(b)
    label = {r: c for c, rows in enumerate(sorted(cut.values(), key=min), 1) for r in rows}
    up = np.triu_indices(n, 1)
    c = float(np.corrcoef(first[up], coph[up])[0, 1])
    return {"merges": table(spark, merges, kinds["merges"]), "clusters": table(spark, sorted(label.items()), kinds["clusters"]), "quality": table(spark, [(c,)], kinds["quality"])}


#: Cluster features that the driver joins at most, and those that a task keeps where rows have more different values.
LEAVES, KEPT = 2000, 500


class Features:
    """Cluster features: sizes, sums and squares of standardised numbers, counts of categories. They add up."""

    def __init__(self, m: np.ndarray, s: np.ndarray, q: np.ndarray, c: np.ndarray):
        self.m, self.s, self.q, self.c = m, s, q, c

    def __getitem__(self, i) -> Features:
        return Features(self.m[i], self.s[i], self.q[i], self.c[i])

    def __add__(self, o: Features) -> Features:
        return Features(self.m + o.m, self.s + o.s, self.q + o.q, self.c + o.c)

    def xi(self) -> np.ndarray:
        """The log-likelihood of each: normal numbers about an error of variance 1, and categories by their shares."""
        m = self.m[..., None]
        p = self.c / m
        spread = np.maximum(0, self.q / m - (self.s / m) ** 2)
        return -self.m * (0.5 * np.log1p(spread).sum(-1) - np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum(-1))

    def joined(self, o: Features) -> Features:
        return Features(*(np.concatenate([getattr(self, k), getattr(o, k)]) for k in "msqc"))

    def table(self) -> np.ndarray:
        return np.column_stack([self.m, self.s, self.q, self.c])

    @staticmethod
    def of_table(t: np.ndarray, p: int) -> Features:
        return Features(t[:, 0], t[:, 1 : 1 + p], t[:, 1 + p : 1 + 2 * p], t[:, 1 + 2 * p :])


def shrink(f: Features, most: int) -> Features:
    """At most `most` features: in rounds, those that are each other's nearest join, the nearest pairs first."""
    while len(f.m) > most:
        n, own = len(f.m), f.xi()
        near, gap = np.zeros(n, np.int64), np.zeros(n)
        for a in range(0, n, 64):
            d = own[a : a + 64, None] + own[None] - (f[a : a + 64, None] + f[None]).xi()
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            near[a : a + 64], gap[a : a + 64] = d.argmin(1), d.min(1)
        i = np.flatnonzero((near[near] == np.arange(n)) & (np.arange(n) < near))
        if not len(i):  # ties in a ring: the nearest pair
            i = np.array([int(gap.argmin())])
        i = i[np.argsort(gap[i], kind="stable")][: n - most]
        j = near[i]
        both = f[i] + f[j]
        rest = np.setdiff1d(np.arange(n), np.concatenate([i, j]))
        f = both.joined(f[rest])
    return f


def _agglomerate(f: Features, most: int) -> dict[int, tuple[list[list[int]], float, Features]]:
    """Joins of the two nearest, first pair first, down to one: for each number of clusters up to `most` the members, the
    log-likelihood and the features."""
    n, own = len(f.m), f.xi()
    f = Features(f.m.copy(), f.s.copy(), f.q.copy(), f.c.copy())
    d, members, alive, saved = np.full((n, n), np.inf), [[i] for i in range(n)], np.ones(n, bool), {}
    for i in range(n - 1):
        d[i, i + 1 :] = own[i] + own[i + 1 :] - (f[i : i + 1] + f[i + 1 :]).xi()
    while True:
        k = int(alive.sum())
        at = np.flatnonzero(alive)
        if k <= most:
            saved[k] = ([members[i] for i in at], float(own[at].sum()), f[at])
        if k == 1:
            return saved
        i, j = divmod(int(d.argmin()), n)
        both = f[[i]] + f[[j]]
        f.m[i], f.s[i], f.q[i], f.c[i] = both.m[0], both.s[0], both.q[0], both.c[0]
        own[i], members[i], alive[j] = both.xi()[0], members[i] + members[j], False
        d[j, :] = d[:, j] = np.inf
        o = np.flatnonzero(alive)
        o = o[o != i]
        new = own[i] + own[o] - (f[[i]] + f[o]).xi()
        d[i, o[o > i]], d[o[o < i], i] = new[o > i], new[o < i]


def twostep(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], most: int = 12, leaves: int = LEAVES) -> dict[str, DataFrame]:
    """Clusters of numbers and categories by the log-likelihood distance; their number up to `most` by BIC. Any number of rows.

    First step: different rows are counted; if there are more than `leaves`, tasks gather them into cluster features, which
    are merged by a tree of tasks, at most KEPT of them at any place. Second step: features are joined, nearest first.
    Returns "clusters" (the complete rows with their cluster, largest first), and "bic" (with the mean Gower silhouette of
    the chosen number, from running sums of each number and counts of categories). With up to `leaves` different rows
    clusters are exact joins; with more, a row belongs to the cluster that its joining costs least."""
    v = numbers(df, *numeric, keep=tuple(categorical)).dropna()
    spark, p = df.sparkSession, len(numeric)
    k_num, k_cat = range(p), range(len(categorical))
    v = v.select(*(F.col(c).alias(f"x{i}") for i, c in enumerate(numeric)), *(F.col(c).alias(f"g{i}") for i, c in enumerate(categorical)))
    names = v.columns
    shown = [F.col(f"x{i}").alias(c) for i, c in enumerate(numeric)] + [F.col(f"g{i}").alias(c) for i, c in enumerate(categorical)]
    kinds = {"clusters": v.select(*shown).withColumn("cluster", F.lit(0)).where("cluster > 0"), "bic": table(spark, [], "k int, bic double, silhouette double")}
    s = v.agg(F.count(F.lit(1)).alias("n"), *(f(f"x{i}").alias(f"{n}{i}") for i in k_num for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max)))).collect()[0]
    if s.n < 6 or any(not s[f"s{i}"] for i in k_num):
        return kinds
    levels = [[r[0] for r in v.select(f"g{i}").distinct().orderBy(f"g{i}").collect()] for i in k_cat]  # a row per category
    mean, sd = np.array([s[f"m{i}"] for i in k_num]), np.array([s[f"s{i}"] for i in k_num])

    def features(frame: pd.DataFrame) -> Features:
        m = frame["n"].to_numpy(float)
        z = (frame[[f"x{i}" for i in k_num]].to_numpy(float) - mean) / sd if p else np.zeros((len(m), 0))
        hot = [np.equal.outer(frame[f"g{i}"].to_numpy(), np.array(levels[i], object)).astype(float) for i in k_cat]
        return Features(m, z * m[:, None], z * z * m[:, None], np.concatenate([np.zeros((len(m), 0)), *hot], 1) * m[:, None])

    rows = v.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    few = rows.limit(leaves + 1).count() <= leaves
    if few:
        frame = rows.orderBy(*names).toPandas()  # `leaves` at most
        f = features(frame)
    else:
        kept = min(leaves, KEPT)

        def gather(frames):
            held = None
            for frame in frames:
                for a in range(0, len(frame), kept):
                    new = features(frame.iloc[a : a + kept])
                    held = shrink(held.joined(new) if held else new, kept)
            if held:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "f": [held.table().tobytes()]})

        read = lambda b: np.frombuffer(b).reshape(-1, 1 + 2 * p + sum(map(len, levels)))

        def merge(frame: pd.DataFrame) -> pd.DataFrame:
            held = None
            for b in frame.sort_values("part")["f"]:
                new = Features.of_table(read(b), p)
                held = shrink(held.joined(new) if held else new, kept)
            return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // 8], "f": [held.table().tobytes()]})

        parts = settled(rows.mapInPandas(gather, "part int, f binary"))
        while (top := parts.agg(F.max("part")).collect()[0][0]) > 0:
            parts = settled(parts.groupBy(F.floor(F.col("part") / 8)).applyInPandas(merge, "part int, f binary"))
        f = Features.of_table(read(parts.collect()[0].f), p)  # one row of `kept` features
    saved = _agglomerate(f, most)
    free = 2 * p + sum(len(x) - 1 for x in levels)
    bic = {k: -2 * saved[k][1] + k * free * math.log(s.n) for k in sorted(saved)}
    best = min(bic, key=lambda k: (bic[k], k))
    members, _, found = saved[best]
    order = sorted(range(best), key=lambda c: (-found.m[c], min(members[c])))
    if few:
        label = np.zeros(len(frame), int)
        for number, c in enumerate(order):
            label[members[c]] = number + 1
        put = spark.createDataFrame(frame.drop(columns="n").assign(cluster=label), rows.drop("n").withColumn("cluster", F.lit(0)).schema)
        placed = v.join(F.broadcast(put), names)
    else:
        groups = found[order]

        def place(frames):
            own = groups.xi()
            for frame in frames:
                one = features(frame.assign(n=1))
                cost = np.stack([one.xi() + own[c] - (one + groups[[c]]).xi() for c in range(best)], 1)
                yield frame.assign(cluster=(cost.argmin(1) + 1).astype("int32"))

        placed = v.mapInPandas(place, ", ".join(f"{c} {t}" for c, t in v.dtypes) + ", cluster int")
    placed = settled(placed)
    silhouette = _silhouette(placed, [(f"x{i}", s[f"hi{i}"] - s[f"lo{i}"]) for i in k_num], [f"g{i}" for i in k_cat], best)
    out = [(k, float(b), silhouette if k == best else None) for k, b in bic.items()]
    return {"clusters": placed.select(*shown, "cluster"), "bic": table(spark, out, "k int, bic double, silhouette double")}


def _silhouette(rows: DataFrame, spans: Sequence[tuple[str, float]], categories: Sequence[str], k: int) -> float | None:
    """The mean silhouette by Gower's distance of all pairs, without pairs: a row's distances to a cluster add up, number by
    number, from the counts and sums of the smaller values, and category by category from the counts of others."""
    if k < 2:
        return None
    names = [c for c, _ in spans] + list(categories)
    each = rows.groupBy(*names, "cluster").agg(F.count(F.lit(1)).alias("_n"))
    size = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    ks = [c for c in range(1, k + 1) if size.get(c)]
    if len(ks) < 2:
        return None
    of = lambda c, x=1: F.sum(F.when(F.col("cluster") == c, F.col("_n") * x).otherwise(0))
    total = {c: F.lit(0.0) for c in ks}
    for j, (x, span) in enumerate(spans):
        values = each.groupBy(x).agg(*(of(c).alias(f"n{c}") for c in ks), *(of(c, F.col(x)).cast("double").alias(f"s{c}") for c in ks))
        run = running_sums(values, x, {f"l{c}": f"n{c}" for c in ks} | {f"t{c}": f"s{c}" for c in ks}, totals={f"a{c}": f"t{c}" for c in ks})
        far = [((F.col(x) * (2 * F.col(f"l{c}") - size[c]) - 2 * F.col(f"t{c}") + F.col(f"a{c}")) / span).alias(f"d{j}_{c}") for c in ks]
        each = each.join(run.select(x, *far), x)
        total = {c: t + F.col(f"d{j}_{c}") for c, t in total.items()}
    for j, g in enumerate(categories):
        counts = each.groupBy(g).agg(*(of(c).alias(f"e{j}_{c}") for c in ks))
        each = each.join(counts, g)
        total = {c: t + size[c] - F.col(f"e{j}_{c}") for c, t in total.items()}
    mean = {c: F.when(F.col("cluster") == c, None).otherwise(t / size[c]) for c, t in total.items()}
    a = F.coalesce(*(F.when(F.col("cluster") == c, t / max(1, size[c] - 1)) for c, t in total.items()))
    b = F.least(*mean.values()) if len(ks) > 1 else F.lit(None)
    alone = F.col("cluster").isin([c for c in ks if size[c] == 1])
    score = F.when(alone, 0.0).otherwise((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)))
    r = each.agg(F.sum(F.coalesce(score, F.lit(0.0)) * F.col("_n")).alias("s"), F.sum("_n").alias("n")).collect()[0]
    return float(r.s / r.n)


# classification


def discriminant(df: DataFrame, cols: Sequence[str], key: str, quadratic: bool = False) -> DataFrame:
    """The rows with the class of the highest LDA or QDA score: covariances over n (pooled for LDA), priors by size. The
    model is as wide as the variables and the classes, and becomes column expressions."""
    v = numbers(df, *cols, keep=(key,))
    p = len(cols)
    g = v.groupBy(F.col(key).alias("g")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).orderBy("g").collect()  # a row per class
    n = sum(r.n for r in g)
    if n < 6 or len(g) < 2 or min(r.n for r in g) < 2:
        return v.withColumn("predicted", F.lit(None).cast("string")).limit(0)
    cov = [np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) for r in g]
    pooled = sum(c * r.n for c, r in zip(cov, g)) / n
    best = None
    for r, c in zip(g, cov):
        s = c if quadratic else pooled
        inv = inverse(s)
        if inv is None:
            inv = np.linalg.pinv(s)
        m = [r[f"m{i}"] for i in range(p)]
        d = [F.col(x) - F.lit(float(a)) for x, a in zip(cols, m)]
        quad = sum((F.lit(float(inv[i, j])) * d[i] * d[j] for i in range(p) for j in range(p)), F.lit(0.0))
        score = F.lit(math.log(r.n / n) - (0.5 * np.linalg.slogdet(s)[1] if quadratic else 0.0)) - 0.5 * quad
        cell = F.struct(score.alias("s"), F.lit(r.g).alias("g"))
        best = cell if best is None else F.when(cell["s"] > best["s"], cell).otherwise(best)
    return v.withColumn("predicted", best["g"])


def knn(df: DataFrame, cols: Sequence[str], key: str, k: int = 5, leave_one_out: bool = True, max_rows: int | None = None) -> DataFrame:
    """The rows with the class of most of their k nearest; ties of distance go to the first in the order of the columns and the
    class, ties of votes to the class of the nearest. A row alone has no class.

    Points are compared once, however many rows share one: of a point's classes in their order no more than the first k + 1 can
    be asked for. Any number of rows, unless max_rows is given, which refuses more."""
    v = numbers(df, *cols, keep=(key,))
    v = v if max_rows is None else _bounded(v, max_rows)
    x, most = [f"x{i}" for i in range(len(cols))], k + bool(leave_one_out)
    v = v.toDF(*x, "y")
    each = v.groupBy(*x, "y").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.row_number().over(Window.partitionBy(*x).orderBy("y"))).where(F.col("at") <= most)
    first = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "y", F.least("n", F.lit(most)).cast("int").alias("n")))), lambda c: F.array_repeat(c["y"], c["n"])))
    points = stored(with_row(each.groupBy(*x).agg(F.slice(first, 1, most).alias("classes")), x))
    near = nearest(points.select(ROW, *x), x, most).select(ROW, F.posexplode("near").alias("at", "found"))
    classes = points.select(F.col(ROW).alias("r"), "classes")
    voters = near.join(classes, F.col("found.r") == F.col("r")).groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("at", (F.col("r") == F.col(ROW)).alias("own"), "classes"))).alias("voters"))
    own = F.array_position(F.col("classes"), F.col("y")).cast("int")
    rest = F.when(own > 0, F.concat(F.slice("classes", F.lit(1), own - 1), F.slice("classes", own + 1, F.lit(most)))).otherwise(F.col("classes")) if leave_one_out else F.col("classes")
    votes = F.slice(F.flatten(F.transform("voters", lambda p: F.when(p["own"], F.col("rest")).otherwise(p["classes"]))), 1, k)
    rows = v.join(points.join(voters, ROW), x).withColumn("rest", rest).withColumn("votes", votes)
    ranked = F.transform(F.array_distinct("votes"), lambda c, i: F.struct(F.size(F.filter("votes", lambda t: t == c)).alias("n"), (-i).alias("at"), c.alias("c")))
    return rows.select(*x, "y", F.array_max(ranked)["c"].alias("predicted")).toDF(*cols, key, "predicted")


def confusion(predicted: DataFrame, key: str) -> DataFrame:
    return predicted.groupBy(F.col(key).alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n"))
