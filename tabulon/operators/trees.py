"""Trees and ensembles: CART, random forest, boosting, CHAID, C4.5; and multiple imputation.

CART and boosting grow a level at a time over all rows. Forests see a table of bounded size (max_rows; more is refused, never
sampled) and grow trees in parallel tasks. CHAID and C4.5 need category counts only and read them from one aggregation per level of the tree."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import num, numbers, settled, text, table
from ..functions import dist
from .describe import points
from .levels import Data, grow_levels, leaves, walk
from .multivar import TooManyRows
from .nonparam import one_row


def _table(df: DataFrame, y: str, xs: Sequence[str], classify: bool, max_rows: int) -> tuple[np.ndarray, np.ndarray, list]:
    v = numbers(df, *xs, keep=(y,)) if classify else numbers(df, y, *xs)
    if v.limit(max_rows + 1).count() > max_rows:
        raise TooManyRows(f"{max_rows} rows at most")
    t = v.orderBy(*xs, y).toPandas()
    x = t[list(xs)].to_numpy(float)
    if not classify:
        return x, t[y].to_numpy(float), []
    levels = sorted(t[y].unique())
    return x, t[y].map({c: i for i, c in enumerate(levels)}).to_numpy(int), levels


def grow(x: np.ndarray, y: np.ndarray, classes: int, depth: int = 5, least: int = 5, weight: np.ndarray | None = None, tries: int | None = None, rng=None) -> dict:
    """A CART tree: Gini (classes > 0) or squares, thresholds at midpoints, the first best split; no pruning. Leaves have
    "value": class shares or a mean."""
    w = np.ones(len(y)) if weight is None else weight

    def leaf(i):
        if classes:
            c = np.bincount(y[i], w[i], classes)
            return {"value": (c / max(c.sum(), 1e-300)).tolist(), "n": int(len(i))}
        return {"value": float(np.average(y[i], weights=w[i])) if w[i].sum() > 0 else 0.0, "n": int(len(i))}

    def split(i):
        best = (1e-12, None, None)
        features = range(x.shape[1]) if tries is None else np.sort(rng.choice(x.shape[1], tries, replace=False))
        for f in features:
            order = i[np.argsort(x[i, f], kind="stable")]
            v = x[order, f]
            at = np.flatnonzero(v[1:] > v[:-1])
            if not len(at):
                continue
            if classes:
                c = np.zeros((len(order), classes))
                c[np.arange(len(order)), y[order]] = w[order]
                left = np.cumsum(c, 0)
                total = left[-1]
                left = left[at]
                right = total - left
                nl, nr = left.sum(1), right.sum(1)
                gain = (left**2).sum(1) / np.maximum(nl, 1e-300) + (right**2).sum(1) / np.maximum(nr, 1e-300) - (total**2).sum() / total.sum()
            else:
                s, m = np.cumsum(w[order] * y[order]), np.cumsum(w[order])
                nl, nr = m[at], m[-1] - m[at]
                gain = s[at] ** 2 / np.maximum(nl, 1e-300) + (s[-1] - s[at]) ** 2 / np.maximum(nr, 1e-300) - s[-1] ** 2 / m[-1]
            j = int(np.argmax(gain))
            if gain[j] > best[0] + 1e-12:
                best = (float(gain[j]), int(f), float((v[at[j]] + v[at[j] + 1]) / 2))
        return best

    def node(i, d):
        out = leaf(i)
        if d >= depth or len(i) < 2 * least or (classes and max(out["value"]) >= 1):
            return out
        gain, f, t = split(i)
        if f is None:
            return out
        go = x[i, f] <= t
        if min(go.sum(), (~go).sum()) < 1:
            return out
        return out | {"feature": f, "threshold": t, "gain": gain, "left": node(i[go], d + 1), "right": node(i[~go], d + 1)}

    return node(np.arange(len(y)), 0)


def apply_tree(tree: dict, x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(x), max(1, width)))

    def go(node, i):
        if "feature" not in node:
            out[i] = node["value"]
            return
        left = x[i, node["feature"]] <= node["threshold"]
        go(node["left"], i[left])
        go(node["right"], i[~left])

    go(tree, np.arange(len(x)))
    return out


def _rows(tree: dict, xs: Sequence[str], levels: list, path: str = "") -> list[tuple]:
    value = tree["value"]
    said = str(levels[int(np.argmax(value))]) if levels else f"{value:.6g}"
    out = [(path or "root", "feature" not in tree, said, tree["n"])]
    if "feature" in tree:
        name = xs[tree["feature"]]
        out += _rows(tree["left"], xs, levels, f"{path} & {name} <= {tree['threshold']:.6g}".lstrip(" &"))
        out += _rows(tree["right"], xs, levels, f"{path} & {name} > {tree['threshold']:.6g}".lstrip(" &"))
    return out


TREE = "path string, leaf boolean, prediction string, n long"
MAX_ROWS = 200_000


def _gains(tree: dict, total: np.ndarray) -> np.ndarray:
    if "feature" in tree:
        total[tree["feature"]] += tree["gain"]
        _gains(tree["left"], total)
        _gains(tree["right"], total)
    return total


def cart(df: DataFrame, y: str, xs: Sequence[str], classify: bool = True, depth: int = 5, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """The tree's nodes, and its confusion table (classes) or R2. Any number of rows: each level is one aggregation."""
    data, spark = Data(df, y, xs, classify), df.sparkSession
    if data.n < 2:
        return one_row(df, TREE), one_row(df, "actual string, predicted string, n long")
    tree = grow_levels(data, depth, least)
    nodes = table(spark, _rows(tree, xs, data.levels), TREE)
    if not classify:
        squares = data.squares - sum(n["weight"] * (n["value"] - data.mean) ** 2 for n in leaves(tree))
        return nodes, one_row(df, "r2 double, sse double, n long", 1 - squares / data.squares if data.squares else None, max(0.0, squares), data.n)
    said = walk(tree, lambda n: F.lit(int(np.argmax(n["value"]))))
    pairs = data.rows.groupBy("_y", said.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("_y", "p").collect()  # classes by classes
    return nodes, table(spark, [(str(data.levels[r["_y"]]), str(data.levels[r.p]), r.n) for r in pairs], "actual string, predicted string, n long")


def root_split(df: DataFrame, y: str, xs: Sequence[str], classify: bool = True) -> DataFrame:
    """The first split of a tree: its variable, threshold, and decrease of impurity."""
    data = Data(df, y, xs, classify)
    tree = grow_levels(data, 1, 1) if data.n > 1 else {}
    rows = [(xs[tree["feature"]], tree["threshold"], tree["gain"])] if "feature" in tree else []
    return table(df.sparkSession, rows, "variable string, threshold double, gain double")


def random_forest(df: DataFrame, y: str, xs: Sequence[str], classify: bool = True, trees: int = 200, depth: int = 20, least: int = 1, seed: int = 42, max_rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """Out-of-bag error, and permutation importance of the forest (five permutations, out of bag). Trees are grown in
    parallel over a broadcast table of at most max_rows rows; up to 2,000 trees."""
    x, t, levels = _table(df, y, xs, classify, max_rows)
    spark, k, p, n = df.sparkSession, len(levels), len(xs), len(t)
    kinds = ("trees int, oob_error double, n long", "variable string, importance double")
    if n < 10 or not 1 <= trees <= 2000:
        return one_row(df, kinds[0]), one_row(df, kinds[1])
    tries = max(1, int(math.sqrt(p)) if classify else p // 3)
    data = spark.sparkContext.broadcast((x, t))
    width = max(1, k)

    def run(frames):
        xx, tt = data.value
        sums, seen, hurt, used = np.zeros((len(tt), width)), np.zeros(len(tt)), np.zeros(p), 0
        for f in frames:
            for i in f["id"]:
                rng = np.random.default_rng([seed, int(i)])
                bag = rng.integers(0, len(tt), len(tt))
                tree = grow(xx[bag], tt[bag], k, depth, least, tries=tries, rng=rng)
                out = np.setdiff1d(np.arange(len(tt)), bag)
                if not len(out):
                    continue
                got = apply_tree(tree, xx[out], k)
                sums[out] += got
                seen[out] += 1
                err = lambda g: float((g.argmax(1) != tt[out]).mean() if k else ((g[:, 0] - tt[out]) ** 2).mean())  # noqa: E731, B023
                base = err(got)
                for j in range(p):
                    for _ in range(5):
                        z = xx[out].copy()
                        z[:, j] = rng.permutation(z[:, j])
                        hurt[j] += (err(apply_tree(tree, z, k)) - base) / 5
                used += 1
        yield pd.DataFrame({"sums": [sums.tobytes()], "seen": [seen.tobytes()], "hurt": [hurt.tolist()], "used": [used]})

    parts = spark.range(0, trees, 1, min(trees, 32)).mapInPandas(run, "sums binary, seen binary, hurt array<double>, used int").toPandas()  # a row per task, as long as the table
    sums, seen = sum(np.frombuffer(b) for b in parts["sums"]).reshape(n, width), sum(np.frombuffer(b) for b in parts["seen"])
    ok = seen > 0
    vote = sums[ok] / seen[ok, None]
    error = float((vote.argmax(1) != t[ok]).mean() if k else ((vote[:, 0] - t[ok]) ** 2).mean())
    hurt = np.sum(parts["hurt"].tolist(), 0) / max(1, parts["used"].sum())
    return one_row(df, kinds[0], trees, error, n), table(spark, [(c, float(h)) for c, h in zip(xs, hurt)], kinds[1])


#: Rounds of boosting after which what rows have gathered is put down, so that expressions stay short.
ROUNDS = 10


def boosting(df: DataFrame, y: str, xs: Sequence[str], classify: bool = False, rounds: int = 100, rate: float = 0.1, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Least-squares gradient boosting, or AdaBoost (SAMME): the trace of rounds and the features' gains, up to 2,000 rounds.

    Trees grow a level at a time over all rows, which keep what the rounds before left them: a residual, or a weight and
    votes. Losses follow from the sums of the leaves."""
    data, spark, gain, trace = Data(df, y, xs, classify), df.sparkSession, np.zeros(len(xs)), []
    k = data.classes
    kinds = ("round int, error double, loss double", "variable string, importance double")
    if data.n < 4 or not 1 <= rounds <= 2000 or (classify and k < 2):
        return one_row(df, kinds[0]), one_row(df, kinds[1])
    data.mean = 0.0  # rows are about the mean already, which is the first prediction
    votes = [f"_v{c}" for c in range(k)]
    rows = settled(data.rows.withColumns({v: F.lit(0.0) for v in votes} | ({"_w": F.lit(1.0 / data.n)} if classify else {})))
    squares = data.squares
    for r in range(rounds):
        tree = grow_levels(data, depth, 1, rows)
        last = leaves(tree)
        if classify:
            e = sum(n["weight"] * (1 - max(n["value"])) for n in last) / sum(n["weight"] for n in last)
            if e >= 1 - 1 / k:
                break
            a = math.log((1 - max(e, 1e-12)) / max(e, 1e-12)) + math.log(k - 1)
            said = walk(tree, lambda n: F.lit(int(np.argmax(n["value"]))))
            whole = sum(n["weight"] for n in last) * (1 - e + e * math.exp(a))
            rows = rows.withColumn("_p", said).withColumns({v: F.col(v) + F.when(F.col("_p") == c, a).otherwise(0.0) for c, v in enumerate(votes)} | {"_w": F.col("_w") * F.when(F.col("_p") != F.col("_y"), math.exp(a)).otherwise(1.0) / whole}).drop("_p")
            top = F.greatest(*votes)
            first = F.coalesce(*(F.when(F.col(v) == top, c) for c, v in enumerate(votes)))
            wrong = rows.agg(F.avg((first != F.col("_y")).cast("double"))).collect()[0][0]
            trace.append((r + 1, float(wrong), e))
        else:
            rows = rows.withColumn("_y", F.col("_y") - rate * walk(tree, lambda n: F.lit(float(n["value"]))))
            squares -= sum(n["weight"] * n["value"] ** 2 for n in last) * (2 * rate - rate * rate)
            trace.append((r + 1, max(0.0, float(squares)), float(1 - squares / data.squares) if data.squares else None))
        _gains(tree, gain)
        if classify and e < 1e-12:
            break
        if r % ROUNDS == ROUNDS - 1:
            rows = settled(rows)
    total = gain.sum() or 1.0
    return table(spark, trace, kinds[0]), table(spark, [(c, float(g / total)) for c, g in zip(xs, gain)], kinds[1])


# trees of categories, by counts


def _binned(df: DataFrame, y: str, xs: Sequence[str], bins: int = 10) -> DataFrame:
    """Classes and categories as text; numbers become ten bins of equal size by their quantiles. Complete rows."""
    kinds = dict(df.dtypes)
    cols = [text(F.col(y)).alias("_y")]
    for x in xs:
        if kinds[x] == "string":
            cols.append(text(F.col(x)).alias(x))
        else:
            v = num(df, x)
            q = sorted({c for c in points(df.select(v.alias("v")), "v", [i / bins for i in range(1, bins)]) if c is not None})
            code = sum((F.when(v > c, 1).otherwise(0) for c in q), F.lit(0))
            cols.append(F.when(v.isNotNull(), F.format_string("%02d", code)).alias(x))
    return df.select(*cols).dropna()


def _level_counts(rows: DataFrame, nodes: dict, xs: Sequence[str]) -> dict:
    """Counts of (node, feature, category, class) of all open nodes, in one aggregation. A node is a list of (feature, categories)."""
    at = F.lit(None).cast("int")
    for i, path in nodes.items():
        ok = F.lit(True)
        for x, cats in path:
            ok = ok & F.col(x).isin(cats)
        at = F.when(ok, i).otherwise(at)
    long = rows.withColumn("_n", at).where("_n IS NOT NULL").unpivot(["_n", "_y"], list(xs), "x", "c")
    out: dict = {}
    for r in long.groupBy("_n", "x", "c", "_y").agg(F.count(F.lit(1)).alias("k")).collect():  # categories by classes
        out.setdefault(r["_n"], {}).setdefault(r["x"], {}).setdefault(r["c"], {})[r["_y"]] = r["k"]
    return out


def _chi(tables: list[dict], classes: Sequence[str]) -> tuple[float, float]:
    m = np.array([[t.get(c, 0) for c in classes] for t in tables], float)
    m = m[m.sum(1) > 0][:, m.sum(0) > 0]
    if min(m.shape, default=0) < 2:
        return 0.0, 1.0
    e = np.outer(m.sum(1), m.sum(0)) / m.sum()
    chi = float(((m - e) ** 2 / e).sum())
    return chi, dist.chi2_upper(chi, (m.shape[0] - 1) * (m.shape[1] - 1))


def _add(tables: Sequence[dict]) -> dict:
    out: dict = {}
    for t in tables:
        for c, n in t.items():
            out[c] = out.get(c, 0) + n
    return out


def _chaid_split(counts: dict, classes: Sequence[str], ordered: set[str], alpha: float):
    """The predictor of the smallest Bonferroni-adjusted p, with its merged categories; None if none reaches alpha."""
    best = None
    for x in sorted(counts):
        groups = [[c] for c in sorted(counts[x])]
        first = len(groups)
        while len(groups) > 1:
            pairs = [(i, i + 1) for i in range(len(groups) - 1)] if x in ordered else [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
            p, i, j = max(((_chi([_add([counts[x][c] for c in groups[i]]), _add([counts[x][c] for c in groups[j]])], classes)[1], -i, -j) for i, j in pairs))
            if p <= alpha:
                break
            groups[-i] = groups[-i] + groups.pop(-j)
        if len(groups) < 2:
            continue
        chi, p = _chi([_add([counts[x][c] for c in g]) for g in groups], classes)
        k = len(groups)
        times = math.comb(first - 1, k - 1) if x in ordered else sum((-1) ** i * (k - i) ** first / (math.factorial(i) * math.factorial(k - i)) for i in range(k)) if first <= 60 else 1e9
        p = min(1.0, p * max(1.0, times))
        if p <= alpha and (best is None or p < best[0] - 1e-300):
            best = (p, x, groups, chi)
    return best


def _entropy(t: dict) -> float:
    n = sum(t.values())
    return -sum(v / n * math.log2(v / n) for v in t.values() if v) if n else 0.0


def _gain_ratio_split(counts: dict):
    """The categories of the predictor of the best gain ratio among those with at least the average gain."""
    found = []
    for x in sorted(counts):
        cats = sorted(counts[x])
        if len(cats) < 2:
            continue
        total = _add([counts[x][c] for c in cats])
        n = sum(total.values())
        size = {c: sum(counts[x][c].values()) for c in cats}
        gain = _entropy(total) - sum(size[c] / n * _entropy(counts[x][c]) for c in cats)
        info = _entropy(size)
        if gain > 1e-12 and info > 0:
            found.append((gain, gain / info, x, [[c] for c in cats]))
    if not found:
        return None
    mean = sum(f[0] for f in found) / len(found)
    g = max((f for f in found if f[0] >= mean - 1e-12), key=lambda f: (f[1], [-ord(c) for c in f[2]]))
    return g[1], g[2], g[3], g[0]


def _category_tree(df: DataFrame, y: str, xs: Sequence[str], choose, depth: int, least: int) -> list[dict]:
    rows = _binned(df, y, xs).cache()
    nodes: list[dict] = [{"path": [], "children": []}]
    open_ = {0: []}
    for level in range(depth + 1):
        if not open_:
            break
        counts, nxt = _level_counts(rows, open_, xs), {}
        for i in open_:
            node, c = nodes[i], counts.get(i, {})
            node["counts"] = _add(list(next(iter(c.values())).values())) if c else {}
            n = sum(node["counts"].values())
            if level == depth or n < 2 * least or len(node["counts"]) < 2:
                continue
            best = choose(c, sorted(node["counts"]))
            if best is None or sum(sum(_add([c[best[1]][v] for v in g]).values()) >= least for g in best[2]) < 2:
                continue
            node["split"] = (best[1], float(best[0]), float(best[3]))
            for g in best[2]:
                nodes.append({"path": [*node["path"], (best[1], g)], "children": []})
                node["children"].append(len(nodes) - 1)
                nxt[len(nodes) - 1] = nodes[-1]["path"]
        open_ = nxt
    rows.unpersist()
    return nodes


def _category_rows(nodes: list[dict], i: int = 0) -> list[tuple]:
    node = nodes[i]
    c = node.get("counts") or {}
    said = min(c, key=lambda k: (-c[k], k)) if c else None
    path = " & ".join(f"{x} in {{{', '.join(g)}}}" for x, g in node["path"]) or "root"
    out = [(path, not node["children"], said, sum(c.values()), json.dumps(c, sort_keys=True))]
    for j in node["children"]:
        out += _category_rows(nodes, j)
    return out


CATEGORY_TREE = "path string, leaf boolean, prediction string, n long, counts string"


def chaid(df: DataFrame, y: str, xs: Sequence[str], alpha: float = 0.05, depth: int = 3, least: int = 30) -> DataFrame:
    """Categories are merged while their chi-square p exceeds alpha (ordered ones with neighbours only)."""
    kinds = dict(df.dtypes)
    ordered = {x for x in xs if kinds[x] != "string"}
    nodes = _category_tree(df, y, xs, lambda c, k: _chaid_split(c, k, ordered, alpha), depth, least)
    return table(df.sparkSession, _category_rows(nodes), CATEGORY_TREE)


def _upper_error(n: float, e: float, cf: float = 0.25) -> float:
    """C4.5's pessimistic number of errors of a leaf."""
    if n <= 0:
        return 0.0
    if e < 1e-9:
        return n * (1 - cf ** (1 / n))
    z = dist.norm_inv(1 - cf)
    f = (e + 0.5) / n
    if f >= 1:
        return n
    return n * min(1.0, (f + z * z / (2 * n) + z * math.sqrt(max(0.0, f / n - f * f / n + z * z / (4 * n * n)))) / (1 + z * z / n))


def c45(df: DataFrame, y: str, xs: Sequence[str], depth: int = 6, least: int = 2, cf: float = 0.25) -> DataFrame:
    """Gain ratio splits, then pessimistic pruning from the leaves up."""
    nodes = _category_tree(df, y, xs, lambda c, _: _gain_ratio_split(c), depth, least)

    def prune(i: int) -> float:
        node = nodes[i]
        c = node.get("counts") or {}
        n = sum(c.values())
        own = _upper_error(n, n - max(c.values(), default=0), cf)
        if not node["children"]:
            return own
        below = sum(prune(j) for j in node["children"])
        if own <= below + 0.1:
            node["children"] = []
            return own
        return below

    prune(0)
    return table(df.sparkSession, _category_rows(nodes), CATEGORY_TREE)


def impute(df: DataFrame, cols: Sequence[str], m: int = 5, cycles: int = 10, seed: int = 42, max_rows: int = MAX_ROWS) -> DataFrame:
    """Multiple imputation by chained equations: m completed tables (column _m), one task each, over a bounded table.
    Columns of the values 0 and 1 by a logistic draw, others by a Bayesian linear one."""
    v = numbers(df, *cols, listwise=False).withColumn("_h", F.xxhash64(*cols))
    if v.limit(max_rows + 1).count() > max_rows:
        raise TooManyRows(f"{max_rows} rows at most")
    names = list(cols)
    each = v.crossJoin(F.broadcast(df.sparkSession.range(m).select(F.col("id").cast("int").alias("_m"))))  # m copies

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["_h", *names])
        rng = np.random.default_rng([seed, int(f["_m"].iloc[0])])
        x = f[names].to_numpy(float)
        miss = np.isnan(x)
        for j in range(len(names)):
            seen = x[~miss[:, j], j]
            x[miss[:, j], j] = rng.choice(seen, miss[:, j].sum()) if len(seen) else 0.0
        for _ in range(cycles):
            for j in range(len(names)):
                gone = miss[:, j]
                if not gone.any() or gone.all():
                    continue
                a = np.column_stack([np.ones(len(x)), np.delete(x, j, 1)])
                xo, yo = a[~gone], x[~gone, j]
                k = a.shape[1]
                if set(np.unique(yo)) <= {0.0, 1.0}:
                    b = np.zeros(k)
                    for _ in range(25):
                        p = 1 / (1 + np.exp(-np.clip(xo @ b, -30, 30)))
                        h = xo.T @ (xo * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(k)
                        step = np.linalg.solve(h, xo.T @ (yo - p))
                        b += step
                        if np.abs(step).max() < 1e-8:
                            break
                    b = rng.multivariate_normal(b, np.linalg.inv(h))
                    x[gone, j] = rng.random(gone.sum()) < 1 / (1 + np.exp(-np.clip(a[gone] @ b, -30, 30)))
                else:
                    inv = np.linalg.pinv(xo.T @ xo + 1e-8 * np.eye(k))
                    b = inv @ (xo.T @ yo)
                    s2 = ((yo - xo @ b) ** 2).sum() / rng.chisquare(max(1, len(yo) - k))
                    b = rng.multivariate_normal(b, inv * s2)
                    x[gone, j] = a[gone] @ b + rng.standard_normal(gone.sum()) * math.sqrt(s2)
        return pd.DataFrame(x, columns=names).assign(_m=f["_m"].to_numpy())

    return each.groupBy("_m").applyInPandas(run, ", ".join(f"`{c}` double" for c in names) + ", _m int")


def pool(completed: DataFrame, col: str) -> DataFrame:
    """Rubin's rules for a mean over the completed tables: estimate, error, degrees of freedom, missing information."""
    r = completed.groupBy("_m").agg(F.avg(col).alias("q"), (F.var_samp(col) / F.count(col)).alias("u")).collect()  # a row per table
    q, u, m = np.array([x.q for x in r]), np.array([x.u for x in r]), len(r)
    b = float(q.var(ddof=1)) if m > 1 else 0.0
    t = float(u.mean()) + (1 + 1 / m) * b
    lam = (1 + 1 / m) * b / t if t else 0.0
    d = (m - 1) / lam**2 if lam > 0 else math.inf
    return one_row(completed, "estimate double, se double, df double, missing_information double, m int", float(q.mean()), math.sqrt(t), d, lam, m)
