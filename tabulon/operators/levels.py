"""Trees grown a level at a time from sums per (node, variable, value): exact splits at every distinct value, whatever the table's size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import numbers
from .running import running_sums

#: Sums of one level that the driver takes at most. More are searched on the cluster, with the same result.
TAKEN = 1 << 18
LEAST_GAIN = 1e-12


class Data:
    """Complete rows: variables x0, x1, ..., the target _y (a number, or the place of its class) and a weight _w."""

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str], classify: bool):
        names = [F.col(c).alias(f"x{i}") for i, c in enumerate(xs)]
        v = numbers(df, *xs, keep=(y,)) if classify else numbers(df, y, *xs)
        self.p, self.levels = len(xs), []
        if classify:
            self.levels = sorted(r[0] for r in v.select(y).distinct().collect())  # a row per class
            place = F.create_map(*(F.lit(x) for pair in ((c, i) for i, c in enumerate(self.levels)) for x in pair)) if self.levels else None
            target = place[F.col(y)] if self.levels else F.lit(None).cast("int")
        else:
            target = F.col(y)
        self.rows = v.select(*names, target.alias("_y"), F.lit(1.0).alias("_w"))
        s = self.rows.agg(F.count(F.lit(1)).alias("n"), *([] if classify else [F.avg("_y").alias("m"), (F.var_pop("_y") * F.count("_y")).alias("s")]), *(F.approx_count_distinct(f"x{i}").alias(f"d{i}") for i in range(self.p))).collect()[0]
        self.n, self.mean, self.squares = s.n, 0.0 if classify else s.m or 0.0, None if classify else s.s or 0.0
        if not classify:
            self.rows = self.rows.withColumn("_y", F.col("_y") - self.mean)  # sums of squares stay exact
        self.distinct = sum(1.2 * s[f"d{i}"] + 10 for i in range(self.p))

    @property
    def classes(self) -> int:
        return len(self.levels)


def walk(tree: dict, leaf: Callable[[dict], Column]) -> Column:
    """What `leaf` says of the node in which a row ends."""
    if "feature" not in tree:
        return leaf(tree)
    return F.when(F.col(f"x{tree['feature']}") <= tree["threshold"], walk(tree["left"], leaf)).otherwise(walk(tree["right"], leaf))


def _sums(rows: DataFrame, at: Column, keys: Sequence[Column], classes: int) -> DataFrame:
    """Per open node and key: rows k, weight w and weighted target s (of each class c apart, where there are classes)."""
    by = ["node", *keys] + (["c"] if classes else [])
    placed = rows.withColumn("node", at).where("node IS NOT NULL").withColumn("c", F.col("_y").cast("int"))
    if keys:
        p = sum(c.startswith("x") and c[1:].isdigit() for c in rows.columns)
        placed = placed.select("node", "c", "_y", "_w", F.inline(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(p)))))
    return placed.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("s"))


def _totals(part, classes: int) -> np.ndarray:
    """Of rows of _sums() with one key: weights of the classes, or the weight and the weighted sum; last the number of rows."""
    if classes:
        return np.append(np.bincount(part[:, 0].astype(int), part[:, 2], classes), part[:, 1].sum())
    return np.array([part[:, 2].sum(), part[:, 3].sum(), part[:, 1].sum()])


def _gain(left: np.ndarray, total: np.ndarray, classes: int) -> np.ndarray:
    """The decrease of impurity times weight: of Gini's index, or of squares about the mean."""
    right = total - left
    if classes:
        parts = [(x[..., :-1], x[..., :-1].sum(-1)) for x in (left, right, total)]
        g = [np.where(n > 0, (c**2).sum(-1) / np.maximum(n, 1e-300), 0.0) for c, n in parts]
    else:
        g = [np.where(x[..., 0] > 0, x[..., 1] ** 2 / np.maximum(x[..., 0], 1e-300), 0.0) for x in (left, right, total)]
    return g[0] + g[1] - g[2]


def _split_here(got: list, classes: int) -> dict[int, tuple]:
    """Per node the first best split: gain, variable, threshold, and the totals left of it."""
    a = np.array([(r.node, r.f, r.v, r.c if classes else 0, r.k, r.w, r.s) for r in got], float).reshape(-1, 7)
    a = a[np.lexsort((a[:, 3], a[:, 2], a[:, 1], a[:, 0]))]
    out: dict[int, tuple] = {}
    edge = np.flatnonzero(np.append(True, (a[1:, :2] != a[:-1, :2]).any(1))) if len(a) else []
    for i, j in zip(edge, np.append(edge[1:], len(a)) if len(a) else []):
        part = a[i:j]
        node, f = int(part[0, 0]), int(part[0, 1])
        values, at = np.unique(part[:, 2], return_inverse=True)
        if len(values) < 2:
            continue
        sums = np.zeros((len(values), (classes or 2) + 1))
        if classes:
            np.add.at(sums, (at, part[:, 3].astype(int)), part[:, 5])
        else:
            sums[:, 0], sums[:, 1] = np.bincount(at, part[:, 5]), np.bincount(at, part[:, 6])
        sums[:, -1] = np.bincount(at, part[:, 4])
        left = np.cumsum(sums, 0)
        gain = _gain(left[:-1], left[-1], classes)
        best = int(np.argmax(gain))
        if gain[best] > max(LEAST_GAIN, out[node][0] if node in out else 0.0) + LEAST_GAIN:
            out[node] = (float(gain[best]), f, float((values[best] + values[best + 1]) / 2), left[best])
    return out


def _split_there(sums: DataFrame, classes: int) -> dict[int, tuple]:
    """As _split_here(), on the cluster, by running sums over each node's values of a variable; a row per node comes back. What a
    class adds to the left side's sum of squares follows from the class's own running sum, so absent classes need no row."""
    key = ["node", "f"]
    if classes:
        own = running_sums(sums.select(*key, "v", "c", "k", "w"), "v", {"l": "w"}, [*key, "c"], totals={"t": "l"})
        before = F.col("l") - F.col("w")
        per = own.groupBy(*key, "v").agg(F.sum("k").alias("k"), F.sum("w").alias("w"), F.sum(2 * before * F.col("w") + F.col("w") * F.col("w")).alias("q"), F.sum(F.col("t") * F.col("w")).alias("tw"))
        run = running_sums(per, "v", {"lk": "k", "lw": "w", "lq": "q", "lt": "tw"}, key, totals={"nk": "lk", "nw": "lw", "tt": "lt"})
        right_q = F.col("tt") - 2 * F.col("lt") + F.col("lq")
        gain = F.col("lq") / F.col("lw") + right_q / (F.col("nw") - F.col("lw")) - F.col("tt") / F.col("nw")
    else:
        run = running_sums(sums, "v", {"lk": "k", "lw": "w", "ls": "s"}, key, totals={"nk": "lk", "nw": "lw", "ns": "ls"})
        gain = F.col("ls") * F.col("ls") / F.col("lw") + F.pow(F.col("ns") - F.col("ls"), 2) / (F.col("nw") - F.col("lw")) - F.col("ns") * F.col("ns") / F.col("nw")
    inner = run.where((F.col("lk") < F.col("nk")) & (F.col("lw") > 0) & (F.col("lw") < F.col("nw")))
    best = inner.select("node", F.struct(gain.alias("g"), (-F.col("f")).alias("f"), (-F.col("v")).alias("v")).alias("b")).groupBy("node").agg(F.max("b").alias("b")).select("node", F.col("b.g").alias("g"), (-F.col("b.f")).alias("f"), (-F.col("b.v")).alias("v")).where(F.col("g") > 2 * LEAST_GAIN)
    next_ = sums.select("node", "f", F.col("v").alias("u")).join(best, ["node", "f"]).where("u > v").groupBy("node", "f", "v", "g").agg(F.min("u").alias("u"))
    return {r.node: (r.g, r.f, (r.v + r.u) / 2, None) for r in next_.collect()}


def grow_levels(data: Data, depth: int, least: int, rows: DataFrame | None = None, taken: int = TAKEN) -> dict:
    """A tree as trees.grow() makes it: thresholds at midpoints of neighbouring values, the first best split (by variable, then by
    threshold), no pruning. Each level reads the rows once. Its expression has a branch a node, so `depth` bounds it."""
    rows, classes = data.rows if rows is None else rows, data.classes
    root: dict = {}
    fresh: dict[int, dict] = {0: root}
    for d in range(depth + 1):
        ids = {id(node): i for i, node in fresh.items()}
        if not fresh:
            break
        at = walk(root, lambda n: F.lit(ids.get(id(n))).cast("int"))
        if any("_t" not in n for n in fresh.values()):
            got: dict[int, list] = {}
            for r in _sums(rows, at, [], classes).collect():  # a row per node and class
                got.setdefault(r.node, []).append((r.c if classes else 0, r.k, r.w, r.s))
            for i, n in fresh.items():
                n["_t"] = _totals(np.array(got[i], float), classes) if i in got else np.zeros((classes or 2) + 1)
        open_: dict[int, dict] = {}
        for i, n in fresh.items():
            t = n["_t"]
            n["n"] = int(t[-1])
            whole = t[:-1].sum() if classes else t[0]
            n["value"] = (t[:-1] / max(whole, 1e-300)).tolist() if classes else float(t[1] / t[0] + data.mean) if t[0] > 0 else data.mean
            n["weight"] = float(whole)
            if d < depth and n["n"] >= 2 * least and not (classes and max(n["value"]) >= 1):
                open_[i] = n
        if not open_:
            break
        ids = {id(n): i for i, n in open_.items()}
        sums = _sums(rows, walk(root, lambda n: F.lit(ids.get(id(n))).cast("int")), [F.col("f"), F.col("v")], classes)
        near = min(len(open_) * data.distinct, data.n * data.p) * max(1, classes) <= taken
        found = _split_here(sums.collect(), classes) if near else _split_there(sums, classes)
        fresh = {}
        for j, (i, (gain, f, threshold, left)) in enumerate(sorted(found.items())):
            n = open_[i]
            n |= {"feature": f, "threshold": threshold, "gain": gain, "left": {}, "right": {}}
            if left is not None:
                n["left"]["_t"], n["right"]["_t"] = left, n["_t"] - left
            fresh[2 * j], fresh[2 * j + 1] = n["left"], n["right"]
    return _clean(root)


def _clean(node: dict) -> dict:
    node.pop("_t", None)
    for side in ("left", "right"):
        if side in node:
            _clean(node[side])
    return node


def leaves(tree: dict) -> list[dict]:
    return [tree] if "feature" not in tree else leaves(tree["left"]) + leaves(tree["right"])
