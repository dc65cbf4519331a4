"""The nearest points of every point, exactly and without all pairs: those of its own cell first, then those of the other cells
that lie within the distance found.

Distances are sums of squares in the order of the columns, and those to boxes are computed alike, so that a box never seems
farther than a point in it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ROW, stored

#: Points of a cell, about; points by which cells are cut, about; points that ask a cell in one task, about; distances in memory.
CELL, CUTS, ASKED, PAIRS = 2048, 1 << 16, 8192, 1 << 21


def _squares(parts: Iterator[np.ndarray]) -> np.ndarray:
    total = 0.0
    with np.errstate(over="ignore"):
        for x in parts:
            total = total + x * x
    return total


class Cells:
    """Space halved at medians of some points, `depth` times: node i has the nodes 2 i + 1 (up to the cut) and 2 i + 2 under it.
    Which points the cuts come from decides how even cells are and nothing else."""

    def __init__(self, some: np.ndarray, depth: int):
        self.axis, self.cut = np.full((2 << depth) - 1, -1), np.zeros((2 << depth) - 1)
        parts = {0: some}
        for node in range((1 << depth) - 1):
            x = parts.pop(node, some[:0])
            if len(x) < 2:
                continue
            with np.errstate(over="ignore"):
                axis = int(np.argmax(x.max(0) - x.min(0)))
            values = np.sort(x[:, axis])
            cut = values[(len(values) - 1) // 2]
            if cut == values[-1]:  # nothing would be behind it
                if cut == values[0]:
                    continue
                cut = values[np.searchsorted(values, cut) - 1]
            self.axis[node], self.cut[node] = axis, cut
            parts[2 * node + 1], parts[2 * node + 2] = x[x[:, axis] <= cut], x[x[:, axis] > cut]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell (a node without cut) of each point."""
        node = np.zeros(len(x), np.int64)
        while len(at := np.flatnonzero(self.axis[node] >= 0)):
            here = node[at]
            node[at] = 2 * here + 1 + (x[at, self.axis[here]] > self.cut[here])
        return node

    def bound(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """The boxes of all nodes, from those of the cells that have points."""
        self.low, self.high = np.full((len(self.axis), low.shape[1]), np.inf), np.full((len(self.axis), low.shape[1]), -np.inf)
        self.low[cell], self.high[cell] = low, high
        self.some = np.zeros(len(self.axis), bool)
        self.some[cell] = True
        for node in range(len(self.axis) - 1, 0, -1):
            up = (node - 1) // 2
            self.low[up], self.high[up] = np.minimum(self.low[up], self.low[node]), np.maximum(self.high[up], self.high[node])
            self.some[up] |= self.some[node]

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for the cells whose box is at most `reach`, a squared distance, from a point."""
        out, todo = [], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not self.some[node]:
                continue
            gap = _squares(np.maximum(np.maximum(self.low[node, j] - x[at, j], x[at, j] - self.high[node, j]), 0.0) for j in range(x.shape[1]))
            at = at[gap <= reach[at]]
            if not len(at):
                continue
            if self.axis[node] >= 0:
                todo += [(2 * node + 1, at), (2 * node + 2, at)]
            else:
                out.append((at, np.full(len(at), node)))
        return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _first(x: np.ndarray, points: np.ndarray, rows: np.ndarray, m: int, reach: np.ndarray | None = None) -> tuple[list, list]:
    """For each x, the squared distances and the rows of its first m points (by distance, then row) within reach. rows ascend."""
    far, near = [], []
    step = max(1, PAIRS // max(1, len(points)))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        d = _squares(part[:, j][:, None] - points[:, j][None] for j in range(points.shape[1]))
        most = np.partition(d, m - 1, axis=1)[:, m - 1] if d.shape[1] > m else np.full(len(d), np.inf)
        if reach is not None:
            most = np.minimum(most, reach[a : a + step])
        at, col = np.nonzero(d <= most[:, None])
        value = d[at, col]
        order = np.lexsort((col, value, at))
        at, col, value = at[order], col[order], value[order]
        begin = np.searchsorted(at, np.arange(len(part) + 1))
        stay = np.arange(len(at)) - begin[at] < m
        at, col, value = at[stay], col[stay], value[stay]
        cuts = np.searchsorted(at, np.arange(1, len(part)))
        far += np.split(value, cuts)
        near += np.split(rows[col], cuts)
    return far, near


def nearest(points: DataFrame, cols: Sequence[str], m: int) -> DataFrame:
    """(_rid, near): of each point, itself included, the m nearest as an array of (d, r): squared distance and row, in this order.

    points: _rid, which decides between equal distances, and the columns, numbers without nulls; no two points should be equal
    (equal ones can't be dealt to different cells). Cells have about CELL points. A point asks only cells whose box is no farther
    than its m-th nearest in its own cell; in many dimensions these are most cells, and the work that of all pairs."""
    cols = list(cols)
    n = points.count()
    every = max(1, n // CUTS)
    some = points.where(F.pmod(F.xxhash64(ROW), F.lit(every)) == 0).select(*cols).toPandas().to_numpy(float)  # about CUTS rows
    tree = Cells(some, max(0, (-(-n // CELL) - 1).bit_length()))
    kinds = ", ".join(f"`{c}` double" for c in cols)
    lists = f"`{ROW}` long, d array<double>, r array<long>"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cell=tree.of(f[cols].to_numpy(float)))

    placed = stored(points.select(ROW, *(F.col(c).cast("double").alias(c) for c in cols)).mapInPandas(place, f"`{ROW}` long, {kinds}, cell long"))
    boxes = placed.groupBy("cell").agg(*(f(c).alias(f"{a}{i}") for i, c in enumerate(cols) for a, f in (("l", F.min), ("h", F.max)))).toPandas()  # a row per cell
    side = lambda a: boxes[[f"{a}{i}" for i in range(len(cols))]].to_numpy(float)
    tree.bound(boxes["cell"].to_numpy(np.int64), side("l"), side("h"))
    # a number of tasks that Spark doesn't lessen, as few bytes are much work here
    tasks = max(1, min(len(boxes), max(4 * points.sparkSession.sparkContext.defaultParallelism, len(boxes) // 64)))

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(ROW)
        d, r = _first(f[cols].to_numpy(float), f[cols].to_numpy(float), f[ROW].to_numpy(np.int64), m)
        return f.assign(d=d, r=r, reach=[x[-1] if len(x) == m else np.inf for x in d])

    own = stored(placed.repartition(tasks, "cell").groupBy("cell").applyInPandas(inside, f"{lists}, {kinds}, cell long, reach double"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, cell = tree.within(f[cols].to_numpy(float), f["reach"].to_numpy(float))
            other = cell != f["cell"].to_numpy(np.int64)[at]
            yield f.iloc[at[other]].assign(cell=cell[other])

    asks = stored(own.select(ROW, *cols, "reach", "cell").mapInPandas(ask, f"`{ROW}` long, {kinds}, reach double, cell long"))
    parts = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    asking = asks.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(ROW), F.col("parts")).cast("int")).drop("parts")
    asked = placed.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def beyond(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(ROW)
        d, r = _first(left[cols].to_numpy(float), right[cols].to_numpy(float), right[ROW].to_numpy(np.int64), m, left["reach"].to_numpy(float))
        out = pd.DataFrame({ROW: left[ROW].to_numpy(np.int64), "d": d, "r": r})
        return out[[len(x) > 0 for x in d]]

    by = ("cell", "part")
    others = asking.repartition(tasks, *by).groupBy(*by).cogroup(asked.repartition(tasks, *by).groupBy(*by)).applyInPandas(beyond, lists)
    both = own.select(ROW, "d", "r").union(others).select(ROW, F.arrays_zip("d", "r").alias("near"))
    return both.groupBy(ROW).agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, m).alias("near"))
