"""Points near each other without all pairs: cells and their bounding boxes say most of it, and exact distances the rest.

Distances are sums of squares in the order of the columns. Those to the near and far corners of a box are computed alike, so
what a box says of its points is what the pairs would say, to the last bit."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import ROW, numbers, stored, with_row

#: A pair of cells is compared point by point where it has at most this many pairs of points, else its halves are.
WORK = 4096
#: Cells are halved this often at most, and a column's span is at most this many radii, so that places are exact.
DEPTH, SPAN = 16, 2.0**40


def _squares(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (c * c for c in parts))


def _gap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return F.greatest(low_a - high_b, low_b - high_a, F.lit(0.0))


class Boxes:
    """Squared distances between the nearest and the farthest corners of boxes, and between points, in `d` columns."""

    def __init__(self, d: int):
        self.k = range(d)

    def of(self) -> list[Column]:
        return [f(f"x{i}").alias(f"{n}{i}") for i in self.k for n, f in (("lo", F.min), ("hi", F.max))]

    def named(self, suffix: str) -> list[Column]:
        return [F.col(f"{n}{i}").alias(f"{n}{suffix}{i}") for i in self.k for n in ("lo", "hi")]

    def near(self, a: str, b: str) -> Column:
        return _squares([_gap(F.col(f"lo{a}{i}"), F.col(f"hi{a}{i}"), F.col(f"lo{b}{i}"), F.col(f"hi{b}{i}")) for i in self.k])

    def far(self, a: str, b: str) -> Column:
        return _squares([F.greatest(F.col(f"hi{a}{i}") - F.col(f"lo{b}{i}"), F.col(f"hi{b}{i}") - F.col(f"lo{a}{i}")) for i in self.k])

    def point_near(self, b: str) -> Column:
        return _squares([_gap(F.col(f"x{i}"), F.col(f"x{i}"), F.col(f"lo{b}{i}"), F.col(f"hi{b}{i}")) for i in self.k])

    def point_far(self, b: str) -> Column:
        return _squares([F.greatest(F.col(f"hi{b}{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"lo{b}{i}")) for i in self.k])

    def apart(self) -> Column:
        return _squares([F.col(f"x{i}") - F.col(f"y{i}") for i in self.k])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b). Rounds: each node takes its first link by (smaller end, larger end), trees
    of taken links become one node by pointer jumping, and links between different nodes remain. At least half of the nodes
    that have a link go each round, whatever the graph's shape."""
    both = links.where("a <> b")
    root = stored(both.select(F.col("a").alias("node")).union(both.select("b")).distinct().withColumn("root", F.col("node")))
    left = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("u"), F.struct("a", "b").alias("e")).union(left.select(F.col("b"), F.struct("a", "b")))
        first = ends.groupBy("u").agg(F.min("e").alias("e")).withColumn("v", F.when(F.col("u") == F.col("e.a"), F.col("e.b")).otherwise(F.col("e.a")))
        # of two that took the same link, the smaller is the root
        back = first.select(F.col("u").alias("v"), F.col("v").alias("w"))
        up = stored(first.join(back, "v", "left").select("u", F.when((F.col("w") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("v")))
        while True:
            jumped = stored(up.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"), (F.col("w") != F.col("v")).alias("moved")))
            up = jumped.select("u", "v")
            if jumped.where("moved").isEmpty():
                break
        root = stored(root.join(up.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("v", "root").alias("root")))
        a, b = up.select(F.col("u").alias("a"), F.col("v").alias("ra")), up.select(F.col("u").alias("b"), F.col("v").alias("rb"))
        ends = left.join(a, "a").join(b, "b").where("ra <> rb")
        left = stored(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return root


def _cell(d: int, low: Sequence[float], side: float, level: int = 0) -> Column:
    """A point's place at cells of side / 2**level."""
    return F.array(*(F.floor((F.col(f"x{i}") - low[i]) / side * float(1 << level)) for i in range(d)))


def _neighbours(a: DataFrame, b: DataFrame, box: Boxes, eps: float, d: int) -> DataFrame:
    """Pairs of cells (cell, other) whose boxes are within eps, with the boxes loa.., lob..: they meet in coarse cells wider than
    eps, each with its own and those around it."""
    wide = math.ceil(math.sqrt(d)) + 1
    coarse = [F.floor(F.col("cell")[i] / wide) for i in range(d)]
    left = a.select("cell", *box.named("a"), *(c.alias(f"c{i}") for i, c in enumerate(coarse)))
    right = b.select(F.col("cell").alias("other"), "n", "k", *box.named("b"), *(c.alias(f"c{i}") for i, c in enumerate(coarse)))
    for i in range(d):
        left = left.withColumn("_s", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(f"c{i}", F.col(f"c{i}") + F.col("_s")).drop("_s")
    return left.join(right, [f"c{i}" for i in range(d)]).where(box.near("a", "b") <= eps * eps).drop(*(f"c{i}" for i in range(d)))


def _core_links(core: DataFrame, cells: DataFrame, box: Boxes, d: int, eps: float, low: Sequence[float], side: float, work: int) -> DataFrame:
    """Pairs (a, b) of cells with points within eps of each other. Boxes decide where their far corners are within eps. Other
    pairs are halved until their boxes decide or they have at most `work` pairs of points, which are compared; of a pair that
    is linked, or whose ends are connected already, nothing more is asked."""
    kept = ["a", "b", "pa", "pb", "na", "nb"]
    pairs = _neighbours(cells, cells, box, eps, d).where("cell < other").join(cells.select("cell", F.col("k").alias("na")), "cell")
    pairs = stored(pairs.select(F.col("cell").alias("a"), F.col("other").alias("b"), F.col("cell").alias("pa"), F.col("other").alias("pb"), "na", F.col("k").alias("nb"), (box.far("a", "b") <= eps * eps).alias("sure")))
    links = pairs.where("sure").select("a", "b")
    open_ = pairs.where("NOT sure").select(*kept)
    for level in range(DEPTH + 1):
        if open_.isEmpty():
            break
        if level == 0:
            root = components(links)
            ends = [root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
            open_ = stored(open_.join(ends[0], "a", "left").join(ends[1], "b", "left").where("ra IS NULL OR rb IS NULL OR ra <> rb").select(*kept))
        few = (F.col("na") * F.col("nb") <= work) if level < DEPTH else F.lit(True)
        at = core.withColumn("p", _cell(d, low, side, level))
        one = at.select(F.col("cell").alias("a"), F.col("p").alias("pa"), *(f"x{i}" for i in box.k))
        two = at.select(F.col("cell").alias("b"), F.col("p").alias("pb"), *(F.col(f"x{i}").alias(f"y{i}") for i in box.k))
        close = open_.where(few).join(one, ["a", "pa"]).join(two, ["b", "pb"]).where(box.apart() <= eps * eps).select("a", "b").distinct()
        found = close
        rest = open_.where(~few)
        if level < DEPTH:
            halves = core.withColumn("p", _cell(d, low, side, level + 1)).groupBy("cell", "p").agg(F.count(F.lit(1)).alias("n"), *box.of())
            parent = F.transform("p", lambda c: F.floor(c / 2))
            ha = halves.select(F.col("cell").alias("a"), parent.alias("pa"), F.col("p").alias("qa"), F.col("n").alias("ma"), *box.named("a"))
            hb = halves.select(F.col("cell").alias("b"), parent.alias("pb"), F.col("p").alias("qb"), F.col("n").alias("mb"), *box.named("b"))
            split = stored(rest.select("a", "b", "pa", "pb").join(ha, ["a", "pa"]).join(hb, ["b", "pb"]).where(box.near("a", "b") <= eps * eps).select("a", "b", F.col("qa").alias("pa"), F.col("qb").alias("pb"), F.col("ma").alias("na"), F.col("mb").alias("nb"), (box.far("a", "b") <= eps * eps).alias("sure")))
            found = close.union(split.where("sure").select("a", "b"))
            rest = split.where("NOT sure").select(*kept)
        found = stored(found.distinct())
        links = links.union(found)
        open_ = stored(rest.join(found, ["a", "b"], "left_anti"))
    return links


def dbscan(df: DataFrame, cols: Sequence[str], eps: float, min_points: int, id_col: str, work: int = WORK) -> DataFrame:
    """(id, cluster, core): a core has at least min_points rows within eps, itself included; clusters are components of cores,
    numbered by their smallest core's id (as text), and a border point takes the first of its cores' clusters; noise is -1.

    Equal points are counted once. Cells are so small that their points are all within eps of each other: those of min_points
    rows are cores without pairs, and of the others each point meets the cells around it, whose boxes mostly decide. Cells are
    joined as a graph. So a dense cell costs its length times the few points of thin cells beside it. Up to six columns, as
    cells have 3^d coarse neighbours. Rows that miss a number or the id take no part; an empty table gives none. A column may
    span 2**40 times eps."""
    d = len(cols)
    if not 1 <= d <= 6:
        raise ValueError("one to six columns")
    if not 0 < eps < math.inf:
        raise ValueError("eps must be a positive number")
    names = [f"x{i}" for i in range(d)]
    v = numbers(df, *cols, keep=(id_col,)).select(F.col(id_col).alias("id"), *(F.col(c).alias(x) for c, x in zip(cols, names)))
    s = v.agg(*(F.min(x).alias(f"lo_{x}") for x in names), *(F.max(x).alias(f"hi_{x}") for x in names)).collect()[0]
    if s.lo_x0 is None:
        return v.select(F.col("id").alias(id_col), F.lit(-1).alias("cluster"), F.lit(False).alias("core"))
    low, box, near2 = [s[f"lo_{x}"] for x in names], Boxes(d), eps * eps
    if max(s[f"hi_{x}"] - s[f"lo_{x}"] for x in names) / eps > SPAN:
        raise ValueError("a column spans more than 2**40 times eps")
    side = eps / math.sqrt(d) * (1 - 2.0**-10)
    points = stored(v.groupBy(*names).agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("id")).withColumn("cell", _cell(d, low, side)))
    boxes = lambda rows: rows.groupBy("cell").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("k"), *box.of())
    cells = stored(boxes(points))
    full = F.col("n") >= min_points
    thin = points.join(cells.where(~full).select("cell"), "cell")

    # how many rows a point of a thin cell has within eps
    met = thin.join(_neighbours(cells.where(~full), cells, box, eps, d).drop(*(f"{n}a{i}" for i in box.k for n in ("lo", "hi"))), "cell").where(box.point_near("b") <= near2)
    met = stored(met.select(*names, "other", "n", (box.point_far("b") <= near2).alias("sure")))
    other = points.select(F.col("cell").alias("other"), F.col("w").alias("n"), *(F.col(x).alias(f"y{i}") for i, x in enumerate(names)))
    some = met.where("NOT sure").drop("n").join(other, "other").where(box.apart() <= near2).groupBy(*names).agg(F.sum("n").alias("n"))
    enough = met.where("sure").groupBy(*names).agg(F.sum("n").alias("n")).union(some).groupBy(*names).agg(F.sum("n").alias("n")).where(full).select(*names, F.lit(True).alias("core"))
    known = thin.join(enough, names, "left").select(*names, "w", "id", "cell", F.coalesce("core", F.lit(False)).alias("core"))
    known = stored(known.unionByName(points.join(cells.where(full).select("cell"), "cell").withColumn("core", F.lit(True))))

    core = known.where("core").select("cell", "w", "id", *names)
    homes = stored(core.groupBy("cell").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("k"), F.min("id").alias("id"), *box.of()))
    root = components(_core_links(core, homes, box, d, eps, low, side, work))
    group = homes.select("cell", "id").join(root.withColumnRenamed("node", "cell"), "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    first = group.groupBy("root").agg(F.min("id").alias("id"))
    number = with_row(first.select("id")).select("id", (F.col(ROW) + 1).cast("int").alias("cluster"))
    label = stored(group.select("cell", "root").join(first.join(number, "id").select("root", "cluster"), "root").select("cell", "cluster"))

    # points that are no cores take the first cluster with a core within eps
    loose = known.where("NOT core").select("cell", "w", *names)
    met = loose.join(_neighbours(boxes(loose), homes, box, eps, d).select("cell", "other", *(f"{n}b{i}" for i in box.k for n in ("lo", "hi"))), "cell").where(box.point_near("b") <= near2)
    met = stored(met.select(*names, "other", (box.point_far("b") <= near2).alias("sure")).join(label.withColumnRenamed("cell", "other"), "other"))
    some = met.where("NOT sure").join(core.select(F.col("cell").alias("other"), *(F.col(x).alias(f"y{i}") for i, x in enumerate(names))), "other").where(box.apart() <= near2)
    border = met.where("sure").select(*names, "cluster").union(some.select(*names, "cluster")).groupBy(*names).agg(F.min("cluster").alias("cluster"))
    placed = known.where("core").join(label, "cell").select(*names, "cluster", "core").unionByName(border.withColumn("core", F.lit(False)))
    return v.join(placed, names, "left").select(F.col("id").alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core"))
