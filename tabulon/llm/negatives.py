"""Hard negatives by Fagin's threshold algorithm: sorted lists of every dimension, read from the anchor's side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Candidate rows of a block, whose sorted lists one task holds, and anchors that a task takes against a block.
ROWS, TURN = 8192, 65_536
#: Depth of the first sorted access; each later one goes twice as deep.
FIRST = 16
EXACT = 1 << 53


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """row, id, label and q (the components as floor(scale * x), x as double) of the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull()).where(finite)
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("q"))


def matrix(q: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integers; shorter rows go on with zeros."""
    offsets = q.offsets.to_numpy().astype(np.int64)
    flat, n = q.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    inside = np.arange(out.shape[1]) < n[:, None]
    out[inside] = flat[offsets[0] : offsets[-1]]
    return out


class Lists:
    """A block of candidates: every dimension's rows in order of that component."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        self.q, self.ids, self.rows, self.labels = q, ids, rows, labels
        self.most = max(abs(int(x)) for x in (q.min(initial=0), q.max(initial=0)))
        self.order = np.ascontiguousarray(np.argsort(q, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(q.T, self.order, 1)
        self.real = q.astype(np.float64)

    def number(self, anchor: np.ndarray) -> np.ndarray:
        """The anchor in the numbers in which inner products with it are exact: doubles, long integers or Python's."""
        bound = len(anchor) * self.most * max((abs(int(x)) for x in (anchor.min(initial=0), anchor.max(initial=0))))
        return anchor.astype(np.float64) if bound < EXACT else anchor if bound < 1 << 62 else anchor.astype(object)

    def access(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Candidates that sorted access meets for the first time, with their inner products by random access, and the
        threshold below which or at which all others lie. A positive component reads its list from the largest value on, a
        negative one from the smallest; a component of zero has no say, so its list is not read."""
        n, a = len(self.q), self.number(anchor)
        q = self.real if a.dtype == np.float64 else self.q if a.dtype == np.int64 else self.q.astype(object)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        seen, at, depth = np.zeros(n, bool), 0, FIRST
        while at < n:
            to = min(n, at + depth)
            met = np.zeros(n, bool)
            met[self.order[up, at:to].ravel()] = True
            met[self.order[down, n - to : n - at].ravel()] = True
            if not len(up) and not len(down):
                met[:], to = True, n
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            last = np.zeros(len(anchor), np.int64)
            last[up], last[down] = self.sorted[up, to - 1], self.sorted[down, n - to]
            yield new, (q[new] @ a), int(last.astype(a.dtype) @ a)
            at, depth = to, 2 * depth
            if len(up) + len(down) and seen.all():
                return


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller identifier."""
    if score.dtype == object:  # integers beyond 64 bits
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


class Goal:
    """The k best candidates seen so far whose score times 100 lies in [low, high], and whether later ones can matter."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.score, self.at = np.zeros(0), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (100 * score >= self.low) & (100 * score <= self.high)
            score, at = score[inside], at[inside]
        if len(self.score) == self.k and len(score):
            near = score >= self.score[-1]
            score, at = score[near], at[near]
        if len(score):
            score, at = np.concatenate([self.score, score]) if len(self.score) else score, np.concatenate([self.at, at])
            top = best(score, ids[at], self.k)
            self.score, self.at = score[top], at[top]

    def over(self, threshold: int) -> bool:
        """Rows not seen score the threshold at most: strictly below the kth score, or below the window, none can matter."""
        if self.low is not None and (self.low > self.high or 100 * threshold < self.low):
            return True
        return len(self.score) == self.k and threshold < self.score[-1]


def search(lists: Lists, anchor: np.ndarray, allowed: np.ndarray, goals: list[Goal]) -> None:
    for new, score, threshold in lists.access(anchor):
        fit = allowed[new]
        new, score = new[fit], score[fit]
        for g in goals:
            g.add(score, new, lists.ids)
        if all(g.over(threshold) for g in goals):
            return


def _turns(candidates: DataFrame, anchors: DataFrame, blocks: int, turns: int) -> DataFrame:
    """A task's rows: the candidates of a block first, then the anchors of a turn. Every block is sent to each turn, every
    anchor to each block."""
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    a = candidates.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), each(turns, "turn"), F.lit(0).alias("tag"), "row", "id", "label", "q", F.lit(None).cast("array<long>").alias("windows"), F.lit(None).cast("array<long>").alias("positives"))
    b = anchors.select(each(blocks, "block"), F.pmod(F.xxhash64("row", F.lit(3)), F.lit(turns)).cast("int").alias("turn"), F.lit(1).alias("tag"), "row", "id", "label", "q", "windows", "positives")
    both = a.unionByName(b)
    return both.repartition(blocks * turns, "block", "turn").sortWithinPartitions("block", "turn", "tag")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lists, pa.RecordBatch]]:
    """Each batch of anchors with its block's lists, which are made once and then stay for all anchors of the turn."""
    key, held, lists = None, [], None
    for batch in batches:
        block, turn, tag = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "turn", "tag"))
        cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(turn) != 0) | (np.diff(tag) != 0)) + 1
        for i, j in zip([0, *cut], [*cut, len(tag)]):
            if i == j:
                continue
            if (block[i], turn[i]) != key:
                key, held, lists = (block[i], turn[i]), [], None
            part = batch.slice(i, j - i)
            if not tag[i]:
                held.append(part)
                continue
            if lists is None and held:
                c = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                lists = Lists(matrix(c.column("q")), *(c.column(x).to_numpy() for x in ("id", "row", "label")))
                held = []
            if lists is not None:
                yield lists, part


def _anchors(lists: Lists, part: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, list, list]]:
    q = matrix(part.column("q"), lists.q.shape[1])
    if q.shape[1] > lists.q.shape[1]:  # what the candidates don't have counts as zero
        q = q[:, : lists.q.shape[1]]
    lists_of = (part.column(c).to_pylist() for c in ("row", "id", "label", "windows", "positives"))
    for (row, id_, label, windows, positives), a in zip(zip(*lists_of), q):
        yield row, id_, label, a, windows, positives


def _long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, part in _blocks(batches):
            out = []
            for row, id_, label, a, _, _ in _anchors(lists, part):
                g = Goal(k)
                search(lists, a, (lists.labels == label) & (lists.rows != row), [g])
                out += [(row, id_, int(lists.rows[i]), int(lists.ids[i]), _long(s)) for s, i in zip(g.score, g.at)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists, part in _blocks(batches):
            out = []
            for row, _, label, a, windows, positives in _anchors(lists, part):
                goals = {w: Goal(k, low * w, high * w) for w in windows}  # equal scores share a window
                search(lists, a, lists.labels != label, list(goals.values()))
                for p, w in zip(positives, windows):
                    out += [(row, p, int(lists.ids[i]), _long(s)) for s, i in zip(goals[w].score, goals[w].at)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["anchor_row", "positive_row", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of the rows for which `anchors` (on id_col) holds, for each of their first positives.

    A score is the integer inner product of floor(scale * component). Positives are an anchor's other rows of the same
    label; negatives have another label and low * positive_score <= 100 * negative_score <= high * positive_score. Higher
    scores come first, ties by smaller identifier. Returns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Rows with a null identifier, label or vector, or with a null or non-finite component, take no part. A shorter vector
    goes on with zeros, so an empty one scores 0 with all. Rows that repeat an identifier are rows of their own: each is a
    candidate, and each that is an anchor gives its rows. An anchor without a positive, or a positive without a negative in
    its window, gives no row; a negative positive_score has an empty window, one of 0 takes scores of 0. An empty table
    gives an empty result; other columns play no part. Components beyond 2**63 / scale count as the largest
    long, and so does a score beyond it.

    Every block of about ROWS candidates is one task for up to TURN anchors: it sorts its lists once and streams anchors
    past them. What blocks find (at most `positives`, then `negatives` rows a window) is merged by rank."""
    rows = stored(whole_vectors(vectors, scale, id_col, vector_col, label_col), "negatives")
    own = rows.withColumnRenamed("id", id_col).where(anchors).withColumnRenamed(id_col, "id")
    size = rows.agg(F.count(F.lit(1)).alias("n")).collect()[0].n
    asked = own.agg(F.count(F.lit(1)).alias("n")).collect()[0].n
    blocks, turns = max(1, -(-size // ROWS)), max(1, -(-asked // TURN))
    none = F.lit(None).cast("array<long>")
    near = _turns(rows, own.select("*", none.alias("windows"), none.alias("positives")), blocks, turns).mapInArrow(_positives(positives), "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    near = stored(near.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= positives).drop("_r"), "positives")
    windows = near.where("positive_score >= 0").groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list("positive_score").alias("windows"), F.collect_list("positive_row").alias("positives"))  # `positives` at most
    far = _turns(rows, own.join(windows, "row"), blocks, turns).mapInArrow(_negatives(negatives, low, high), "anchor_row long, positive_row long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(near, ["anchor_row", "positive_row"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
