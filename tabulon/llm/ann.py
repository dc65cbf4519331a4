"""Approximate nearest neighbours over robust-pruned directed graphs, one per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD, DEGREE, BEAM, RELAX, BLOCK = 20_000, 32, 64, 1.2, 16_384


class Graph:
    """A directed graph over points under squared Euclidean distance; edges[i] holds up to `degree` neighbours, -1 beyond."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, start: int):
        self.points, self.edges, self.start = points, edges, start

    def search(self, queries: np.ndarray, beam: int, ready: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: each expands its nearest unexpanded point until its beam has none.

        Gives each query's beam: points (-1 beyond) by distance, and distances."""
        q, n = len(queries), len(self.points)
        ids = np.full((q, beam), -1, np.int32)
        dist = np.full((q, beam), np.inf, np.float32)
        done = np.ones((q, beam), bool)
        ids[:, 0], done[:, 0] = self.start, False
        dist[:, 0] = ((queries - self.points[self.start]) ** 2).sum(1)
        seen = np.zeros((q, n), bool)
        seen[:, self.start] = True
        live = np.arange(q)
        while len(live):
            open_ = ~done[live]
            live = live[open_.any(1)]
            if not len(live):
                break
            first = np.argmax(~done[live], 1)  # beams are sorted
            done[live, first] = True
            near = self.edges[ids[live, first]]
            row = np.repeat(np.arange(len(live)), near.shape[1]).reshape(near.shape)
            new = near >= 0
            new[new] = ~seen[live[row[new]], near[new]]
            seen[live[row[new]], near[new]] = True
            d = np.full(near.shape, np.inf, np.float32)
            r, c = np.nonzero(new)
            d[r, c] = ((self.points[near[r, c]] - queries[live[r]]) ** 2).sum(1)
            all_d = np.concatenate([dist[live], d], 1)
            order = np.argsort(all_d, 1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), order, 1)
        ids[~np.isfinite(dist)] = -1
        return ids, dist


def robust_prune(points: np.ndarray, at: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point at[i], up to `degree` of the candidates cand[i] (-1: none): again and again the nearest one left,
    dropping those that are nearer to it, by the factor `relax`, than to the point."""
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == at[:, None]] = -1
    vec = points[np.maximum(cand, 0)]
    d = ((vec - points[at][:, None]) ** 2).sum(2)
    d[cand < 0] = np.inf
    out = np.full((len(at), degree), -1, np.int32)
    rows = np.arange(len(at))
    for k in range(degree):
        best = np.argmin(d, 1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, k] = cand[rows, best][ok]
        between = ((vec - vec[rows, best][:, None]) ** 2).sum(2)
        d[(relax * relax * between <= d) | ~ok[:, None]] = np.inf
        d[rows, best] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX, passes: int = 2) -> Graph:
    """A graph over vectors for the largest inner product: one more coordinate makes all of one length, so that the
    nearest point has the largest product. Points are inserted in batches that grow with the graph."""
    x = vectors.astype(np.float32)
    norm = (x.astype(np.float64) ** 2).sum(1)
    points = np.column_stack([x, np.sqrt(np.maximum(0, norm.max() - norm)).astype(np.float32)])
    n = len(points)
    start = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    g = Graph(points, np.full((n, degree), -1, np.int32), start)
    order = np.random.default_rng(7).permutation(n)
    for k in range(passes):
        at, size = 0, 1 if k == 0 else 512
        while at < n:
            batch = order[at : at + size]
            found, _ = g.search(points[batch], beam)
            g.edges[batch] = robust_prune(points, batch, np.concatenate([found, g.edges[batch]], 1), degree, relax)
            a = np.repeat(batch, degree)
            b = g.edges[batch].ravel()
            a, b = a[b >= 0], b[b >= 0]
            _link_back(g, a, b, degree, relax)
            at, size = at + len(batch), min(512, max(1, (at + len(batch)) // 2)) if k == 0 else 512
    return g


def _link_back(g: Graph, a: np.ndarray, b: np.ndarray, degree: int, relax: float) -> None:
    """Adds edges b to a; a point with too many is pruned."""
    if not len(b):
        return
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    to, first, many = np.unique(b, return_index=True, return_counts=True)
    wide = np.full((len(to), degree + int(many.max())), -1, np.int32)
    wide[:, :degree] = g.edges[to]
    wide[np.repeat(np.arange(len(to)), many), degree + np.arange(len(b)) - np.repeat(first, many)] = a
    wide = -np.sort(-wide, 1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    wide = -np.sort(-wide, 1)
    full = (wide >= 0).sum(1) > degree
    g.edges[to[~full]] = wide[~full, :degree]
    for i in range(0, int(full.sum()), 512):
        rows = np.flatnonzero(full)[i : i + 512]
        g.edges[to[rows]] = robust_prune(g.points, to[rows], wide[rows], degree, relax)


def usable(column):
    """True for vectors that are not null, not zero, and have only finite components."""
    return F.coalesce(column.isNotNull() & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(column, lambda v: v != 0), F.lit(False))


def distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct vectors (0 and -0 are equal) in the order of their first rows, and each row's place among them."""
    v = vectors + vectors.dtype.type(0)
    _, first, at = np.unique(v, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return v[first[order]], place[at.ravel()]


def copies(ids: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each vector's identifiers begin, and how many of them can be among the k first of a query whose own rows are
    left out: k, and as many as one identifier repeats. ids: those of each vector in turn, rising; count: how many each has."""
    begin = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])))
    repeats = np.zeros(len(count), np.int64)
    np.maximum.at(repeats, of[head], np.diff(np.append(head, len(ids))))
    return begin, np.minimum(count, k + repeats)


def _scaled(v: np.ndarray) -> np.ndarray:
    """The vectors in single precision, shrunk together so that no square overflows: for graphs, not for scores."""
    most = np.abs(v).max(initial=0.0)
    return (v / (most or 1.0)).astype(np.float32)


def build_shards(vectors: DataFrame, id_col: str, vector_col: str, shard: int = SHARD) -> DataFrame:
    """One row per shard: dim, shard, ids, counts, vectors, edges (as bytes) and the start. Every usable row is in one shard.

    The graph is over the shard's distinct vectors, each of which has `counts` identifiers in ids: equal points would prune
    each other's edges away."""
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"))
    n = max(1, -(-rows.count() // shard))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        v, at = distinct(np.stack(frame.v.to_numpy()).astype(np.float64))
        g = build(_scaled(v))
        ids = frame.id.to_numpy(np.int64)[np.argsort(at, kind="stable")]
        return pd.DataFrame({"dim": [v.shape[1]], "shard": [int(frame["shard"].iloc[0])], "ids": [ids.tobytes()], "counts": [np.bincount(at).astype(np.int64).tobytes()], "vectors": [v.tobytes()], "edges": [g.edges.tobytes()], "start": [g.start]})

    return rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(n)).cast("int")).groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, ids binary, counts binary, vectors binary, edges binary, start int")


def query_blocks(queries: DataFrame, id_col: str, vector_col: str, block: int = BLOCK) -> DataFrame:
    """Rows of up to about `block` queries each: dim, block, qids, qvectors."""
    rows = queries.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))  # a repeated query counts once
    n = max(1, -(-rows.count() // block))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        return pd.DataFrame({"dim": [frame["dim"].iloc[0]], "block": [frame["block"].iloc[0]], "qids": [frame.id.to_numpy(np.int64).tobytes()], "qvectors": [np.stack(frame.v.to_numpy()).astype(np.float64).tobytes()]})

    return rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(n)).cast("int")).groupBy("dim", "block").applyInPandas(run, "dim int, block int, qids binary, qvectors binary")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each query the k rows of the largest inner product that the search
    finds, its own row left out; ties go to the smaller identifier. Scores are exact, in double precision.

    Every shard's graph is searched for every block of queries, each pair in a task of its own; only k rows of each pair
    go on. Vectors are found once and stand for all their copies. Unusable vectors take no part; vectors of other dimensions
    are not compared; rows that repeat an identifier are candidates of their own, but not for a query of that identifier;
    a repeated query is answered once, by the smallest of its vectors; with k or fewer candidates all are found; other columns play no
    part; empty tables give an empty result."""
    graphs = stored(build_shards(vectors, id_col, vector_col, shard), "graphs")
    blocks = stored(query_blocks(queries, id_col, vector_col), "queries")
    # a block goes to each shard of its dimension: the pairs are named, and each is one row
    shards = graphs.select("dim", "shard")
    named = blocks.select("dim", "block").join(shards, "dim")
    many_pairs = max(1, named.count())
    pairs = named.join(blocks, ["dim", "block"]).join(graphs, ["dim", "shard"]).repartition(many_pairs, "dim", "shard", "block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield searched(frame)

    def searched(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in frame.itertuples(index=False):
            ids, v = np.frombuffer(x.ids, np.int64), np.frombuffer(x.vectors, np.float64).reshape(-1, x.dim)
            qids, q = np.frombuffer(x.qids, np.int64), np.frombuffer(x.qvectors, np.float64).reshape(-1, x.dim)
            begin, many = copies(ids, np.frombuffer(x.counts, np.int64), k)
            small, small_q = _scaled(v), (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
            norm = (small.astype(np.float64) ** 2).sum(1)
            points = np.column_stack([small, np.sqrt(np.maximum(0, norm.max() - norm)).astype(np.float32)])
            g = Graph(points, np.frombuffer(x.edges, np.int32).reshape(len(v), -1), x.start)
            width = max(beam, 2 * k + 2)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                if len(v) <= width:
                    found = np.broadcast_to(np.arange(len(v), dtype=np.int32), (len(part), len(v)))
                else:
                    near = small_q[at : at + 256]
                    found, _ = g.search(np.column_stack([near, np.zeros(len(near), np.float32)]), width)
                score = np.einsum("qcd,qd->qc", v[np.maximum(found, 0)], part)
                row, col = np.nonzero(found >= 0)
                n = many[found[row, col]]
                first = np.repeat(begin[found[row, col]] - (np.cumsum(n) - n), n)
                row, real, score = np.repeat(row, n), ids[first + np.arange(n.sum())], np.repeat(score[row, col], n)
                other = real != qids[at + row]
                row, real, score = row[other], real[other], score[other]
                order = np.lexsort((real, -score, row))
                row, real, score = row[order], real[order], score[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                out.append(pd.DataFrame({"query_id": qids[at + row[best]], "found": real[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "found": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = pairs.mapInPandas(run, "query_id long, found long, score double")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(id_col), "score")
