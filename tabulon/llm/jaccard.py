"""N-gram Jaccard join with a count-vector R-tree."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact, from_gaps, from_planes, gaps, groups_of, map_rows, mix64, parts_of, planes, shingles_of, stored
from .components import components

_U = np.uint64
#: Points in a leaf; shingles and sets of a task's block; bytes of text in a chunk; keys per bucket of the candidate search.
LEAF, BLOCK, ROWS, CHUNK, KEYS = 32, 1_000_000, 512, 8 << 20, 2_000_000
#: Parts of a partition, of which a key leaves one out; dealings that are tried before single shingles are keys.
SUBPARTS, SEEDS = 3, 4
#: Bits of a shingle's hash that chunks send to learn which shingles are in several sets: at least, and beyond those that
#: number the shingles. A chance match only lets a set stay that could have been done with.
BITS, SPARE = 40, 9


class RTree:
    """Count vectors packed into leaves by halving along the coordinate (or the size) that spreads most; a node keeps the
    largest value of each coordinate and the range of sizes under it. The sum of the smaller coordinates bounds an
    overlap from above."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.order, self.leaf, self.levels = _packing(np.column_stack([sizes, points]), leaf), leaf, []
        hi, low, high = points[self.order], sizes[self.order], sizes[self.order]
        while True:
            self.levels.append((hi, low, high))
            if len(hi) <= leaf:
                break
            at = np.arange(0, len(hi), leaf)
            hi, low, high = np.maximum.reduceat(hi, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose bound reaches the overlap that a similarity of num/den needs, and their bounds."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, low, high = (x[at] for x in self.levels[depth])
            ok = np.flatnonzero((den * high >= num * size) & (num * low <= den * size))
            at, low = at[ok], low[ok]
            bound = np.minimum(hi[ok], point).sum(1, dtype=np.int64)
            ok = bound * (num + den) >= num * (size + low)
            at, bound = at[ok], bound[ok]
            if depth:
                at = (at[:, None] * self.leaf + np.arange(self.leaf)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at], bound


def _packing(points: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the points whose consecutive runs of `leaf` are close together."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        axis = int(np.argmax(points[at].var(0)))
        half = -(-len(at) // (2 * leaf)) * leaf
        at = at[np.argsort(points[at, axis], kind="stable")]
        todo += [at[half:], at[:half]]
    return np.concatenate(out)


def dims_for(sizes: np.ndarray) -> int:
    """Groups of a count vector: about four shingles of a middling set fall in one, so that unrelated sets stay far apart."""
    return 1 << int(np.clip(np.ceil(np.log2(max(1.0, float(np.median(sizes)) / 4))), 4, 10))


def count_vectors(values: np.ndarray, begin: np.ndarray, dims: int) -> np.ndarray:
    """Shingles of each set by group: a hash deals them to `dims` groups."""
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    group = (mix64(values + _U(77)) % _U(dims)).astype(np.int64)
    return np.bincount(of * dims + group, minlength=(len(begin) - 1) * dims).reshape(-1, dims).astype(np.int32)


def classes(values: np.ndarray, begin: np.ndarray, num: int, den: int, known: np.ndarray | None = None, probe: np.ndarray | None = None, seeker: np.ndarray | None = None) -> np.ndarray:
    """Each set's class: the first set that it reaches by links of similarity num/den or more.

    Each set searches the tree; a candidate that is known to be in its class needs no check, the others are verified
    on the sets themselves, the most likely ones first. known: sets that are one class already. probe, seeker: only
    seekers search, and only for probes that are not seekers."""
    n = len(begin) - 1
    sizes = np.diff(begin)
    points = count_vectors(values, begin, dims_for(sizes))
    inside = np.arange(n) if probe is None else np.flatnonzero(probe & ~seeker)
    tree, root = RTree(points[inside], sizes[inside]), np.arange(n)
    members = {i: [i] for i in range(n)}

    def join(a: int, b: int) -> None:
        a, b = (a, b) if a < b else (b, a)
        root[members[b]] = a
        members[a] += members.pop(b)

    if known is not None and known.any():
        first, *rest = np.flatnonzero(known).tolist()
        for x in rest:
            join(first, x)
    for x in range(n) if seeker is None else np.flatnonzero(seeker):
        cand, bound = tree.search(points[x], int(sizes[x]), num, den)
        cand = inside[cand]
        ok = root[cand] != root[x]
        if seeker is None:
            ok &= cand < x
        cand = cand[ok][np.argsort(-bound[ok], kind="stable")]
        mine, step = values[begin[x] : begin[x + 1]], 1
        while len(cand):
            part, cand = cand[:step], cand[step:]
            many = np.concatenate([values[begin[y] : begin[y + 1]] for y in part])
            at = np.searchsorted(mine, many)
            hit = mine[np.minimum(at, len(mine) - 1)] == many
            inter = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(sizes[part])[:-1]))
            for y in part[inter * (num + den) >= num * (sizes[x] + sizes[part])]:
                if root[x] != root[y]:
                    join(int(root[x]), int(root[y]))
            cand = cand[root[cand] != root[x]]
            step = min(64, step * 4)
    return root


class Scheme(NamedTuple):
    """How sets are dealt, by size interval: its upper end, partitions, partitions that may be weak, least shingles of a key."""

    ends: np.ndarray
    parts: np.ndarray
    slack: np.ndarray
    least: np.ndarray


def scheme(num: int, den: int, most: int) -> Scheme:
    """The dealing for sets of up to `most` shingles. Two linked sets are in one interval or in neighbouring ones, and sets
    of an interval and the next differ in at most D shingles. Of D // 2 + 1 + slack partitions, 1 + slack have at most one of
    these; slack and the least size of a key are chosen so that a set of the interval rarely has more weak partitions."""
    ends, low = [], 1
    while low <= most:
        ends.append(low * den // num)
        low = ends[-1] + 1
    ends.append(low * den // num)
    parts, slack, least = [], [], []
    low = 1
    for top in ends:
        differ = (top + top * den // num) * (den - num) // (den + num)
        best = (-1, 0.0, 0, 0)
        base = differ // 2 + 1
        for s in sorted({-(-base * f // 20) for f in (0, 2, 4, 6, 8)}) if differ else ():
            trials = max(16, min(400, 40_000 // low))
            cells = np.random.default_rng(low).multinomial(low, np.full((base + s) * SUBPARTS, 1 / ((base + s) * SUBPARTS)), trials).reshape(trials, base + s, SUBPARTS)
            sure = cells.sum(2) - cells.max(2)
            good = {m: float(((sure < m).sum(1) <= s).mean()) for m in range(1, int(sure.max()) + 2)}
            m = max((m for m, g in good.items() if g >= 0.85), default=0)
            best = max(best, (m, good[max(m, 1)] if not m else 1.0, -s, 0))
        parts.append(base - best[2] if differ else 0)
        slack.append(-best[2])
        least.append(max(1, best[0]))
        low = top + 1
    return Scheme(*(np.array(x, np.int64) for x in (ends, parts, slack, least)))


def keys_of(values: np.ndarray, begin: np.ndarray, num: int, den: int, dealt: Scheme, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) such that two linked, different sets share a key, which is never of an empty content.

    A dealing puts shingles in partitions of three parts. A key is a partition's content without one of its parts: where a
    partition has at most one difference, one such content is equal in both sets. A partition is weak if any of its keys has
    fewer shingles than the interval's least. A set with no more weak partitions than the slack shares a key of enough
    shingles with every set that it links with. Other sets are dealt once more, by another seed, and again; as a set uses
    all dealings up to its first good one, two sets have the earlier of theirs in common. A set without a good dealing also
    gives its first shingles by hash, of which linked sets share one. Each set is dealt for its own size interval and the one
    below. common: shingles that other sets have too; a key with another one in it can't be shared and is left out."""
    sizes = np.diff(begin)
    own = np.searchsorted(dealt.ends, sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    alone = np.zeros(len(values), bool) if common is None else ~common
    out, last = [], np.zeros(len(sizes), bool)
    for below in (0, 1):
        config = np.maximum(own - below, 0)
        use = (own - below >= 0) & (dealt.parts[config] > 0) & (sizes > 0)
        for seed in range(SEEDS):
            if not use.any():
                break
            keep = use[of]
            v, o = values[keep], of[keep]
            parts = np.where(use, dealt.parts[config], 0)
            base = np.append(0, np.cumsum(parts))
            n = base[-1]
            cell = (mix64(v + _U(5 + 1000 * seed)) >> _U(32)) * (parts[o] * SUBPARTS).astype(_U) >> _U(32)
            flat = base[o] * SUBPARTS + cell.astype(np.int64)
            total = np.zeros(n * SUBPARTS, _U)
            np.add.at(total, flat, mix64(v + _U(9)))
            total = total.reshape(n, SUBPARTS)
            count = np.bincount(flat, minlength=n * SUBPARTS).reshape(n, SUBPARTS)
            lone = np.bincount(flat[alone[keep]], minlength=n * SUBPARTS).reshape(n, SUBPARTS)
            total = total.sum(1, dtype=_U)[:, None] - total
            count = count.sum(1)[:, None] - count
            lone = lone.sum(1)[:, None] - lone
            holder = np.repeat(np.arange(len(sizes)), parts)
            least = dealt.least[config[holder]]
            weak = np.bincount(holder[count.min(1) < least], minlength=len(sizes))
            number = (np.arange(n) - base[holder])[:, None] * SUBPARTS + np.arange(SUBPARTS)
            name = mix64((number * SEEDS + seed).astype(_U) * _U(0x9E3779B97F4A7C15) + config[holder].astype(_U)[:, None])
            key = mix64(total + name + count.astype(_U))
            stay = (count >= least[:, None]) & (lone == 0)
            out.append((key[stay], np.broadcast_to(holder[:, None], stay.shape)[stay]))
            use &= weak > dealt.slack[config]
        last |= use
    if last.any():
        some = np.flatnonzero(last)
        order = np.lexsort((mix64(values + _U(31)), of))
        order = order[last[of[order]]]
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        first = order[(rank <= (sizes - -(-sizes * num // den))[of[order]]) & ~alone[order]]
        out.append((mix64(values[first] + _U(33)), of[first]))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest node, and edges from other nodes of a key to it."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    hub = np.repeat(node[first], np.diff(np.append(first, len(key))))
    edge = np.unique(np.column_stack([node[node != hub], hub[node != hub]]), axis=0)
    return key[first], node[first], edge[:, 0], edge[:, 1]


def set_digests(docs: DataFrame, k: int) -> DataFrame:
    """id, n (distinct shingles), h1 and h2 (sums over the set): equal for equal sets only, but for 128-bit chance."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, parts = frame["text"].tolist(), []
            for a, b in parts_of(texts):
                values, begin = shingles_of(texts[a:b], k)
                sums = [np.append(_U(0), np.cumsum(mix64(values + _U(j)))) for j in (21, 22)]
                parts.append([np.diff(begin), *((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums)])
            n, h1, h2 = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            yield pd.DataFrame({"id": frame["id"], "n": n, "h1": h1, "h2": h2})

    return map_rows(docs, run, "id {id}, n long, h1 long, h2 long")


def _sets_of(rows: pd.DataFrame, chosen: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers, shingles and where each set begins, of the rows that `chosen` (id, h1) names, each once."""
    rows = rows[rows["id"].isin(chosen["id"])]
    rows = rows.assign(h1=0).sort_values("id", kind="stable")
    texts, parts = rows["text"].tolist(), []
    for a, b in parts_of(texts):
        values, begin = shingles_of(texts[a:b], k)
        total = np.append(_U(0), np.cumsum(mix64(values + _U(21))))
        parts.append((values, np.diff(begin), (total[begin[1:]] - total[begin[:-1]]).view(np.int64)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(1, np.int64)
    values, size, h1 = (np.concatenate(x) for x in zip(*parts))
    ids, want = rows["id"].to_numpy(np.int64), dict(zip(chosen["id"].astype("int64"), chosen["h1"].astype("int64")))
    mine = np.array([want[i] == h for i, h in zip(ids.tolist(), h1.tolist())], bool)
    mine[np.flatnonzero(mine)[1:]] &= ids[mine][1:] != ids[mine][:-1]
    return ids[mine], values[np.repeat(mine, size)], np.append(0, np.cumsum(size[mine]))


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys: a bucket has a range of keys."""
    bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(keys) else []
    return ((int(bucket[a]), int(a), int(b)) for a, b in zip(edges, edges[1:]))


def common_shingles(frame: pd.DataFrame) -> pd.DataFrame:
    """Which of the shingles that chunks sent to a bucket are in two sets or more: as bits, to each chunk in its order."""
    keys = from_gaps(frame["k"], _U)
    size = [len(x) // 8 for x in frame["k"]]
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(frame["mask"], size)]).astype(bool)
    order = np.argsort(keys, kind="stable")
    new = np.append(True, keys[order[1:]] != keys[order[:-1]])
    start = np.flatnonzero(new)
    many = (np.diff(np.append(start, len(keys))) > 1) | np.logical_or.reduceat(several[order], start)
    several[order] = many[np.cumsum(new) - 1]
    ends = np.cumsum(size)
    return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "mask": [np.packbits(several[e - n : e]).tobytes() for e, n in zip(ends, size)]})


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_rows: int = ROWS, chunk_bytes: int = CHUNK) -> DataFrame:
    """Per input row: id_col, n_shingles, component_id: the smallest identifier reachable by links.

    Two rows link when the Jaccard similarity of their sets of k-word shingles is num/den or more. Words are lower-cased
    (A-Z) and split at ASCII white space; a text of fewer words is one shingle; one without words links with nothing.

    1. Equal sets become one, by the smallest identifier. 2. Chunks of documents send their distinct shingles to buckets, which
    say which are in several sets: a set with too few of these to reach the similarity links with nothing and is done. 3. Keys
    by which the other linked sets must meet are dealt to buckets; a task sends each key once, so that a key of a third of all
    sets stays small. Sets that meet, by their components, are candidates. 4. A candidate component is dealt to blocks (of
    about `block` shingles or `block_rows` sets at most), its smallest set to all of them; in each, an R-tree of count vectors
    and exact checks find the links. 5. Sets that are not in the smallest set's class are searched for those of other
    blocks, again by R-trees. Two sets of that class need no comparison, so a large group of copies costs its length.
    Every link counts, none is sampled.

    A null text has no words; rows with a null identifier have no component (null) and link with nothing; rows of one
    identifier count as one document if equal, and each by itself otherwise; an empty table gives an empty result; other
    columns of docs play no part."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = stored(set_digests(rows, k), "sets")
    same = ["n", "h1", "h2"]
    reps = sets.where("n > 0 AND id IS NOT NULL").groupBy(F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt"), *same).agg(F.min("id").alias("rep")).groupBy(*same).agg(F.min("rep").alias("rep"))
    reps = stored(reps, "representatives")
    sums = reps.agg(F.sum("n").alias("s"), F.max("n").alias("m")).collect()[0]
    dealt_by = scheme(num, den, sums.m or 1)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0].n or 0
    chunks = max(1, -(-size // chunk_bytes))
    buckets = max(1, int((sums.s or 0) * 0.5) // KEYS + 1)
    short = _U(64 - min(64, max(BITS, int(sums.s or 0).bit_length() + SPARE)))

    def in_chunk(of: str):
        return F.pmod(F.xxhash64(of), F.lit(chunks)).cast("int").alias("chunk")

    texts = rows.where("id IS NOT NULL").select(in_chunk("id"), "id", "text")
    # a representative is known by its identifier and content, as one identifier may come with several texts
    chosen = reps.select(in_chunk("rep"), F.col("rep").alias("id"), "h1")

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _, values, _ = _sets_of(left, right, k)
        keys, count = np.unique(values, return_counts=True)
        chunk = int(right["chunk"].iloc[0]) if len(right) else 0
        out = [(b, chunk, gaps(keys[x:y] >> short), np.packbits(count[x:y] > 1).tobytes()) for b, x, y in _by_bucket(keys, chunks)]
        return pd.DataFrame(out, columns=["bucket", "chunk", "k", "mask"])

    def deal(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "k", "v", "id", "s"]
        replies = right[right["bucket"] >= 0].sort_values("bucket")
        ids, values, begin = _sets_of(left, right[right["bucket"] < 0], k)
        if not len(ids):
            return pd.DataFrame([], columns=columns)
        keys, at = np.unique(values, return_inverse=True)
        bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=y - x) for m, (_, x, y) in zip(replies["mask"], _by_bucket(keys, chunks))]
        common = np.concatenate(bits).astype(bool)[at]
        many = np.append(0, np.cumsum(common))
        size = np.diff(begin)
        stay = den * (many[begin[1:]] - many[begin[:-1]]) >= num * size
        keep = np.repeat(stay, size)
        ids, values, common, begin = ids[stay], values[keep], common[keep], np.append(0, np.cumsum(size[stay]))
        if not len(ids):
            return pd.DataFrame([], columns=columns)
        key, of = keys_of(values, begin, num, den, dealt_by, common)
        key, node, a, b = _stars(key, ids[of])
        out = [(-1, planes(a), planes(b), None, None)]
        out += [(t, planes(key[x:y]), planes(node[x:y]), None, None) for t, x, y in _by_bucket(key, buckets)]
        out += [(None, None, None, int(i), values[x:y].tobytes()) for i, x, y in zip(ids, begin, begin[1:])]
        return pd.DataFrame(out, columns=columns, dtype=object).assign(bucket=exact(r[0] for r in out), id=exact(r[3] for r in out))

    asked = texts.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInPandas(ask, "bucket int, chunk int, k binary, mask binary")
    replies = asked.groupBy("bucket").applyInPandas(common_shingles, "chunk int, bucket int, mask binary")
    # no nulls: pandas would make the 64-bit numbers floating-point
    told = chosen.select("chunk", "id", "h1", F.lit(-1).alias("bucket"), F.lit(b"").alias("mask")).union(replies.select("chunk", F.lit(0).cast("long"), F.lit(0).cast("long"), "bucket", "mask"))
    sent = stored(texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(deal, "bucket int, k binary, v binary, id long, s binary"), "keys")
    dealt = sent.where("bucket IS NOT NULL").select("bucket", "k", "v")
    shingle_sets = sent.where("id IS NOT NULL").select("id", "s")

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] < 0:
            return pd.DataFrame({"a": from_planes(frame["k"], np.int64), "b": from_planes(frame["v"], np.int64)})
        _, _, a, b = _stars(from_planes(frame["k"], _U), from_planes(frame["v"], np.int64))
        return pd.DataFrame({"a": a, "b": b})

    # edges that a task knows by itself (bucket -1) need no meeting: they are spread by content
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("k", "v"), F.lit(buckets)) - buckets).otherwise(F.col("bucket")).cast("int")
    edges = dealt.withColumn("bucket", spread).groupBy("bucket").applyInPandas(meet, "a long, b long")
    near = components(edges)
    weighed = near.join(reps.select(F.col("rep").alias("node"), "n"), "node")

    def blocks_of(frame: DataFrame, name: str) -> DataFrame:
        many = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int")
        return frame.groupBy("component").agg(many.alias(name))

    def placed(of: str, name: str):
        return F.pmod(F.xxhash64(of, F.lit(3)), F.col(name)).cast("int")

    where = stored(weighed.join(blocks_of(weighed, "blocks"), "component").select(F.col("node").alias("id"), "component", "n", "blocks", placed("node", "blocks").alias("block")), "candidates")

    def sets_in(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(frame["s"]), _U), np.append(0, np.cumsum([len(x) // 8 for x in frame["s"]]))

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(frames, ["component", "place"]):
            ids, pivot = group["id"].to_numpy(np.int64), int(group["component"].iloc[0])
            root = ids[classes(*sets_in(group), num, den)]
            out = group[["component", "block", "id", "n"]].assign(root=root)
            yield out[(ids != pivot) | (group["block"] == group["place"]).to_numpy()]

    # the smallest set goes to every block of its component
    everywhere = F.when(F.col("id") == F.col("component"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    members = shingle_sets.join(where, "id").withColumn("place", F.explode(everywhere))
    in_blocks = members.select("component", "place", "block", "id", "n", "s").repartition("component", "place").sortWithinPartitions("component", "place", "id")
    first = stored(in_blocks.mapInPandas(link, "component long, block int, id long, n long, root long"), "links")
    # sets outside their component's first class, where other blocks may hold links for them
    open_ = first.join(where.where("blocks > 1").select("component", "blocks").distinct(), "component")
    probes = open_.where("root <> component")
    if probes.limit(1).count():
        turns = blocks_of(probes, "turns")
        all_ = stored(open_.join(turns, "component").withColumn("probe", F.col("root") != F.col("component")).withColumn("turn", F.when(F.col("probe"), placed("id", "turns"))), "open")
        loaded = shingle_sets.join(all_.select("id", "component", "block", "blocks", "turn", "turns"), "id")
        as_target = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: F.struct(t.alias("t"), F.col("block").alias("b"), F.lit(False).alias("p")))
        as_probe = F.when(F.col("turn").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.col("turn").alias("t"), b.alias("b"), F.lit(True).alias("p"))))
        tasks = loaded.withColumn("task", F.explode(F.concat(as_target, F.coalesce(as_probe, F.array().cast("array<struct<t:int,b:int,p:boolean>>"))))).select("component", "task.*", "block", "id", "s", (F.col("turn").isNull()).alias("known"))

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group in groups_of(frames, ["component", "t", "b"]):
                group = group.sort_values(["p", "id"], ascending=[False, True]).drop_duplicates("id")
                ids, here = group["id"].to_numpy(np.int64), (group["block"] == group["b"]).to_numpy()
                if here.all():
                    continue
                root = ids[classes(*sets_in(group), num, den, group["known"].to_numpy(bool), group["p"].to_numpy(bool), here)]
                yield pd.DataFrame({"a": ids[root != ids], "b": root[root != ids]})

        more = tasks.repartition("component", "t", "b").sortWithinPartitions("component", "t", "b").mapInPandas(search, "a long, b long")
        found = components(first.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
    else:
        found = first.select(F.col("id").alias("node"), F.col("root").alias("component"))
    rooted = reps.join(found, reps["rep"] == found["node"], "left").select(*(F.col(c).alias(f"_{c}") for c in same), F.coalesce("component", "rep").alias("component"))
    s, r = sets.alias("s"), rooted.alias("r")
    on = (F.col("s.n") == F.col("r._n")) & (F.col("s.h1") == F.col("r._h1")) & (F.col("s.h2") == F.col("r._h2")) & F.col("s.id").isNotNull()
    return s.join(r, on, "left").select(F.col("s.id").alias(id_col), F.col("s.n").alias("n_shingles"), F.coalesce("r.component", "s.id").alias("component_id"))
