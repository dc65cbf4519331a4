"""Removal of byte strings that repeat across documents, by a depth-limited radix sort of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact, from_planes, mix64, planes

WINDOW, SLICE, CHUNK = 50, 1 << 19, 8 << 20
#: A k-gram that more chunks than this send with different stretches is compared by hashes of whole windows.
HOT = 256
_U = np.uint64
_ODD = mix64(np.arange(1, 5, dtype=np.uint64)) | _U(1)
_VALUES = [mix64(np.arange(256, dtype=np.uint64) + _U(1000 * (j + 1))) for j in range(2)]
MIXED = 0
DECIDED, COLD, SPREAD = 0, 1, 2
NONE = np.iinfo(np.int64).max


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    up, down = np.full(n + 1, base, _U), np.full(n + 1, pow(int(base), -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Sums:
    """Prefix sums of a byte string by which any part's 64-bit polynomial hash takes constant time."""

    _kept: dict = {}

    def __init__(self, data: np.ndarray, j: int):
        n = len(data)
        if j not in self._kept or len(self._kept[j][0]) <= n:
            self._kept[j] = _powers(int(_ODD[j]), max(n, SLICE + 4096))
        up, self.down = self._kept[j]
        self.total = np.zeros(n + 1, _U)
        np.cumsum(_VALUES[j][data] * up[:n], out=self.total[1:])

    def all(self, width: int) -> np.ndarray:
        n = len(self.total) - width
        return (self.total[width:] - self.total[:n]) * self.down[:n]

    def part(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(_U))


def _leftmost_min(value: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of its first smallest one, by runs of doubling length."""
    v, at, size = value, np.arange(len(value), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        n = len(v) - step
        left = v[:n] <= v[step:]
        at = np.where(left, at[:n], at[step:])
        v = np.where(left, v[:n], v[step:])
        size += step
    return at


class Chunk:
    """The windows of some documents, dealt to anchors.

    The anchor of a window is its first k-gram of smallest hash: equal windows have the same anchor at the same place. The
    windows of one anchor start next to each other, from first to last. The radix sort's digits are taken in this order:
    the anchor's k-gram (digit 1), the stretch of bytes under all windows of the anchor (digit 2), the whole window
    (digit 3). A group whose windows are all in one document, or whose stretches are all equal, needs no further digit."""

    def __init__(self, ids: list, texts: list[bytes], window: int):
        self.ids, self.texts, self.window = np.array(ids, np.int64), texts, window
        self.k = max(1, window * 2 // 5)
        self.slices: list[tuple] = []
        parts = [self._anchors(*s) for s in self._cut()]
        names = ("slice", "doc", "first", "last", "anchor", "gram", "stretch")
        self.slice, self.doc, self.first, self.last, self.anchor, self.gram, self.stretch = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, _U if i > 4 else np.int64) for i in range(len(names)))
        # the anchors by k-gram: per group its smallest document, and its stretch or MIXED
        self.grams, self.group = np.unique(self.gram, return_inverse=True)
        self.grams = self.grams.astype(_U)
        order = np.argsort(self.group, kind="stable")
        self.starts = np.searchsorted(self.group[order], np.arange(len(self.grams)))
        if len(order):
            st = self.stretch[order].astype(_U)
            low, high = np.minimum.reduceat(st, self.starts), np.maximum.reduceat(st, self.starts)
            self.one = np.where(low == high, low, _U(MIXED))
            self.least = np.minimum.reduceat(self.ids[self.doc[order]], self.starts)
            self.most = np.maximum.reduceat(self.ids[self.doc[order]], self.starts)
        else:
            self.one, self.least, self.most = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cut(self) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Parts of documents that are worked on at once: (doc, from, to), windows that start there; about SLICE bytes."""
        now, size = [], 0
        for d, text in enumerate(self.texts):
            n = len(text) - self.window + 1
            for a in range(0, max(n, 0), SLICE):
                b = min(n, a + SLICE)
                now.append((d, a, b))
                size += b - a + self.window
                if size >= SLICE:
                    self.slices.append(now)
                    yield len(self.slices) - 1, now
                    now, size = [], 0
        if now:
            self.slices.append(now)
            yield len(self.slices) - 1, now

    def _bytes(self, part: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """The part's bytes put end to end, and where each piece begins."""
        pieces = [self.texts[d][a : b + self.window - 1] for d, a, b in part]
        begin = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=begin[1:])
        return np.frombuffer(b"".join(pieces), np.uint8), begin

    def _anchors(self, number: int, part: list[tuple[int, int, int]]) -> tuple:
        data, begin = self._bytes(part)
        sums, k, w = Sums(data, 0), self.k, self.window
        gram = sums.all(k)
        at = _leftmost_min(((gram * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32), w - k + 1)
        count = np.array([b - a for _, a, b in part])
        valid = np.concatenate([np.arange(x, x + n) for x, n in zip(begin, count)])
        at = at[valid]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        i = np.flatnonzero(new)
        first, last = valid[i], valid[np.append(i[1:], len(at)) - 1]
        piece = np.searchsorted(begin, first, "right") - 1
        a = at[i]
        stretch = np.maximum(mix64(sums.part(first, last + w) + (a - first).astype(_U)), _U(MIXED + 1))
        shift = np.array([x for _, x, _ in part])[piece] - begin[piece]
        doc = np.array([d for d, _, _ in part])[piece]
        return np.full(len(i), number), doc, first + shift, last + shift, a + shift, mix64(gram[a]), stretch

    def windows(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(doc, start, two hashes) of all windows of the marked anchors, part by part."""
        for number in np.unique(self.slice[which]):
            part = self.slices[number]
            data, begin = self._bytes(part)
            sums = [Sums(data, j) for j in (0, 1)]
            mine = np.flatnonzero(which & (self.slice == number))
            n = self.last[mine] - self.first[mine] + 1
            doc = np.repeat(self.doc[mine], n)
            start = np.repeat(self.first[mine] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            # a document may have several pieces in a part: the piece is found by document and place
            origin = np.array([d * (1 << 40) + a for d, a, _ in part])
            piece = np.searchsorted(origin, doc * (1 << 40) + start, "right") - 1
            p = start - np.array([a for _, a, _ in part])[piece] + begin[piece]
            yield doc, start, sums[0].part(p, p + self.window), sums[1].part(p, p + self.window)

    def undecided(self, grams: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Per anchor: COLD or SPREAD where its k-gram occurs in several documents with several stretches, so that windows
        must be compared; else DECIDED. grams and state: the reply on what other chunks have."""
        there = np.zeros(len(self.grams), np.int8)
        elsewhere = np.isin(self.grams, grams)
        there[elsewhere] = state[np.searchsorted(grams, self.grams[elsewhere])]
        there[~elsewhere & (self.one == MIXED) & (self.least < self.most)] = COLD
        return there[self.group] if len(self.group) else np.zeros(0, np.int8)

    def stretches(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (k-gram, stretch) of the marked anchors, sorted: for each an anchor of its smallest document; and
        for each marked anchor which of them it has, and whether it is in that document."""
        at = np.flatnonzero(which)
        order = np.lexsort((self.ids[self.doc[at]], self.stretch[at], self.gram[at]))
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = (self.gram[at[1:]] != self.gram[at[:-1]]) | (self.stretch[at[1:]] != self.stretch[at[:-1]])
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        rep = at[new]
        marked = np.flatnonzero(which)
        return rep, number, self.ids[self.doc[marked]] == self.ids[self.doc[rep[number]]] if len(rep) else np.zeros(0, bool)

    def least_of(self, grams: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Each anchor's smallest document with its k-gram, other chunks' among them."""
        own = self.least.copy()
        elsewhere = np.isin(self.grams, grams)
        own[elsewhere] = np.minimum(own[elsewhere], least[np.searchsorted(grams, self.grams[elsewhere])])
        return own[self.group] if len(self.group) else np.zeros(0, np.int64)


def _unique_windows(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, hash) and the smallest document of each, sorted."""
    if not found:
        return np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
    a, b, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((d, b, a))
    a, b, d = a[order], b[order], d[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep], d[keep]


def _dealt(kind: int, chunk: int, buckets: int, key: np.ndarray, v: np.ndarray, d: np.ndarray, shape: np.ndarray | None = None, texts: list[bytes] = ()) -> pd.DataFrame:
    """Sorted keys and their columns as packed rows, one for each bucket: a bucket has a range of keys."""
    bucket = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    ends = np.flatnonzero(np.append(np.diff(bucket) != 0, True)) + 1 if len(key) else np.zeros(0, np.int64)
    shape = np.zeros((len(key), 0), np.uint16) if shape is None else shape
    rows, a = [], 0
    for b in ends:
        rows.append((kind, int(bucket[a]), chunk, planes(key[a:b]), planes(v[a:b]), planes(d[a:b]), shape[a:b].tobytes(), b"".join(texts[a:b])))
        a = b
    return pd.DataFrame(rows, columns=_COLUMNS)


_COLUMNS = ["kind", "bucket", "chunk", "k", "v", "d", "shape", "texts"]
_SENT = "kind int, bucket int, chunk int, k binary, v binary, d binary, shape binary, texts binary"
_REPLY = "chunk int, kind int, bucket int, k binary, v binary, d binary"


def compare_windows(frame: pd.DataFrame, window: int, width: int) -> pd.DataFrame:
    """Stretches of one bucket's k-grams, compared window by window: for each stretch, bit i says that its window i also
    starts in a document smaller than the stretch's own. Back to each chunk in the order it asked.

    The windows are sorted by radix passes of eight bytes, from the most significant: k-gram and place about the
    anchor first, then byte after byte up to the window's length. After each pass, windows that are alone, or whose
    group is of one document, are left out."""
    gram, doc = from_planes(frame["k"], _U), from_planes(frame["d"], np.int64)
    shape = np.frombuffer(b"".join(frame["shape"]), np.uint16).reshape(-1, 2).astype(np.int64)
    data = np.frombuffer(b"".join(frame["texts"]) + bytes(8), np.uint8)
    count = shape[:, 0] - window + 1
    begin = np.append(0, np.cumsum(shape[:, 0])[:-1])
    of = np.repeat(np.arange(len(gram)), count)
    inner = np.arange(len(of)) - np.repeat(np.append(0, np.cumsum(count)[:-1]), count)
    at, who = begin[of] + inner, doc[of]
    _, group = np.unique(gram, return_inverse=True)
    group = group[of] * (2 * width + 2) + (inner - shape[of, 1] + width)
    live = np.arange(len(of))
    words = np.lib.stride_tricks.sliding_window_view(data, 8) if len(data) >= 8 else None
    for depth in range(-8, window, 8):
        if depth >= 0:  # eight bytes as a number; the last pass overlaps the one before so that it ends with the window
            d = min(depth, window - 8) if window >= 8 else 0
            digit = np.ascontiguousarray(words[at[live] + d]).view(">u8").ravel()
            if window < 8:
                digit = digit >> np.uint64(8 * (8 - window))
            order = np.lexsort((digit, group))
            group, digit, live = group[order], digit[order], live[order]
            new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])) if len(live) else np.zeros(0, bool)
        else:
            order = np.argsort(group, kind="stable")
            group, live = group[order], live[order]
            new = np.append(True, group[1:] != group[:-1]) if len(live) else np.zeros(0, bool)
        if not len(live):
            break
        start = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        low, high = np.minimum.reduceat(who[live], start), np.maximum.reduceat(who[live], start)
        several = (low < high)[number]
        group, live = number[several], live[several]
    bits = np.zeros((len(gram), -(-width // 8) * 8), np.uint8)
    if len(live):
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        low = np.repeat(np.minimum.reduceat(who[live], start), np.diff(np.append(start, len(live))))
        hit = live[who[live] > low]
        bits[of[hit], inner[hit]] = 1
    masks = np.packbits(bits, axis=1)
    ends = np.cumsum([len(x) // 8 for x in frame["k"]])
    rows = [(int(c), COLD, int(b), masks[e - len(k) // 8 : e].tobytes(), b"", b"") for c, b, k, e in zip(frame["chunk"], frame["bucket"], frame["k"], ends)]
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "k", "v", "d"])


def _answers(frame: pd.DataFrame, kind: int, hot: int = HOT) -> pd.DataFrame:
    """The keys that several chunks sent, back to each of them, with the smallest document, and for k-grams (kind 0)
    whether their stretches differ (COLD, or SPREAD where more than `hot` chunks sent it) or not (DECIDED). A chunk sends a key once, so a key has at most as many rows as there are chunks."""
    k, v, d = from_planes(frame["k"], _U), from_planes(frame["v"], _U), from_planes(frame["d"], np.int64)
    of = np.repeat(np.arange(len(frame)), [len(x) // 8 for x in frame["k"]])
    order = np.lexsort((of, v, k) if kind else (of, k))
    k, v, d, of = k[order], v[order], d[order], of[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | ((v[1:] != v[:-1]) if kind else False)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(k)))
    least = np.minimum.reduceat(d, start)
    extra = v[start] if kind else np.where((np.minimum.reduceat(v, start) != np.maximum.reduceat(v, start)) | (np.minimum.reduceat(v, start) == MIXED), np.where(size > hot, SPREAD, COLD), DECIDED).astype(_U)
    group = np.repeat(np.arange(len(start)), size)
    many = (size > 1)[group]
    g, of = group[many], of[many]
    order = np.argsort(of, kind="stable")
    g, of = g[order], of[order]
    chunk = frame["chunk"].to_numpy()
    rows, a = [], 0
    for b in (np.flatnonzero(np.append(np.diff(of) != 0, True)) + 1 if len(of) else ()):
        x = g[a:b]
        rows.append((int(chunk[of[a]]), kind, 0, planes(k[start[x]]), planes(extra[x]), planes(least[x])))
        a = b
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "k", "v", "d"])


def _reply(frame: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mine = frame[frame["kind"] == kind]
    k, v, d = from_planes(mine["k"], _U), from_planes(mine["v"], _U), from_planes(mine["d"], np.int64)
    order = np.lexsort((v, k))
    return k[order], v[order], d[order]


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, hot: int = HOT) -> DataFrame:
    """Per input row: id_col, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay).

    Removed is each byte under a string of `window` bytes that also starts in a document of a smaller identifier; strings
    are those of the input. Documents are dealt to chunks by a hash of their identifier. Two rounds of packed keys decide:
    first each chunk's distinct k-grams of anchors, then, of the k-grams that occur with different stretches, each chunk's
    distinct stretches, whose windows are radix-sorted byte by byte. As a chunk sends a key once, a passage that a third of
    all documents share weighs no more than any other; a k-gram that more than `hot` chunks have in different
    surroundings is not gathered: the hashes of its windows are dealt to all buckets. A stretch counts as equal by a
    128-bit hash (with its k-gram), and so do those windows.

    A null text is empty; rows with a null identifier stay whole and count for no other; rows with one identifier are one
    document for the rule and are cut alike; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("body"))
    rows = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "body")  # without nulls, Python gets whole numbers
    size = rows.agg(F.sum(F.length("body")).alias("n")).collect()[0].n or 0
    n = max(1, -(-size // chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(F.when(F.col("known"), F.col("id")).otherwise(F.xxhash64("body"))), F.lit(n)).cast("int"))

    def loaded(frame: pd.DataFrame) -> Chunk:
        known = frame[frame["known"]]
        return Chunk(known["id"].tolist(), known["body"].tolist(), window)

    def ask_grams(frame: pd.DataFrame) -> pd.DataFrame:
        c = loaded(frame)
        return _dealt(0, int(frame["chunk"].iloc[0]), n, c.grams, c.one, c.least)

    def ask_more(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=_COLUMNS)
        c, number = loaded(left), int(left["chunk"].iloc[0])
        grams, state, _ = _reply(right, 0)
        state = c.undecided(grams, state)
        rep, _, _ = c.stretches(state == COLD)
        shape = np.column_stack([c.last[rep] - c.first[rep] + window, c.anchor[rep] - c.first[rep]]).astype(np.uint16)
        texts = [c.texts[d][a : b + window] for d, a, b in zip(c.doc[rep], c.first[rep], c.last[rep])]
        cold = _dealt(COLD, number, n, c.gram[rep], c.stretch[rep], c.ids[c.doc[rep]], shape, texts)
        a, b, d = _unique_windows([(x, y, c.ids[doc]) for doc, _, x, y in c.windows(state == SPREAD)])
        spread = _dealt(SPREAD, number, n, a, b, d)
        return pd.concat([x for x in (cold, spread) if len(x)]) if len(cold) or len(spread) else cold

    def cut(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])
        c = loaded(left)
        grams, state, least = _reply(right, 0)
        state = c.undecided(grams, state)
        whole = state == SPREAD
        marks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def mark(doc, begin, end):
            order = np.argsort(doc, kind="stable")
            doc, begin, end = doc[order], begin[order], end[order]
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else []
            for x, y in zip(at, np.append(at[1:], len(doc)) if len(doc) else []):
                marks.setdefault(int(doc[x]), []).append((begin[x:y], end[x:y]))

        hit = (state == DECIDED) & (c.ids[c.doc] > c.least_of(grams, least)) if len(c.doc) else np.zeros(0, bool)
        mark(c.doc[hit], c.first[hit], c.last[hit] + window)
        cold = np.flatnonzero(state == COLD)
        if len(cold):
            rep, number, owner = c.stretches(state == COLD)
            masks = right[right["kind"] == COLD].sort_values("bucket")["k"]
            bits = np.unpackbits(np.frombuffer(b"".join(masks), np.uint8).reshape(len(rep), -1), axis=1)
            other = cold[~owner]
            mark(c.doc[other], c.first[other], c.last[other] + window)
            i, j = np.nonzero(bits[number[owner]])
            mine = cold[owner][i]
            mark(c.doc[mine], c.first[mine] + j, c.first[mine] + j + window)
        found = list(c.windows(whole)) if whole.any() else []
        own = _unique_windows([(x, y, c.ids[doc]) for doc, _, x, y in found])
        a, b, d = _unique_windows([own, _reply(right, SPREAD)])
        for doc, start, x, y in found:
            pos = _places(a, b, x, y)
            hit = c.ids[doc] > d[pos]
            mark(doc[hit], start[hit], start[hit] + window)
        out, row = [], 0
        for i, known, body in zip(left["id"].tolist(), left["known"], left["body"]):
            spans, kept = 0, body
            if known:
                if row in marks:
                    edge = np.zeros(len(body) + 1, np.int32)
                    for begin, end in marks[row]:
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, end, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                row += 1
            out.append((i if known else None, len(body), len(body) - len(kept), spans, kept))
        return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"], dtype=object).assign(id=exact(r[0] for r in out))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["kind"].iloc[0] == SPREAD:
            return _answers(frame, SPREAD)
        return compare_windows(frame, window, window)

    asked = dealt.groupBy("chunk").applyInPandas(ask_grams, _SENT)
    grams = asked.select("bucket", "chunk", "k", "v", "d").groupBy("bucket").applyInPandas(lambda f: _answers(f, 0, hot), _REPLY)
    asked = dealt.groupBy("chunk").cogroup(grams.groupBy("chunk")).applyInPandas(ask_more, _SENT)
    windows = asked.groupBy("kind", "bucket").applyInPandas(compare, _REPLY)
    done = dealt.groupBy("chunk").cogroup(grams.unionByName(windows).groupBy("chunk")).applyInPandas(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", id_col)


def _places(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the pairs (x, y) are in the sorted pairs (a, b), all of which are there."""
    at = np.searchsorted(a, x)
    # equal first hashes with different second ones hardly occur; where they do, the pair is found one by one
    wrong = np.flatnonzero(b[np.minimum(at, len(b) - 1)] != y)
    for i in wrong:
        while b[at[i]] != y[i]:
            at[i] += 1
    return at
