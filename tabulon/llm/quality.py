"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, mix64, parts_of, placed_words

#: Labelled rows that are read to fit the model, at most: those of the smallest hash of their identifier.
SAMPLE = 12_000
#: Hashed words have 2**BITS places; each feature has FACTORS latent numbers.
BITS, FACTORS = 16, 8
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.08, 2e-4

#: Classes of bytes whose shares of a text are statistics.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\x0b\x0c", "line": b"\n\r", "stop": b".!?", "comma": b",;:", "quote": b"\"'()[]{}", "sign": b"#$%&*+-/<=>@\\^_`|~"}
CLASS = np.full(256, len(CLASSES), np.uint8)  # the last class: control bytes and all beyond ASCII
for _i, _c in enumerate(CLASSES.values()):
    CLASS[list(_c)] = _i
STATS = [*CLASSES, "other", "bytes", "words", "word_bytes", "distinct", "plain_words", "shouted", "ends_sign", "lines", "line_words", "same_lines", "repeats"]


@dataclass
class Machine:
    """Weights of a factorisation machine: a bias, a weight and FACTORS numbers a feature. Hashed words come first, then the
    statistics and the metadata, which are put on one scale by mean and deviation."""

    bias: float
    weight: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray


def _shares(part: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text how many of its entries are in each class."""
    kinds, n = len(CLASSES) + 1, len(starts) - 1
    text = np.repeat(np.arange(n), np.diff(starts))
    return np.bincount(text * kinds + part, minlength=n * kinds).reshape(n, kinds).astype(np.float64)


def features_of(texts: Sequence[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole texts: the places of their distinct hashed words, their values (1 + log of the count, a text's of length 1),
    where each text's begin, and STATS."""
    data, starts = joined(texts)
    n = len(starts) - 1
    hashes, first, begin, length = placed_words(data, starts)
    words = np.diff(first)
    text = np.repeat(np.arange(n, dtype=np.uint64), words)
    key = (text << np.uint64(bits)) | (hashes >> np.uint64(64 - bits))
    key, count = np.unique(key, return_counts=True)
    place, owner = (key & np.uint64((1 << bits) - 1)).astype(np.int64), (key >> np.uint64(bits)).astype(np.int64)
    value = 1 + np.log(count)
    length2 = np.bincount(owner, value * value, minlength=n)
    value /= np.sqrt(length2)[owner]
    offset = np.searchsorted(owner, np.arange(n + 1))

    size = np.diff(starts) - 1.0  # without the blank that joined() puts behind each text
    kinds = _shares(CLASS[data], starts)
    kinds[:, list(CLASSES).index("blank")] -= 1
    some = np.maximum(size, 1.0)[:, None]
    kind = CLASS[data]
    last = kind[begin + length - 1] if len(begin) else np.zeros(0, np.uint8)
    named = list(CLASSES)
    text = text.astype(np.int64)
    per_word = lambda x: np.bincount(text, x, minlength=n) / np.maximum(words, 1)
    upper = np.concatenate([[0], np.cumsum(kind == named.index("upper"))])
    lower = np.concatenate([[0], np.cumsum(kind == named.index("lower"))])
    odd = np.concatenate([[0], np.cumsum((kind != named.index("upper")) & (kind != named.index("lower")) & (kind != len(CLASSES)))])
    end = begin + length
    shouted = (upper[end] - upper[begin] > 0) & (lower[end] == lower[begin]) & (length > 1)
    plain = odd[end] == odd[begin]

    breaks = np.flatnonzero(kind == named.index("line"))
    line_start = np.unique(np.concatenate([starts[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_text = np.searchsorted(starts, line_start, "right") - 1
    lines = np.bincount(line_text, minlength=n).astype(np.float64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes + np.uint64(1)), dtype=np.uint64)])  # a line's sum of word hashes
    at = np.searchsorted(begin, np.append(line_start, len(data)))
    sums = total[at[1:]] - total[at[:-1]]
    full = np.diff(at) > 0
    pair = np.unique(np.stack([line_text[full].astype(np.uint64), sums[full]]), axis=1)[0].astype(np.int64) if full.any() else np.zeros(0, np.int64)
    filled = np.bincount(line_text[full], minlength=n)
    distinct = np.bincount(owner, minlength=n) / np.maximum(words, 1)
    after = np.zeros(len(hashes), bool)
    after[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    stats = np.column_stack([kinds / some, np.log1p(size), np.log1p(words), per_word(length), distinct, per_word(plain), per_word(shouted), per_word(last == named.index("sign")), np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), (filled - np.bincount(pair, minlength=n)) / np.maximum(filled, 1), per_word(after)])
    return place, value.astype(np.float32), offset, np.nan_to_num(stats)


def _meta(columns: Sequence[np.ndarray]) -> np.ndarray:
    """Per metadata column log(1 + |x|) with x's sign, 0 where it is missing, and whether it is."""
    out = []
    for c in columns:
        gone = ~np.isfinite(c)
        c = np.where(gone, 0.0, c)
        out += [np.sign(c) * np.log1p(np.abs(c)), gone.astype(np.float64)]
    return np.column_stack(out) if out else np.zeros((0, 0))


def _sums(rows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, of none 0."""
    out = np.zeros((len(offset) - 1, *rows.shape[1:]), rows.dtype)
    some = np.flatnonzero(np.diff(offset))
    if len(some):
        out[some] = np.add.reduceat(rows, offset[some], axis=0)
    return out


def margin(m: Machine, place: np.ndarray, value: np.ndarray, offset: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The log odds of each text. All pairs' interactions by the identity: half of the square of the sum less the sum of
    squares, so the time is linear in the number of features. Entries are taken by blocks, to bound the memory."""
    words = m.weight.shape[0] - dense.shape[1]
    out = np.empty(len(offset) - 1)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(offset, offset[at] + (1 << 18), "right")) - 1)
        a, b = offset[at], offset[to]
        p, x, o = place[a:b], value[a:b, None], offset[at : to + 1] - a
        first = m.factors[p] * x
        s, q = _sums(first, o), _sums(first * first, o)
        d = dense[at:to]
        s += d @ m.factors[words:]
        q += (d * d) @ (m.factors[words:] ** 2)
        out[at:to] = m.bias + _sums(m.weight[p] * x[:, 0], o) + d @ m.weight[words:] + 0.5 * (s * s - q).sum(1)
        at = to
    return out


def learn(place: np.ndarray, value: np.ndarray, offset: np.ndarray, dense: np.ndarray, y: np.ndarray, bits: int = BITS, factors: int = FACTORS, seed: int = 7) -> Machine:
    """A factorisation machine by gradient steps of bounded size (AdaGrad) on the logistic loss."""
    rng, words, wide = np.random.default_rng(seed), 1 << bits, dense.shape[1]
    mean, deviation = (dense.mean(0), dense.std(0)) if len(dense) else (np.zeros(wide), np.ones(wide))
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(words + wide, np.float32), rng.normal(0, 0.05, (words + wide, factors)).astype(np.float32), mean, deviation)
    if len(y) < 2 or y.min() == y.max():  # one class or none: every text gets that class's share
        m.factors[:] = 0
        return m
    z = scaled(m, dense).astype(np.float32)
    gw, gv, gb = np.full(words + wide, 1e-3, np.float32), np.full((words + wide, factors), 1e-3, np.float32), 1e-3
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            n = offset[rows + 1] - offset[rows]
            o = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(offset[rows] - o[:-1], n) + np.arange(o[-1])
            p, x, owner, d = place[at], value[at], np.repeat(np.arange(len(rows)), n), z[rows]
            vx = m.factors[p] * x[:, None]
            s = _sums(vx, o) + d @ m.factors[words:]
            q = _sums(vx * vx, o) + (d * d) @ (m.factors[words:] ** 2)
            t = m.bias + _sums(m.weight[p] * x, o) + d @ m.weight[words:] + 0.5 * (s * s - q).sum(1)
            g = ((1 / (1 + np.exp(-np.clip(t, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            used, inverse = np.unique(p, return_inverse=True)
            gx = g[owner] * x
            dw = np.bincount(inverse, gx, minlength=len(used)).astype(np.float32)
            by_place = np.argsort(inverse, kind="stable")
            edge = np.concatenate([np.flatnonzero(np.diff(inverse[by_place], prepend=-1)), [len(inverse)]])
            dv = _sums((gx[:, None] * (s[owner] - vx))[by_place], edge)
            dense_w, dense_v = d.T @ g, d.T @ (g[:, None] * s) - ((d * d).T @ g)[:, None] * m.factors[words:]
            all_, dw, dv = np.concatenate([used, np.arange(words, words + wide)]), np.concatenate([dw, dense_w]), np.concatenate([dv, dense_v])
            dw += DECAY * m.weight[all_] / len(rows)
            dv += DECAY * m.factors[all_] / len(rows)
            gw[all_] += dw * dw
            gv[all_] += dv * dv
            gb += float(g.sum()) ** 2
            m.weight[all_] -= RATE * dw / np.sqrt(gw[all_])
            m.factors[all_] -= RATE * dv / np.sqrt(gv[all_])
            m.bias -= RATE * float(g.sum()) / gb**0.5
    return m


def scaled(m: Machine, dense: np.ndarray) -> np.ndarray:
    return np.clip((dense - m.mean) / m.deviation, -5, 5) * 0.5


def _dense(batch: pa.RecordBatch, a: int, b: int, stats: np.ndarray, metadata: int) -> np.ndarray:
    meta = _meta([batch.column(f"meta{i}").to_numpy(zero_copy_only=False)[a:b].astype(np.float64) for i in range(metadata)])
    return np.column_stack([stats, meta]) if metadata else stats


def _rows(docs: DataFrame, id_col: str, text_col: str, metadata: Sequence[str]) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).cast("double").alias(f"meta{i}") for i, c in enumerate(metadata)))


def fit(docs: DataFrame, labels: DataFrame, training: Column, metadata: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, bits: int = BITS, factors: int = FACTORS) -> Machine:
    """A model of label_col from labelled rows for which `training` holds (on id_col), at most `sample` of them.

    A label of several rows counts as its highest; rows with a null label or identifier aren't learned from. Texts become
    features on the executors; the driver gets at most 2**bits places of each sampled text, never texts."""
    chosen = labels.where(training & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = _rows(docs, id_col, text_col, metadata).join(F.broadcast(chosen), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in parts_of(texts):
                place, value, offset, stats = features_of(texts[a:b], bits)
                dense = _dense(batch, a, b, stats, len(metadata))
                cut = lambda x, kind: pa.array([x[i:j].astype(kind).tobytes() for i, j in zip(offset, offset[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a).cast(pa.string()), batch.column("y").slice(a, b - a), cut(place, "<u4"), cut(value, "<f4"), pa.array([r.tobytes() for r in dense.astype("<f8")], pa.binary())], ["id", "y", "place", "value", "dense"])

    got = rows.mapInArrow(count, "id string, y int, place binary, value binary, dense binary").collect()  # `sample` rows, and copies of them
    got.sort(key=lambda r: (r.id, r.place, r.dense))
    wide = len(STATS) + 2 * len(metadata)
    read = lambda name, kind: np.frombuffer(b"".join(bytes(getattr(r, name)) for r in got), kind)
    offset = np.concatenate([[0], np.cumsum([len(r.place) // 4 for r in got])]).astype(np.int64)
    return learn(read("place", "<u4").astype(np.int64), read("value", "<f4"), offset, read("dense", "<f8").reshape(-1, wide), np.array([r.y for r in got], np.float32), bits, factors)


def score(docs: DataFrame, model: Machine, metadata: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id_col and score, the probability of label 1, from the whole text and the metadata columns.

    A null or empty text has no words, and statistics of zero; a missing or non-finite metadata value counts as missing,
    which is a feature of its own. Repeated rows get the same score again; null identifiers stay null; an empty table gives
    an empty result; other columns play no part. The model is of a fixed size (2**bits places)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _rows(docs, id_col, text_col, metadata)
    bits = int(len(model.weight) - len(model.mean)).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in parts_of(texts):
                place, value, offset, stats = features_of(texts[a:b], bits)
                t = margin(m, place, value, offset, scaled(m, _dense(batch, a, b, stats, len(metadata))))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(1 / (1 + np.exp(-np.clip(t, -30, 30))))], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
