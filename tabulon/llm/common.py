"""Shared pieces of the training-data operators: the work folder, byte-level text helpers, packed key exchange."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z lowered, every other byte as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that end a word: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Spark's setting by which a query's shuffle files are removed at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: The first n bytes of eight.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def lower_ascii(column):
    """A column with A-Z lowered and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(column, F.lit("")), UPPER, UPPER.lower())


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        shared = tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """The frame written to the shared folder and read back: its lineage ends there and lost executors cost nothing. The write's
    shuffle files go when it ends, not when the driver next collects its garbage, which can be after an operator's last step. Of
    rows with large cells, a writer holds about `block` bytes, if that is given."""
    path, conf = work_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        (df.write.option("parquet.block.size", block) if block else df.write).parquet(path)
    finally:
        conf.unset(TIDY) if before is None else conf.set(TIDY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(rows: DataFrame, run, kind: str, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """rows.mapInPandas(run, kind) with the columns `ids` unchanged, however large, and null where they are. Python gets whole
    numbers as text, as pandas makes doubles of a column of them that has a null. In `kind`, {id} is the type of ids[0]."""
    types = {c: rows.schema[c].dataType.simpleString() for c in ids}
    whole = {c: t for c, t in types.items() if t in ("tinyint", "smallint", "int", "bigint")}
    out = rows.withColumns({c: F.col(c).cast("string") for c in whole}).mapInPandas(run, kind.format(id="string" if ids[0] in whole else types[ids[0]]))
    return out.withColumns({c: F.col(c).cast(t) for c, t in whole.items()})


_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What make() gives, kept in this process for later tasks: one thing at a time, until let_go()."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Ends what this process keeps for tasks of other operators, and gives freed memory back to the system."""
    _KEPT.clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A function for mapInPandas as a task that lets go of others' memory when it begins, and of its own when it ends."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        yield from run(frames)
        let_go()

    return task


def exact(values) -> pd.api.extensions.ExtensionArray:
    """Whole numbers and None as a column of 64-bit integers, none of them by way of a double."""
    return pd.array(list(values), dtype="Int64")


def planes(values: np.ndarray) -> bytes:
    """64-bit numbers by the place of their bytes: sorted keys and small numbers then compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(packed, kind) -> np.ndarray:
    """The numbers of several planes(), one after the other."""
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(kind).ravel() for x in packed]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def gaps(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers that are not negative as planes() of their steps, of which the upper ones are mostly zeros."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def from_gaps(packed, kind) -> np.ndarray:
    """The numbers of several gaps(), one after the other."""
    parts = [np.cumsum(from_planes([x], kind), dtype=kind) for x in packed]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def groups_of(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of a partition that is sorted by `keys`, as one frame for each group."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        edges = [0, *cut.tolist(), len(frame)]
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        for a, b in zip(edges, edges[1:]):
            held.append(frame.iloc[a:b])
            if b < len(frame):
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
                held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, each followed by one space, and where each starts (with the end of the last)."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else (t or b"") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b" ".join(parts) + b" " if parts else b"", np.uint8), starts


def words_of(data: np.ndarray, starts: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of joined() texts, and each text's first word (with the end of the last)."""
    return placed_words(data, starts, seed)[:2]


def placed_words(data: np.ndarray, starts: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As words_of(), with each word's place and length in bytes.

    A word's hash sums its bytes times powers of an odd multiplier, which needs no loop over words."""
    data = np.frombuffer(data.tobytes().translate(LOWER_BYTES), np.uint8)
    space = np.flatnonzero(SPACE.take(data, mode="clip"))  # the last byte is one
    run = np.diff(space, prepend=-1)  # a word, if any, with the space behind it
    some = run > 1
    end = space[some]
    length = run[some] - 1
    begin = end - length
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, np.uint64), first, begin, end
    place = np.arange(int(length.max()), dtype=np.uint64)
    powers = mix64(place * _M1 + np.uint64(seed)) | np.uint64(1)
    table = mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 7))
    table[SPACE] = 0
    offset = np.arange(len(data), dtype=np.int32)
    offset -= np.repeat((space - run + 1).astype(np.int32), run)
    value = powers.take(offset, mode="clip")
    value *= table.take(data, mode="clip")
    total = np.add.reduceat(value, begin)
    return mix64(total + length.astype(np.uint64) * _M1), first, begin, length


def hashed_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What placed_words() gives of data that is lower-cased, with other hashes, of eight bytes at a time: about a step a word.

    A word's hash sums what its eights scramble to, each with its place; words of up to eight bytes never share one."""
    space = np.flatnonzero(((data - np.uint8(9)) < 5) | (data == 32))  # the last byte is one
    run = np.diff(space, prepend=-1)
    end = space[run > 1]
    length = run[run > 1] - 1
    begin = end - length
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return np.zeros(0, np.uint64), first, begin, length
    many = (length + 7) >> 3
    head = np.cumsum(many) - many
    place = np.arange(int(many.sum())) - np.repeat(head, many)
    at = np.repeat(begin, many) + 8 * place
    left = np.minimum(np.repeat(end, many) - at, 8)
    eights = np.ndarray(len(data), "<u8", data.tobytes() + bytes(8), strides=(1,))
    value = mix64(eights[at] & _LEFT.take(left)) + place.view(np.uint64) * _M1
    total = np.add.reduceat(mix64(value), head)
    return mix64(total + length.view(np.uint64) * _M2), first, begin, length


def parts_of(texts, most: int = 1 << 20):
    """Consecutive ranges (from, to) of texts of about `most` characters, or of one longer text."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def shingles_of(texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct k-word shingles as sorted 64-bit hashes, and where each text's begin.

    A text of fewer words gives one shingle, the whole sequence; one without words gives none."""
    data, starts = joined(texts)
    word, first = words_of(data, starts)
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.zeros(len(m) + 1, np.int64)
    np.cumsum(m, out=begin[1:])
    doc = np.repeat(np.arange(len(m)), m)
    at = np.repeat(first[:-1], m) + np.arange(begin[-1]) - np.repeat(begin[:-1], m)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        have = np.repeat(n, m) > j
        value[have] = mix64(value[have] * _M1 + word[np.minimum(at + j, max(0, len(word) - 1))[have]] + np.uint64(j + 1))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(len(m) + 1))
