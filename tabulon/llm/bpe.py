"""Byte-level BPE encoding and decoding, by overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored

CHUNK, OVERLAP, CACHED = 1 << 16, 1 << 10, 400_000


class _Pieces(dict):
    """Packed ids of pre-tokens, kept as they come until there is no room; more are merged each time."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece), "<u4").tobytes()
        if len(self) < CACHED:
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes texts by the ranks of a file and a pre-tokenisation pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.pieces = _Pieces(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)  # merges one pre-token
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece

    def boundaries(self, text: str, first: int, last: int) -> list[int]:
        """Places from `first` to before `last` where matches begin, other than the text's own begin."""
        out = []
        for m in self.pattern.finditer(text, 0):
            if m.start() >= last:
                break
            if m.start() >= max(1, first):
                out.append(m.start())
        return out

    def encode_part(self, text: str, start: int, stop: int | None) -> bytes:
        """The ids of the matches that begin from `start`, a boundary, to before `stop`; they may look at what follows."""
        found = []
        for m in self.pattern.finditer(text, start):
            if stop is not None and m.start() >= stop:
                break
            found.append(m[0])
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text or "")))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for, put end to end. An unknown id is an error."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows' texts as chunks, each with twice the overlap of what follows: r (a row's number), id, k, last, text."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = TaskContext.get().partitionId() << 40
        for frame in frames:
            for i, text in zip(frame["id"], frame["text"]):
                n = -(-len(text) // chunk)
                for k in range(n):
                    part = text[k * chunk : (k + 1) * chunk + 2 * overlap]
                    yield pd.DataFrame({"r": [r], "id": pd.Series([i], dtype=frame["id"].dtype), "k": [k], "last": [k == n - 1], "text": [part]})
                r += 1

    return map_rows(rows, cut, "r long, id {id}, k int, last boolean, text string")


def _encode_long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """id, ids of rows with texts of more than one chunk.

    1. Every chunk is matched by itself, wherever it is, and tells the boundaries in its first and in its last overlap. 2. A
    chunk takes over from the one before at the first boundary that both have: from there on their matches are the same.
    3. Every chunk's matches between its two such places are encoded, and the ids put end to end. Texts with a pair of
    chunks without a common boundary (one match covers an overlap) are put together again and matched from the begin."""
    parts = stored(_chunks(rows, chunk, overlap), "chunks")

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for frame in frames:
            head = [c.boundaries(t[: 2 * overlap], 1, overlap) if k else [] for t, k in zip(frame["text"], frame["k"])]
            tail = [[] if last else [b - chunk for b in c.boundaries(t, chunk, chunk + overlap)] for t, last in zip(frame["text"], frame["last"])]
            yield pd.DataFrame({"r": frame["r"], "k": frame["k"], "head": head, "tail": tail})

    marks = stored(parts.select("r", "k", "last", "text").repartition("r", "k").mapInPandas(mark, "r long, k int, head array<int>, tail array<int>"), "marks")
    before = marks.select("r", (F.col("k") + 1).alias("k"), "tail")
    starts = marks.where("k > 0").select("r", "k", "head").join(before, ["r", "k"]).select("r", "k", F.array_min(F.array_intersect("head", "tail")).alias("start"))
    apart = starts.where("start IS NULL").select("r").distinct()
    stops = starts.select("r", (F.col("k") - 1).alias("k"), (F.col("start") + chunk).alias("stop"))
    cut = parts.join(apart, "r", "left_anti").join(starts, ["r", "k"], "left").join(stops, ["r", "k"], "left")

    def encode_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for frame in frames:
            stops = [None if last else int(x) for x, last in zip(frame["stop"], frame["last"])]
            ids = [c.encode_part(t, int(a), b) for t, a, b in zip(frame["text"], frame["start"], stops)]
            yield pd.DataFrame({"r": frame["r"], "id": frame["id"], "k": frame["k"], "ids": ids})

    cut = cut.select("r", "id", "k", "last", "text", F.coalesce("start", F.lit(0)).alias("start"), "stop")
    encoded = map_rows(cut, encode_parts, "r long, id {id}, k int, ids binary")
    # hexadecimal text, as an array of binary values has no linear concatenation
    in_order = lambda x: F.array_sort(F.collect_list(F.struct("k", x.alias("x"))))
    together = encoded.groupBy("r").agg(F.first("id").alias("id"), in_order(F.hex("ids")).alias("all"))
    texts = parts.join(apart, "r", "left_semi").groupBy("r").agg(F.first("id").alias("id"), in_order(F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk))).alias("all"))
    whole = _encode_rows(texts.select("id", F.array_join("all.x", "").alias("text")), path, pattern)
    return together.select("id", F.unhex(F.array_join("all.x", "")).alias("ids")).union(whole)


def _encode_rows(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """id, ids of rows, each where it is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "ids": [c.encode(x) for x in frame["text"]]})

    return map_rows(rows, run, "id {id}, ids binary")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per input row: id_col, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Texts of one chunk need no shuffle; the chunks of longer ones are dealt to tasks, matched in parallel and stitched. A
    null or empty text has no ids; repeated rows give repeated results, a null identifier a row of its own; an empty table
    gives an empty result; other columns of docs play no part."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    encoded = _encode_rows(rows.where(~long), path, pattern).union(_encode_long(rows.where(long), path, pattern, chunk, overlap))
    return encoded.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with one more column, `bytes`: what the ids stand for. Null ids count as none."""

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return ids.map(lambda x: c.decode(x or b""))

    return encoded.withColumn("bytes", run(ids_col))


def digest_round_trip(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, then its ids decoded. Edge cases as in encode().

    A text of one chunk is encoded and decoded by one worker, so that a task holds one table of pieces."""

    def both(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for frame in frames:
            ids = [c.encode(x) for x in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(c.decode(x)) for x in ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    back = decode(_encode_long(rows.where(long), path, pattern, chunk, overlap), path, pattern)
    digests = back.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
    return map_rows(rows.where(~long), both, "id {id}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", "doc_id").union(digests)
