"""Alignment of two tokenizers over the same bytes: fragments of byte ranges that compose in any grouping."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes from which a text is cut into stretches; characters of a stretch; bytes of a fragment's range; fragments that one
#: step of the tree composes.
LONG, STRETCH, RANGE, FAN = 32_768, 16_384, 8_192, 16
#: Characters (and pairs, of long texts) that share a dictionary of words and pairs.
CHUNK = 3 << 20
#: Bytes of rows that a writer of intermediate tables holds.
BLOCK = 16 << 20
BLANK = "▁"
#: Fixed value: how byte-level tokenizers cut a text before they merge.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN = re.compile("[\x00-\u024f]*")
#: A blank between two other characters. Neither tokenizer has a token over the place before it.
WORD_EDGE = re.compile(r"(?<=\S) (?=\S)")
#: Places that no token of A crosses, and none of B: a run of letters ends, or a word begins.
A_EDGE = re.compile(r"(?<=[A-Za-z])(?=[.,;:!?()\n])|(?<=\S) (?=\S)")
B_EDGE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def pack(values: np.ndarray) -> bytes:
    """32-bit integers as their differences, by the place of their bytes: sorted or small ones then compress well."""
    return np.ascontiguousarray(np.diff(np.asarray(values, np.int32), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.int32).ravel(), dtype=np.int32).astype(np.int64)


def byte_level() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others follow from
    256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Both tokenizers, and the bytes of each token."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        of = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(BLANK, " ").encode() for p in pieces]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: Whether words can be tokenised one by one: no piece goes on over the begin of a word.
        self.by_word = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        self.fast = self._ranks(a_path)

    def _ranks(self, path: str):
        """A's encoder by ranks, or none if the file's merges don't make tokens in the order of their ids, each by one merge. If
        they do, both merge the same pairs: no token crosses the span of a pair that is about to merge, so the span looks as
        it does alone, and there the pair is the one that the file names."""
        import tiktoken

        made = json.loads(Path(path).read_text())
        model, pre = made["model"], made.get("pre_tokenizer") or {}
        ids = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        bytes_first = {self.a_bytes[i] for i in range(256)} == {bytes([b]) for b in range(256)}
        plain = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), made.get("normalizer"), model.get("ignore_merges", False)) == ("ByteLevel", False, True, None, False)
        if not plain or not bytes_first or ids != list(range(256, 256 + len(ids))):
            return None
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={self.a_bytes[i]: i for i in range(256 + len(ids))}, special_tokens={})

    def of_a(self, text: str):
        """A's ids of a text as it is."""
        return self.fast.encode_to_numpy(text, disallowed_special=()) if self.fast and LATIN.fullmatch(text) else self.a.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _alone(words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
        counts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for i in range(0, len(words), 4096):
            ids = encode(words[i : i + 4096])
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            found.append(np.fromiter(chain.from_iterable(ids), np.int32, counts[-1].sum()))
        return np.concatenate(counts), np.concatenate(found)

    def _together(self, words: list[str], size: np.ndarray, encode, length: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """As _alone(), with `many` words and blanks between them as one text, which is faster. Words are told by their bytes;
        should tokens' bytes not be those of the words, each is encoded alone."""
        if not self.by_word:
            return self._alone(words, encode)
        _, ids = self._alone([" ".join(words[i : i + many]) for i in range(0, len(words), many)], encode)
        ends, word_ends = np.cumsum(length[ids]), np.cumsum(size)
        cut = np.searchsorted(ends, word_ends, "right")
        if len(words) and not (len(ids) and cut[0] and ends[-1] == word_ends[-1] and (ends[cut - 1] == word_ends).all()):
            return self._alone(words, encode)
        return np.diff(cut, prepend=0), ids

    def both(self, words: list[str], size: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A's ids of a blank and each word, and B's ids of the word: how many for each word, and all. A word whose characters
        are all within LATIN goes by the ranks: there, libraries agree which characters are letters."""
        library = lambda x: [e.ids for e in self.a.encode_batch([" " + t for t in x], add_special_tokens=False)]
        ranks = (lambda x: [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in x]) if self.fast else library
        pieces = lambda x: self.b.encode(x, num_threads=1)
        latin = np.fromiter((w.isascii() or bool(LATIN.fullmatch(w)) for w in words), bool, len(words))
        near, far = ([w for w, x in zip(words, latin.tolist()) if x == k] for k in (True, False))
        out = []
        for fast, slow, length, many in ((ranks, library, self.a_length, 1024), (pieces, pieces, self.b_length, 32)):
            counts, halves = np.zeros(len(words), np.int64), (self._together(near, size[latin], fast, length, many), self._alone(far, slow))
            counts[latin], counts[~latin] = halves[0][0], halves[1][0]
            of, ids = np.repeat(latin, counts), np.zeros(counts.sum(), np.int32)
            ids[of], ids[~of] = halves[0][1], halves[1][1]
            out.append((counts, ids))
        return tuple(out)


@lru_cache(maxsize=1)
def tokens_of(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


@dataclass
class Fragment:
    """What a byte range leaves open: tokens that end up to its first shared end (the open prefix) and after its last one (the
    open suffix); without a shared end (first is -1) all tokens are open. Ends are bytes from the begin of the text."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray
    first: int = -1
    last: int = -1
    bad: bool = False


@dataclass
class Closed:
    """Tokens of whole groups, in order; a group ends where a token of A and one of B do."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray


def _between(f, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b = ((e > low) & (e <= high) for e in (f.a_end, f.b_end))
    return f.a[a], f.a_end[a], f.b[b], f.b_end[b]


def fragment(a, a_end, b, b_end, bad: bool = False) -> tuple[Fragment, Closed | None]:
    """A byte range's open ends and its closed groups."""
    f = Fragment(a, a_end, b, b_end, bad=bad)
    shared = np.intersect1d(a_end, b_end)
    if not len(shared):
        return f, None
    f.first, f.last = int(shared[0]), int(shared[-1])
    return _closed(f)


def _closed(f: Fragment) -> tuple[Fragment, Closed | None]:
    """f without the tokens between its first and last shared end, and these."""
    inner = Closed(*_between(f, f.first, f.last))
    if not len(inner.a) and not len(inner.b):
        return f, None
    a, b = ((e <= f.first) | (e > f.last) for e in (f.a_end, f.b_end))
    return Fragment(f.a[a], f.a_end[a], f.b[b], f.b_end[b], f.first, f.last, f.bad), inner


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, Closed | None]:
    """Two ranges that follow each other as one. Where both have shared ends, x's suffix and y's prefix close one group. The
    operation is associative, and a fragment without tokens is its unit."""
    both = Fragment(*(np.concatenate([getattr(x, c), getattr(y, c)]) for c in ("a", "a_end", "b", "b_end")), x.first if x.first >= 0 else y.first, y.last if y.last >= 0 else x.last, x.bad or y.bad)
    return _closed(both) if both.first >= 0 else (both, None)


def grouped(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each token, and how many groups there are. Ends are in order, and the last ones equal."""
    shared = np.intersect1d(a_end, b_end)
    return np.searchsorted(shared, a_end), np.searchsorted(shared, b_end), len(shared)


def pairs_of(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, groups: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs as a * width + b, once for each distinct pair of a group; their group; and their links in it."""
    a_key, a_n = np.unique(ga * (1 << 32) + a, return_counts=True)
    b_key, b_n = np.unique(gb * (1 << 32) + b, return_counts=True)
    a_group, b_group = a_key >> 32, b_key >> 32
    b_first, b_many = np.searchsorted(b_group, np.arange(groups)), np.bincount(b_group, minlength=groups)
    many = b_many[a_group]
    left = np.repeat(np.arange(len(a_key)), many)
    right = np.repeat(b_first[a_group] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return (a_key[left] & 0xFFFFFFFF) * width + (b_key[right] & 0xFFFFFFFF), a_group[left], a_n[left] * b_n[right]


class Writer:
    """Groups as text: a1,a2|b1;a3|b2,b3."""

    def __init__(self, most: int):
        self.ends = [[f"{i}{s}" for i in range(most)] for s in ",|;"]

    def parts(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Every token with the sign behind it, in order, and the group of each."""
        group, kind, ids = np.concatenate([ga, gb]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
        order = np.argsort(group * 2 + kind, kind="stable")
        group, kind, ids = group[order], kind[order], ids[order]
        change = np.append((group[1:] != group[:-1]) | (kind[1:] != kind[:-1]), True)
        sign = np.where(change, 1 + kind, 0)
        ends = self.ends
        return [ends[s][i] for s, i in zip(sign.tolist(), ids.tolist())], group


class Words:
    """Words' fragments, which are closed at both ends, found once for a chunk of texts: a text is their product."""

    def __init__(self, tokens: Tokens, words: list[str], writer: Writer):
        n, width = len(words), len(tokens.b_bytes)
        raw = [b" " + w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, n)
        (count_a, a), (count_b, b) = tokens.both(words, size)
        a, b = a.astype(np.int64), b.astype(np.int64)
        self.bad = np.zeros(n, bool)
        for counts, ids, table, length in ((count_a, a, tokens.a_bytes, tokens.a_length), (count_b, b, tokens.b_bytes, tokens.b_length)):
            self.bad |= np.bincount(np.repeat(np.arange(n), counts), length[ids], minlength=n).astype(np.int64) != size
            edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
            for i in range(0, n, 4096):
                j = min(n, i + 4096)
                if b"".join([table[x] for x in ids[edge[i] : edge[j]].tolist()]) != b"".join(raw[i:j]):
                    for k in range(i, j):
                        self.bad[k] |= b"".join([table[x] for x in ids[edge[k] : edge[k + 1]].tolist()]) != raw[k]
        wa, wb = np.repeat(np.arange(n), count_a), np.repeat(np.arange(n), count_b)
        a, wa, b, wb = a[~self.bad[wa]], wa[~self.bad[wa]], b[~self.bad[wb]], wb[~self.bad[wb]]
        a_end, b_end = np.cumsum(tokens.a_length[a]), np.cumsum(tokens.b_length[b])  # of good words, which have equal bytes
        ga, gb, groups = grouped(a_end, b_end)
        owner = np.zeros(groups, np.int64)
        owner[ga] = wa
        parts, group = writer.parts(a, b, ga, gb)
        edge = np.searchsorted(owner[group], np.arange(n + 1)) if groups else np.zeros(n + 1, np.int64)
        self.text = ["".join(parts[i:j])[:-1] for i, j in zip(edge.tolist(), edge[1:].tolist())]
        key, pair_group, times = pairs_of(a, b, ga, gb, groups, width)
        per = lambda x, w=None: np.bincount(x, w, minlength=n)
        self.sums = np.column_stack([per(wa), per(wb), per(owner), per(owner[pair_group], times).astype(np.int64)])
        pair_word = owner[pair_group]
        both = pair_word * (1 << 32) + key  # a pair that several groups of a word have counts once, with all its links
        first, inverse = np.unique(both, return_inverse=True)
        self.times = np.bincount(inverse, times, minlength=len(first)).astype(np.int64)
        self.offset = np.searchsorted(first >> 32, np.arange(n + 1))
        self.keys, self.pair = np.unique(first & 0xFFFFFFFF, return_inverse=True)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
KIND = "chunk long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, keys array<int>, docs array<int>, word_offset binary, word_pair binary, word_times binary"


class Output:
    """Rows of documents, and a row with the dictionary of their chunk: keys are its linked pairs, docs how many documents have
    each; word w has the pairs word_pair[word_offset[w]:word_offset[w + 1]], so many links each. A document's codes are its
    words, times how often."""

    def __init__(self, id_type: pa.DataType, mark: int):
        self.id_type, self.mark, self.seq = id_type, mark, 0

    def batch(self, ids: list[pa.Array], rows: list[tuple], keys, docs, offset, pair, times) -> pa.RecordBatch:
        chunk = ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 24 | self.seq) * 2 + self.mark
        self.seq += 1
        n = len(rows)
        packed = lambda c: pa.array([pack(r[c]) for r in rows] + [None], pa.binary())
        once = lambda x: pa.array([None] * n + [np.asarray(x, np.int32)], pa.list_(pa.int32()))
        dense = lambda x: pa.array([None] * n + [pack(x)], pa.binary())
        all_ids = pa.concat_arrays([*(x.cast(self.id_type) for x in ids), pa.nulls(1, self.id_type)])
        numbers = [pa.array([int(r[0][i]) for r in rows] + [None], pa.int64()) for i in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * (n + 1), pa.int64()), all_ids, *numbers, pa.array([r[1] for r in rows] + [None], pa.string()), packed(2), packed(3), once(keys), once(docs), dense(offset), dense(pair), dense(times)], ["chunk", "id", *COUNTS, "groups_sha256", "codes", "times", "keys", "docs", "word_offset", "word_pair", "word_times"])


NOTHING = ((0, 0, 0, 0), "", np.zeros(0, np.int32), np.zeros(0, np.int32))


def _short(a_path: str, b_path: str, chunk: int):
    """Texts of up to LONG bytes: each is one range, made of its words' fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, out, ids, texts, size = tokens_of(a_path, b_path), None, [], [], 0
        writer = Writer(max(len(tokens.a_bytes), len(tokens.b_bytes)))

        def flush() -> pa.RecordBatch:
            known: defaultdict[str, int] = defaultdict()
            known.default_factory = known.__len__
            split = WORD_EDGE.split if tokens.by_word else lambda t: [t]
            codes = [np.fromiter(map(known.__getitem__, split(t)), np.int64) if t else None for t in texts]
            words = Words(tokens, list(known), writer)
            docs, there, rows = np.zeros(len(words.keys), np.int64), np.zeros(len(words.keys), bool), []
            for c in codes:
                if c is None or words.bad[c].any():
                    rows.append(NOTHING)
                    continue
                used, times = np.unique(c, return_counts=True)
                n = words.offset[used + 1] - words.offset[used]
                at = np.repeat(words.offset[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                there[words.pair[at]] = True
                docs += there
                there[:] = False
                text = ";".join(map(words.text.__getitem__, c.tolist()))
                rows.append((times @ words.sums[used], hashlib.sha256(text.encode()).hexdigest(), used.astype(np.int32), times.astype(np.int32)))
            return out.batch(ids, rows, words.keys, docs, words.offset, words.pair, words.times)

        for batch in batches:
            out = out or Output(batch.column("id").type, 0)
            part, column = 0, batch.column("text")
            for i in range(len(column)):
                t = column[i].as_py()
                texts.append(t)
                size += len(t or "") + 1
                if size >= chunk:
                    ids.append(batch.column("id").slice(part, i + 1 - part))
                    yield flush()
                    part, ids, texts, size = i + 1, [], [], 0
            if part < len(column):
                ids.append(batch.column("id").slice(part))
        if texts:
            yield flush()

    return run


def _cut(stretch: int):
    """Long texts as stretches of both tokenizers, each with the byte at which it begins. The edges of one differ from the other's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, id_, text in zip(batch.column("row").to_pylist(), (batch.column("id").slice(i, 1) for i in range(batch.num_rows)), batch.column("text").to_pylist()):
                whole = " " + text
                for kind, edge in enumerate((A_EDGE, B_EDGE)):
                    at, base, out = 0, 0, []
                    while at < len(whole):
                        m = edge.search(whole, min(len(whole), at + stretch))
                        to = m.start() if m else len(whole)
                        out.append((base, whole[at:to]))
                        base, at = base + len(whole[at:to].encode()), to
                    n = len(out)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.concat_arrays([id_] * n), pa.array([kind] * n, pa.int32()), pa.array([b for b, _ in out], pa.int64()), pa.array([t for _, t in out], pa.string())], ["row", "id", "kind", "base", "text"])

    return run


TOKENS = "row long, id {id}, kind int, slot long, bad boolean, base long, ids binary"


def _tokenise(a_path: str, b_path: str, width: int):
    """A stretch's tokens, dealt by the byte range in which they end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens_of(a_path, b_path)
        for batch in batches:
            for i in range(batch.num_rows):
                row, kind, base, text = (batch.column(c)[i].as_py() for c in ("row", "kind", "base", "text"))
                ids = np.array(t.b.encode(text[1:]) if kind else t.of_a(text), np.int64)
                table, length = (t.b_bytes, t.b_length) if kind else (t.a_bytes, t.a_length)
                bad = b"".join([table[x] for x in ids.tolist()]) != text.encode()
                ends = base + np.cumsum(length[ids])
                slot = (ends - 1) // width
                edge = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(ids)] if len(ids) else [0, 0]
                spans = list(zip(edge, edge[1:]))
                slots = [int(slot[a]) if len(ids) else base // width for a, _ in spans]
                bases = [int(ends[a - 1]) if a else base for a, _ in spans]
                n = len(spans)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.concat_arrays([batch.column("id").slice(i, 1)] * n), pa.array([kind] * n, pa.int32()), pa.array(slots, pa.int64()), pa.array([bad] * n), pa.array(bases, pa.int64()), pa.array([ids[a:b].astype("<i4").tobytes() for a, b in spans], pa.binary())], ["row", "id", "kind", "slot", "bad", "base", "ids"])

    return run


PIECES = "row long, id {id}, slot long, open boolean, at long, a binary, a_end binary, b binary, b_end binary, first long, last long, bad boolean"


class Pieces:
    """Rows of fragments (open) and of closed groups. Those go on where the groups before them end, so their ends are told by
    their tokens; `at` is their last end."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.rows: list[tuple] = []

    def add(self, row: int, id_: pa.Array, slot: int, found: Fragment | Closed | None) -> None:
        if found is None:
            return
        opened = isinstance(found, Fragment)
        self.ids.append(id_)
        ids = [x.astype("<i4").tobytes() for x in (found.a, found.b)]
        ends = [x.astype("<i8").tobytes() if opened else None for x in (found.a_end, found.b_end)]
        self.rows.append((row, slot, opened, 0 if opened else int(found.a_end[-1]), ids[0], ends[0], ids[1], ends[1], *((found.first, found.last, found.bad) if opened else (None, None, None))))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        columns = [pa.array([r[i] for r in self.rows], k) for i, k in enumerate(kinds)]
        out = pa.RecordBatch.from_arrays([columns[0], pa.concat_arrays(self.ids), *columns[1:]], ["row", "id", "slot", "open", "at", "a", "a_end", "b", "b_end", "first", "last", "bad"])
        self.ids, self.rows = [], []
        return out


def _ints(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values.to_numpy(zero_copy_only=False), np.int64)


def _packed(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py(), "<i8" if name.endswith("_end") else "<i4").astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple[pa.RecordBatch, int]]]]:
    """Rows of a partition that is sorted by keys, as (batch, place), by key."""
    key, held = None, []
    for batch in batches:
        for i, k in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys))):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append((batch, i))
    if held:
        yield key, held


def _leaves(a_path: str, b_path: str):
    """Fragments of byte ranges, from the tokens of each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, t = Pieces(), tokens_of(a_path, b_path)
        for (row, slot), rows in _groups(batches, ("row", "slot")):
            ids, ends, bad = ([], []), ([], []), False
            for batch, i in rows:
                kind = batch.column("kind")[i].as_py()
                ids[kind].append(_packed(batch, "ids", i))
                ends[kind].append(batch.column("base")[i].as_py() + np.cumsum((t.b_length if kind else t.a_length)[ids[kind][-1]]))
                bad |= batch.column("bad")[i].as_py()
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            opened, inner = fragment(join(ids[0]), join(ends[0]), join(ids[1]), join(ends[1]), bad)
            id_ = rows[0][0].column("id").slice(rows[0][1], 1)
            out.add(row, id_, slot, opened)
            out.add(row, id_, slot, inner)
            if len(out.rows) >= 256:
                yield out.batch()
        if out.rows:
            yield out.batch()

    return run


def _level(fan: int):
    """Fragments of `fan` slots that follow each other, composed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Pieces()
        for (row, up), rows in _groups(batches, ("row", "up")):
            id_ = rows[0][0].column("id").slice(rows[0][1], 1)
            total = None
            for batch, i in rows:
                f = Fragment(*(_packed(batch, c, i) for c in ("a", "a_end", "b", "b_end")), *(batch.column(c)[i].as_py() for c in ("first", "last", "bad")))
                if total is None:
                    total = f
                else:
                    total, inner = compose(total, f)
                    out.add(row, id_, up, inner)
            out.add(row, id_, up, total)
            if len(out.rows) >= 256:
                yield out.batch()
        if out.rows:
            yield out.batch()

    return run


def _whole(a_path: str, b_path: str, chunk: int):
    """Documents from their closed groups, which come in order, and their last fragment, which comes first: it knows whether the
    document is bad, and its prefix is the first group, as a text's begin is a shared end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, out, ids, rows, found, size = tokens_of(a_path, b_path), None, [], [], [], 0
        width = len(t.b_bytes)
        writer = Writer(max(len(t.a_bytes), width))

        def flush() -> pa.RecordBatch:
            keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.fromiter(f, np.int64, len(f)) for f in found)]))
            docs, done = np.zeros(len(keys), np.int64), []
            for (numbers, sha), f in zip(rows, found):
                at = np.searchsorted(keys, np.fromiter(f, np.int64, len(f)))
                docs[at] += 1
                done.append((numbers, sha, at.astype(np.int32), np.fromiter(f.values(), np.int64, len(f)).astype(np.int32)))
            return out.batch(ids, done, keys, docs, np.arange(len(keys) + 1), np.arange(len(keys)), np.ones(len(keys)))

        document: dict = {}

        def end() -> None:
            nonlocal size
            ids.append(document["id"])
            bad = document["bad"]
            rows.append(((0, 0, 0, 0), "") if bad else (document["n"], document["sha"].hexdigest()))
            found.append({} if bad else document["pairs"])
            size += len(found[-1])

        for batch in batches:
            out = out or Output(batch.column("id").type, 1)
            for i in range(batch.num_rows):
                row = batch.column("row")[i].as_py()
                if document.get("row") != row:
                    if document:
                        end()
                        if size >= chunk:
                            yield flush()
                            ids, rows, found, size = [], [], [], 0
                    document = {"row": row, "id": batch.column("id").slice(i, 1), "bad": batch.column("bad")[i].as_py(), "n": np.zeros(4, np.int64), "sha": hashlib.sha256(), "pairs": {}}
                if document["bad"]:
                    continue
                a, b = (_packed(batch, c, i) for c in ("a", "b"))
                ga, gb, groups = grouped(np.cumsum(t.a_length[a]), np.cumsum(t.b_length[b]))
                if not groups:
                    continue
                key, _, times = pairs_of(a, b, ga, gb, groups, width)
                pairs = document["pairs"]
                for k, n in zip(key.tolist(), times.tolist()):
                    pairs[k] = pairs.get(k, 0) + n
                text = "".join(writer.parts(a, b, ga, gb)[0])
                document["sha"].update((";" * bool(document["n"][2]) + text[:-1]).encode())
                document["n"] += (len(a), len(b), groups, times.sum())
        if document:
            end()
        if rows:
            yield flush()

    return run


def _long(long: DataFrame, id_type: str, a_path: str, b_path: str, stretch: int, width: int, fan: int, chunk: int) -> DataFrame:
    """Documents beyond LONG bytes: stretches are tokenised in parallel, fragments of byte ranges composed by a tree of steps."""
    rows = long.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text")
    cut = stored(rows.mapInArrow(_cut(stretch), f"row long, id {id_type}, kind int, base long, text string").repartition("row", "kind", "base"), "stretches", BLOCK)
    dealt = cut.mapInArrow(_tokenise(a_path, b_path, width), TOKENS.format(id=id_type))
    kind = PIECES.format(id=id_type)
    level = stored(dealt.repartition("row", "slot").sortWithinPartitions("row", "slot", "kind", "base").mapInArrow(_leaves(a_path, b_path), kind), "fragments", BLOCK)
    closed = level.where("NOT open")
    most = level.agg(F.max("slot").alias("m")).collect()[0].m or 0
    while most:
        most //= fan
        up = level.where("open").withColumn("up", F.floor(F.col("slot") / fan))
        level = stored(up.repartition("row", "up").sortWithinPartitions("row", "up", "slot").mapInArrow(_level(fan), kind), "fragments", BLOCK)
        closed = closed.unionByName(level.where("NOT open"))
    all_ = closed.unionByName(level.where("open"))
    return all_.repartition("row").sortWithinPartitions("row", "at").mapInArrow(_whole(a_path, b_path, chunk), KIND.format(id=id_type))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's rows come as pairs with their counts, its dictionary, its documents."""
    chunk, pairs, best, total = None, [], None, None
    for batch in batches:
        chunks, step = batch.column("chunk").to_numpy(), batch.column("step").to_numpy()
        cut = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(step) != 0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(chunks)]):
            if i == j:
                continue
            if chunks[i] != chunk:
                chunk, pairs, best, total = chunks[i], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
            part = batch.slice(i, j - i)
            if step[i] == 0:
                pairs.append(tuple(part.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "top")))
            elif step[i] == 1:
                keys = _ints(part.column("keys"), 0)
                offset, pair, times = (unpack(part.column(c)[0].as_py()) for c in ("word_offset", "word_pair", "word_times"))
                n, top = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                for k, count, high in pairs:
                    at = np.searchsorted(keys, k.astype(np.int64))
                    n[at], top[at] = count, high
                sums = [np.concatenate([[0], np.cumsum(x[pair] * times)]) for x in (top, n)]
                best, total = (s[offset[1:]] - s[offset[:-1]] for s in sums)
                pairs = []
            else:
                out = []
                for k in range(part.num_rows):
                    codes, times = (unpack(part.column(c)[k].as_py()) for c in ("codes", "times"))
                    out.append((int(times @ best[codes]), int(times @ total[codes])) if len(codes) else (0, 0))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(c) for c in COUNTS), *(pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)), part.column("groups_sha256")], ["id", *COUNTS, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, stretch: int = STRETCH, width: int = RANGE, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """Groups and links of two tokenizers: A (a byte-level tokenizers file) encodes a blank and the text, B (a sentencepiece
    model that adds the blank) the text; a group ends where tokens of both do. A pair's count is how many documents have it
    linked. Returns per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best (links of pairs whose count is the highest
    of their A id), count_sum (over links), groups_sha256.

    A null or empty text, and one whose tokens don't give back its bytes (such as one with U+2581), has no tokens: zeros and
    an empty digest. Repeated rows are documents of their own, and count as such; null identifiers stay null; an empty
    table gives an empty result; other columns play no part.

    Texts of up to `long` bytes are one range. Longer ones are cut into stretches of about `stretch` characters at places
    that the tokenizer in question never crosses (a text without such places is one stretch), tokens are dealt to byte
    ranges of `width`, and each range's fragment (open prefix, closed groups, open suffix) is composed with its neighbours,
    `fan` at a time, until one is left. Pairs are counted once a chunk of documents, then over the corpus."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    beyond = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    done = stored(rows.where(~beyond).mapInArrow(_short(a_path, b_path, chunk), KIND.format(id=id_type)).unionByName(_long(rows.where(beyond), id_type, a_path, b_path, stretch, width, fan, chunk)), "aligned", BLOCK)
    size = len(tokens_of(a_path, b_path).b_bytes)
    pairs = done.where("keys IS NOT NULL").select("chunk", F.inline(F.arrays_zip("keys", "docs")))
    counts = pairs.groupBy("keys").agg(F.sum("docs").alias("n"))
    scored = counts.withColumn("top", (F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("keys") / size)))).cast("int"))  # an id has as many rows as B has pieces, at most
    back = pairs.join(scored, "keys").select("chunk", F.lit(0).alias("step"), F.col("keys").alias("key"), "n", "top")
    all_ = back.unionByName(done.withColumn("step", F.when(F.col("keys").isNotNull(), 1).otherwise(2)).drop("docs"), allowMissingColumns=True)
    kind = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return all_.repartition("chunk").sortWithinPartitions("chunk", "step").mapInArrow(_finish, kind).withColumnRenamed("id", id_col)
