"""Best-fit packing of token pieces by bounded-space online best-fit."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import byte_level
from .common import kept, map_rows

CAPACITY, OPEN_BINS, PIECES_PER_TASK = 4096, 1024, 250_000
CACHED = 400_000


class OpenBins:
    """At most `most` open bins. free[s] lists the open bins with s free places; bit s of `mask` says that there is one.

    A piece goes to the bin in which it leaves the least room, found as the lowest bit at or above its length. When a
    bin must be opened and none may, the fullest open bin closes. A bin without room closes at once."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.mask, self.free, self.count, self.next = capacity, most, 0, {}, 0, 0

    def _take(self, room: int) -> int:
        bins = self.free[room]
        b = bins.pop()
        if not bins:
            self.mask &= ~(1 << room)
        return b

    def put(self, length: int) -> tuple[int, int]:
        """The bin of a piece of this length, and its offset there."""
        at = self.mask >> length
        if at:
            room = length + (at & -at).bit_length() - 1
            b = self._take(room)
        else:
            if self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)
                self.count -= 1
            b, room, self.next, self.count = self.next, self.capacity, self.next + 1, self.count + 1
        left = room - length
        if left:
            self.free.setdefault(left, []).append(b)
            self.mask |= 1 << left
        else:
            self.count -= 1
        return b, self.capacity - room


#: White space and letters for which lower-casing is one to one and already composed: Latin text up to U+017F but U+0130.
PLAIN = re.compile("[\x09-\x0d\x20-\x7e¡-ÿĀ-įı-ňŊ-ſ]*")


LETTERS, NUMBERS = ("".join(re.escape(c) for c in map(chr, range(33, 384)) if PLAIN.fullmatch(c) and unicodedata.category(c)[0] == k) for k in "LN")
#: How the files that Ranks takes prepare a text, and the same cut for words of PLAIN.
PREPARED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
SUFFIX = "</w>"


class Ranks:
    """Packed ids of pre-tokens by the ranks of a file's merges, many at once. A symbol that ends a pre-token is another than
    the same one inside, so it is written as another character: A to Z for a to z, else one further up.

    Both merge alike if merges make tokens in the order of their ids, each by one merge, and every token alone becomes
    itself: no token crosses the span of a pair that is about to merge, so the span looks as it does alone."""

    def __init__(self, symbols: list[str], merges: list[tuple[int, int]]):
        import tiktoken

        self.ends = {c: c.upper() if "a" <= c <= "z" else chr(0x200 + ord(c)) for c in byte_level()}
        inner = lambda c: chr(0x500 + ord(c)) if "A" <= c <= "Z" else c
        written = [self.ends[x[0]] if x.endswith(SUFFIX) else inner(x) for x in symbols]
        for a, b in merges:
            written.append(written[a] + written[b])
        # bytes come first, then the symbols of two bytes, then the merges
        rank, self.id_of, self.is_end = {bytes([b]): b for b in range(256)}, np.zeros(256 + len(written), "<u4"), np.zeros(256 + len(written), bool)
        last = frozenset(self.ends.values())
        for i, x in enumerate(written):
            r = rank.setdefault(x.encode(), 256 + i)
            self.id_of[r], self.is_end[r] = i, x[-1] in last
        stop = "".join(sorted(last))
        self.coder = tiktoken.Encoding("words", pat_str=f"[^{stop}]*[{stop}]", mergeable_ranks=rank, special_tokens={})
        self.of_byte = {b: c for c, b in byte_level().items()}

    @classmethod
    def of_file(cls, path: str) -> Ranks | None:
        """None for a file that prepares texts in another way, or whose merges are not in the order of ids."""
        made = json.loads(Path(path).read_text())
        model = made["model"]
        told = [model.get(k) for k in ("type", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")]
        if {k: made.get(k) for k in PREPARED} != PREPARED or made.get("post_processor") or told != ["BPE", None, None, SUFFIX, False, False]:
            return None
        vocab, pairs = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        symbols = [x for x, _ in sorted(vocab.items(), key=lambda x: x[1])[:512]]
        first = len(symbols) == 512 and set(symbols) == {c + e for c in byte_level() for e in ("", SUFFIX)}
        if not first or [vocab.get(a + b) for a, b in pairs] != list(range(512, 512 + len(pairs))) or len(vocab) != 512 + len(pairs):
            return None
        return cls(symbols, [(vocab[a], vocab[b]) for a, b in pairs])

    def packed(self, parts: list[str]) -> list[bytes]:
        """Each pre-token's ids."""
        ends, written = self.ends, []
        for x in parts:
            if not x.isascii():
                x = x.encode().decode("latin-1").translate(self.of_byte)
            written.append(x[:-1] + ends[x[-1]])
        got = self.coder.encode_to_numpy("".join(written), disallowed_special=())
        raw = self.id_of.take(got).tobytes()
        cut = (4 * (np.flatnonzero(self.is_end.take(got)) + 1)).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]


class Tokens:
    """Ids of whole texts by a tokenizers file whose pre-tokens never cross white space. So words between white space
    are encoded once and kept; texts beyond plain Latin letters, and those with a special token's string, go to the
    library whole. New words are cut into pre-tokens, which go through the file's ranks, if it has such."""

    def __init__(self, path: str):
        self.path, self.ranks = path, Ranks.of_file(path)
        self.kept: dict[str, bytes] = {}

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = True
        return library

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, words: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of different lower-cased words, and of their pre-tokens."""
        if self.ranks is None:
            words = list(words)
            got = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            cut = np.searchsorted(np.array(got.word_ids), np.arange(len(words) + 1))
            return {w: ids[a:b].tobytes() for w, a, b in zip(words, cut, cut[1:])}
        kept, parts, several = self.kept, {}, []
        for w in words:
            if w.isalpha():
                parts[w] = None
                continue
            cut = CUT.findall(w)
            several.append((w, cut))
            for x in cut:
                if x not in kept:
                    parts[x] = None
        out = dict(zip(parts, self.ranks.packed(list(parts)))) if parts else {}
        for w, cut in several:
            out[w] = b"".join([out[x] if x in out else kept[x] for x in cut])
        return out

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if "<|" in text or not PLAIN.fullmatch(text):
            return self._whole(text)
        words, kept = text.lower().split(), self.kept
        got = list(map(kept.get, words))
        if new := [w for w, x in zip(words, got) if x is None]:
            found = self._encoded(dict.fromkeys(new))
            got = [found[w] if x is None else x for w, x in zip(words, got)]
            if len(kept) < CACHED:
                kept.update(found)
        return b"".join(got)


def tokens(path: str) -> Tokens:
    return kept(("tokens", path), lambda: Tokens(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, piece, start, length, ids_crc32: each document's ids and the end id, cut only where longer than capacity.

    A null text is empty and gives the end id alone; a repeated row gives its pieces again; a null identifier stays null; an
    empty table gives no pieces; other columns of docs play no part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, end = tokens(path), np.array([end_id], "<u4").tobytes()
        for frame in frames:
            rows = []
            for d, text in zip(frame.id, frame.text):
                ids = t.ids(text) + end
                rows += [(d, k, at // 4, min(len(ids) - at, 4 * capacity) // 4, zlib.crc32(ids[at : at + 4 * capacity])) for k, at in enumerate(range(0, len(ids), 4 * capacity))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"]).astype({"id": frame.id.dtype})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "id {id}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", "doc")


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """The pieces with sequence_id and offset. Each task packs about per_task pieces in the order of a hash of their
    identifiers, which mixes lengths and, as the order is total, gives the same sequences when a task runs again.

    A task leaves at most open_bins sequences partly filled, however many pieces it has. Repeated pieces are pieces of their
    own, null identifiers stay null, an empty table gives an empty result, and further columns go along unchanged; columns
    named sequence_id, offset or _h are not allowed."""
    n = max(1, -(-pieces_df.count() // per_task))
    kind = {f.name: f.dataType.simpleString() for f in pieces_df.schema}
    out = ", ".join(f"{c} {'{id}' if c == 'doc' else k}" for c, k in kind.items()) + ", sequence_id long, offset long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for frame in frames:
            got = [bins.put(int(x)) for x in frame.length]
            yield frame.assign(sequence_id=[base + b for b, _ in got], offset=[o for _, o in got]).drop(columns="_h")

    dealt = pieces_df.withColumn("_h", F.xxhash64("doc", "piece"))
    columns = [*kind, "_h"]
    return map_rows(dealt.select(columns).repartition(n, "_h").sortWithinPartitions("_h", *kind), run, out, ("doc",))
