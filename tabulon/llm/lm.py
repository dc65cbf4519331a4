"""Language-model scores by online logistic context mixing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, SPACE, hashed_words, joined, mix64, parts_of, stored

_U = np.uint64
_ODD1, _ODD2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9)
#: Words that have a code of their own (the most frequent ones, of two occurrences or more), characters worked on at once.
CODED, PART = 65_536, 1 << 19
#: Words' history that tells the script, and the upper ends of the shares of words beyond ASCII in it.
HISTORY, SHARES = 32, (0.0, 0.1, 0.4)
SCRIPTS = len(SHARES) + 1
#: Bits of the hashed tables for a word's code at most: by the word before, and the two before.
WORD_BITS = (21, 21)
#: Bits of the hashed tables for spelling: order 1, 2 and 3 within a word, and the whole word so far.
SPELL_BITS = (16, 18, 18, 19)
#: Words beyond this many bytes are spelled in pieces of so many; tokens and words of one step of learning; parts of a table.
LONGEST, STEP, PARTS = 40, 4096, 64
#: Leading bits of a word's hash by which it is looked up.
LEADING = 18
RATE, BINS, BELIEF, SMOOTH = 0.02, 24, 30.0, 0.4
END = mix64(np.array([0xE0D], _U))[0]


def taken(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at] for places that are all inside, which needs no look at each of them."""
    return table.take(at, mode="clip")


class Mixing:
    """Bit predictors over tables of counts, mixed in the logistic domain by weights that a gate selects, and refined by
    what came of such predictions before. All that is learned adds up: tables, refinements, and weights times their use.

    While it learns, each step is predicted with what the steps before have left, then the weights move along its coding
    gradient and its bits are counted."""

    def __init__(self, slots: int, inputs: int, gates: int, start: list[float]):
        self.counts = np.zeros(slots * 2, np.uint32)
        self.weights = np.tile(np.array(start, np.float32), (gates, 1))
        self.used = np.zeros(gates)
        self.bins = np.zeros((gates * BINS, 2))
        self.frozen: np.ndarray | None = None

    def freeze(self) -> None:
        """Prepares for predictions only: each slot's stretched probability, its last four bits replaced by how many bits
        its number of events has, so that one look-up gives both; and the refined probability of each bin."""
        n = self.counts.reshape(-1, 2)
        logs = np.log(n + np.float32(SMOOTH), dtype=np.float32)
        sure = np.minimum(np.log2(n.sum(1, dtype=np.float32) + 1), 15).astype(np.int32)
        self.frozen = (((logs[:, 1] - logs[:, 0]).view(np.int32) & ~np.int32(15)) | sure).view(np.float32)
        # the mean of p and the refined (ones + BELIEF p) / (all + BELIEF), as p times one number plus another
        half = 0.5 / (self.bins.sum(1) + BELIEF)
        self.times, self.plus = (0.5 + BELIEF * half).astype(np.float32), (self.bins[:, 1] * half).astype(np.float32)
        self.counts = np.zeros(0, np.uint32)

    def inputs(self, slots: np.ndarray, gating: int) -> tuple[np.ndarray, np.ndarray]:
        """Stretched probabilities of slots, and how many bits the numbers of events of the rows from `gating` on have (up to
        15, once frozen)."""
        if self.frozen is not None:
            x = taken(self.frozen, slots)
            return x, x[gating:].view(np.int32) & 15
        n = taken(self.counts.view(_U), slots).view(np.uint32).reshape(*slots.shape, 2)
        zero, one = n[..., 0].astype(np.float32), n[..., 1].astype(np.float32)
        sure = ((zero[gating:] + one[gating:] + np.float32(1)).view(np.int32) >> 23) - 127
        one += np.float32(SMOOTH)
        zero += np.float32(SMOOTH)
        one /= zero
        return np.log(one, out=one), sure

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixed probability of a 1, and the bin by which it is refined."""
        weights = np.ascontiguousarray(self.weights.T)
        z = taken(weights[0], gate)
        z *= x[0]
        for k in range(1, len(x)):
            w = taken(weights[k], gate)
            w *= x[k]
            z += w
        z = np.clip(z, np.float32(-12), np.float32(12), out=z)
        place = ((z + np.float32(12)) * np.float32((BINS - 1) / 24) + np.float32(0.5)).astype(np.int64)
        place += gate * BINS
        p = np.exp(np.negative(z, out=z), out=z)
        p += 1
        return np.divide(np.float32(1), p, out=p), place

    def cost(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Nats of the bits, by the mean of the mixed and the refined probability."""
        p, place = self.mixed(x, gate)
        p *= taken(self.times, place)
        p += taken(self.plus, place)
        p -= (bit ^ 1).astype(np.float32)
        np.abs(p, out=p)
        return np.negative(np.log(p, out=p), out=p)

    def learn(self, slots: np.ndarray, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        p, place = self.mixed(x, gate)
        err = bit.astype(np.float32) - p
        many = np.bincount(gate, minlength=len(self.used))
        for k in range(len(x)):
            self.weights[:, k] += RATE * np.bincount(gate, err * x[k], minlength=len(many)) / np.sqrt(np.maximum(1, many))
        np.clip(self.weights, -1, 2, out=self.weights)
        self.used += many
        self.bins += np.bincount(place * 2 + bit, minlength=self.bins.size).reshape(-1, 2)
        at = slots * 2
        at += bit
        np.add.at(self.counts, at.ravel(), np.uint32(1))

    def sent(self) -> pd.DataFrame:
        """What was learned, in PARTS rows of counts (as they are, or as places and counts where most are 0) and one of the rest."""
        rows = []
        for i, x in enumerate(np.array_split(self.counts, PARTS)):
            at = np.flatnonzero(x)
            if len(at):
                rows.append((i, b"", packed(x)) if len(at) * 3 > len(x) else (i, at.astype(np.uint32).tobytes(), packed(x[at])))
        rest = np.concatenate([(self.weights * self.used[:, None]).ravel(), self.used, self.bins.ravel()])
        return pd.DataFrame([*rows, (PARTS, b"", rest.astype(np.float64).tobytes())], columns=["part", "at", "counts"])

    def gather(self, learned: DataFrame) -> Mixing:
        """Takes over the sums of what all tasks learned, which are of a fixed size."""
        size = [len(x) for x in np.array_split(self.counts, PARTS)]
        parts = np.array_split(np.zeros(len(self.counts), np.int64), PARTS)
        for r in learned.repartition(PARTS, "part").mapInPandas(_adder(size), "part int, counts binary").collect():
            if r.part < PARTS:
                parts[r.part] = unpacked(r.counts, size[r.part])
                continue
            rest = np.frombuffer(r.counts, np.float64)
            a, b = self.weights.size, self.weights.size + len(self.used)
            used = np.maximum(rest[a:b], 1e-9)[:, None]
            self.weights = np.where(rest[a:b, None] > 0, rest[:a].reshape(self.weights.shape) / used, self.weights).astype(np.float32)
            self.bins = rest[b:].reshape(self.bins.shape)
        # logs are taken of 32-bit counts: beyond them both sides of all contexts are halved alike
        whole = np.concatenate(parts)
        while whole.max(initial=0) >= 1 << 32:
            whole >>= 1
        self.counts = whole.astype(np.uint32)
        self.freeze()
        return self


def _adder(size: list[int]):
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, at, x in zip(frame["part"], frame["at"], frame["counts"]):
                if part == PARTS:
                    total[part] = total.get(part, 0) + np.frombuffer(x, np.float64)
                elif at:
                    where = np.frombuffer(at, np.uint32)
                    total.setdefault(part, np.zeros(size[part], np.int64))[where] += unpacked(x, len(where))
                else:
                    total[part] = total.get(part, 0) + unpacked(x, size[part])
        for part, x in total.items():
            yield pd.DataFrame({"part": [part], "counts": [x.tobytes() if part == PARTS else packed(x)]})

    return add


def packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest of 2, 4 or 8 bytes that holds them all."""
    most = int(counts.max(initial=0))
    return counts.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The n counts of packed()."""
    return np.frombuffer(raw, f"u{len(raw) // n}").astype(np.int64)


class Speller:
    """Spells words bit by bit, each word and its end by contexts within it."""

    offsets = np.append(0, np.cumsum([1 << b for b in SPELL_BITS]))

    def __init__(self):
        self.mixing = Mixing(int(self.offsets[-1]), len(SPELL_BITS), 8 * 5, [0.4] * len(SPELL_BITS))

    def bits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of the words and their ends: the word's number, its contexts' slots (one row for each order), the bit."""
        cut = [(i, w[a : a + LONGEST]) for i, w in enumerate(words) for a in range(0, max(1, len(w)), LONGEST)]
        length = np.array([len(w) + 1 for _, w in cut])
        of = np.repeat([i for i, _ in cut], length)
        data = np.frombuffer(b" ".join(w for _, w in cut) + b" ", np.uint8).astype(_U)
        begin = np.append(0, np.cumsum(length)[:-1])
        place = np.arange(len(data)) - np.repeat(begin, length)
        back = [np.where(place >= j, np.roll(data, j), _U(0)) for j in (1, 2, 3)]
        own = mix64(data + (place.astype(_U) << _U(8)) + _U(3))
        total = np.cumsum(own)
        whole = total - own - np.repeat(np.append(_U(0), total[begin[1:] - 1]), length)
        byte_context = [back[0], back[0] | back[1] << _U(8), back[0] | back[1] << _U(8) | back[2] << _U(16), whole]
        node = np.stack([(data | _U(256)) >> _U(8 - j) for j in range(8)], 1)  # the byte's bits so far, after a one
        spread = node * _ODD1
        slots = np.empty((len(SPELL_BITS), len(data) * 8), np.int64)
        for k, bits in enumerate(SPELL_BITS):
            if k == 0:
                slots[k] = ((byte_context[0] << _U(8))[:, None] + node).astype(np.int64).ravel()
            else:
                h = slots[k].view(_U).reshape(-1, 8)
                np.add(mix64(byte_context[k] * _U(8) + _U(k))[:, None], spread, out=h)
                h *= _ODD2
                h >>= _U(64 - bits)
                slots[k] += self.offsets[k]
        bit = ((data[:, None] >> np.arange(7, -1, -1, dtype=_U)) & _U(1)).astype(np.int64).ravel()
        return np.repeat(of, 8), slots, bit

    def _seen(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, sure = self.mixing.inputs(slots, len(SPELL_BITS) - 1)
        return x, np.tile(np.arange(8), slots.shape[1] // 8) * 5 + np.minimum(sure[-1], 4)

    def learn(self, words: list[bytes]) -> None:
        for a in range(0, len(words), STEP):
            _, slots, bit = self.bits(words[a : a + STEP])
            self.mixing.learn(slots, *self._seen(slots), bit)

    def costs(self, words: list[bytes]) -> np.ndarray:
        """Each word's cost in nats; what a long word costs is the sum over all its bits."""
        out = np.zeros(len(words))
        for a in range(0, len(words), STEP):
            part = words[a : a + STEP]
            of, slots, bit = self.bits(part)
            out[a : a + STEP] = np.bincount(of, self.mixing.cost(*self._seen(slots), bit), minlength=len(part))
        return out


class Code:
    """A prefix code of the coded words, the end and the rest (any other word), by their counts: its bits are what the
    contexts predict. A word's path is its inner nodes and the bits that are taken there."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, end: int, rest: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        # hashes are even: where those with the same leading bits begin, and how many these are at most
        self.begin = np.searchsorted(self.words, np.arange(1 << LEADING, dtype=_U) << _U(64 - LEADING)).astype(np.int32)
        self.deepest = int(np.diff(self.begin, append=len(words)).max())
        self.end, self.rest = len(words), len(words) + 1
        weight = np.append(self.counts, [end, rest]).astype(np.int64)
        n = len(weight)
        heap = [(int(w), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        mass = np.append(weight, np.zeros(n - 1, np.int64))
        self.static = np.zeros(n - 1, np.float32)
        for at in range(n, 2 * n - 1):
            (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = at
            side[b] = 1
            mass[at] = w0 + w1
            self.static[at - n] = math.log((w1 + SMOOTH) / (w0 + SMOOTH))
            heapq.heappush(heap, (w0 + w1, at))
        nodes, bits, self.length = [], [], np.zeros(n, np.int64)
        for i in range(n):
            at, path = i, []
            while at != 2 * n - 2:
                path.append((parent[at] - n, side[at]))
                at = parent[at]
            self.length[i] = len(path)
            nodes += [x for x, _ in reversed(path)]
            bits += [y for _, y in reversed(path)]
        self.first = np.cumsum(self.length) - self.length
        self.nodes, self.bits = np.array(nodes, np.int32), np.array(bits, np.int8)
        self.steps = self.nodes << 1 | self.bits  # both in one look-up

    def symbols(self, keys: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.where(is_end, self.end, self.rest)
        at = taken(self.begin, (keys >> _U(64 - LEADING)).view(np.int64))
        for _ in range(self.deepest):
            at += taken(self.words, at) < keys
        known = taken(self.words, at) == keys
        return np.where(is_end, self.end, np.where(known, at, self.rest))


class Tokens:
    """The tokens of some texts: each text's words, as hashes, and one end."""

    def __init__(self, texts: list[str]):
        data, starts = joined(texts)
        self.data = np.frombuffer(data.tobytes().translate(LOWER_BYTES), np.uint8)
        self.size = np.diff(starts) - 1
        word, first, self.begin, self.bytes = hashed_words(self.data, starts)
        n = np.diff(first)
        self.length = n + 1
        self.key = np.full(len(word) + len(n), END)
        self.at = np.arange(len(word)) + np.repeat(np.arange(len(n)), n)
        self.key[self.at] = word
        self.is_end = np.ones(len(self.key), bool)
        self.is_end[self.at] = False
        self.head = np.cumsum(self.length) - self.length

    def look_back(self) -> Tokens:
        """Adds what comes before each token: hashes of the word before and of the two before, and the script."""
        place = np.arange(len(self.key)) - np.repeat(self.head, self.length)
        before = [np.where(place >= j, np.roll(self.key, j), _U(0)) for j in (1, 2)]
        self.contexts = [mix64(before[0] + _U(11)), mix64(before[0] * _ODD1 + before[1] + _U(12))]
        # the share of words beyond ASCII among the last words of the text
        beyond = np.zeros(len(self.key), np.int64)
        if len(self.at):
            beyond[self.at] = np.add.reduceat((self.data > 127).astype(np.int64), self.begin) > 0
        total = np.append(0, np.cumsum(beyond))
        here = np.arange(len(self.key))
        back = np.maximum(here - HISTORY, np.repeat(self.head, self.length))
        self.script = np.searchsorted(SHARES, (total[here] - total[back]) / np.maximum(1, here - back))
        return self

    def spelled(self, which: np.ndarray | pa.Array) -> pa.Array:
        """The lower-cased bytes of the words of these numbers; null where a number is."""
        letters = self.data[~SPACE.take(self.data, mode="clip")]
        ends = np.append(0, np.cumsum(self.bytes)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(self.bytes), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        return words.take(pa.array(which))


class Coder:
    """Predicts the bits of words' codes by the words before."""

    def __init__(self, code: Code, tokens: int):
        self.code = code
        most = max(12, int(tokens).bit_length())
        self.table_bits = tuple(min(b, most) for b in WORD_BITS)
        self.offsets = np.append(0, np.cumsum([len(code.static) * SCRIPTS, *(1 << b for b in self.table_bits)]))
        self.mixing = Mixing(int(self.offsets[-1]), 4, 6 * 4, [0.1, 0.5, 0.4, 0.3])

    def events(self, t: Tokens, symbols: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of the codes of tokens a to b: where each token's begin, the slots, the code's own odds, the bit."""
        symbol = symbols[a:b]
        n = self.code.length[symbol]
        begin = np.cumsum(n) - n
        at = np.repeat(self.code.first[symbol] - begin, n)
        at += np.arange(len(at))
        node = taken(self.code.steps, at).astype(np.int64)
        bit = node & 1
        node >>= 1
        slots = np.empty((3, len(at)), np.int64)
        np.multiply(node, SCRIPTS, out=slots[0])
        slots[0] += np.repeat(t.script[a:b], n)
        spread = node.view(_U) * _ODD1
        for k, bits in enumerate(self.table_bits):
            h = slots[k + 1].view(_U)
            np.add(np.repeat(t.contexts[k][a:b], n), spread, out=h)
            h *= _ODD2
            h >>= _U(64 - bits)
            slots[k + 1] += self.offsets[k + 1]
        return begin, slots, taken(self.code.static, node), bit

    def _seen(self, slots: np.ndarray, static: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, sure = self.mixing.inputs(slots, 1)
        return [static, *x], ((np.minimum(sure[0], 10) >> 1) * 4 + (np.minimum(sure[1], 6) >> 1)).astype(np.int64)

    def learn(self, t: Tokens) -> None:
        symbols = self.code.symbols(t.key, t.is_end)
        for a in range(0, len(t.key), STEP):
            _, slots, static, bit = self.events(t, symbols, a, min(len(t.key), a + STEP))
            self.mixing.learn(slots, *self._seen(slots, static), bit)

    def costs(self, t: Tokens, symbols: np.ndarray) -> np.ndarray:
        """Nats of each token's code; every code has a bit or more."""
        out = []
        for a in range(0, len(t.key), STEP):
            begin, slots, static, bit = self.events(t, symbols, a, min(len(t.key), a + STEP))
            out.append(np.add.reduceat(self.mixing.cost(*self._seen(slots, static), bit), begin, dtype=np.float64))
        return np.concatenate(out) if out else np.zeros(0)


def word_counts(texts: DataFrame, held: int = 1_000_000) -> DataFrame:
    """w (a word's 64-bit hash), c (its count), s (its bytes, lower-cased) of the column `text`. Tasks add up what they hold."""

    def merged(found: list[tuple]) -> pa.RecordBatch:
        keys, counts, spelled = zip(*found)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        total = np.add.reduceat(np.concatenate(counts)[order], start) if len(key) else key
        words = pa.concat_arrays(spelled).take(pa.array(order[start]))
        return pa.record_batch([pa.array(key[start].view(np.int64)), pa.array(total.astype(np.int64)), words], ["w", "c", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in parts_of(texts, PART):
                t = Tokens(texts[a:b])
                key, first, count = np.unique(t.key[t.at], return_index=True, return_counts=True)
                found.append((key, count, t.spelled(first)))
                if sum(len(x[0]) for x in found) > held:
                    yield merged(found)
                    found = []
        if found:
            yield merged(found)

    # a task's words differ already: they are sorted once, where they meet
    return texts.select("text").mapInArrow(run, "w long, c long, s binary").repartition("w").groupBy("w").agg(F.sum("c").alias("c"), F.min("s").alias("s"))


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", coded: int = CODED) -> DataFrame:
    """Per input row: id_col, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    A token is a lower-cased (A-Z) word, or the end that closes each text. base_score adds log10((c + 1) / (N + V + 1)).
    score is the log10 probability of the text under the model, a product over its tokens. The `coded` most frequent words
    and the end have a prefix code; its bits are predicted from hashed contexts across words, mixed by gated weights and
    refined. Any other word is the code's rest, then, if it is known, drawn by its count, or spelled, its bits predicted from
    contexts within the word.

    1. Exact word counts of all training texts, in a table. 2. The speller learns from each distinct training word once, the
    coder from all training texts; each task learns online, and tables, weights and refinements add up. They have a bounded
    size, are sent to the tasks, and change no more: a text's score depends on the training texts and itself only. 3. Texts
    are scored where they are read; their other words go to the table of counts and their sums come back.

    A null or empty text has the end only; a null identifier counts as a row of its own (`training` decides on it; null
    counts as not training); repeated rows count again and score alike; an empty table gives an empty result; other columns
    of docs play no part."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    counts = stored(word_counts(rows.where("train")), "words")
    ends = rows.where("train").count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()[0]
    tokens, types = sums.n + ends, sums.v + (ends > 0)
    top = counts.where("c > 1").select("w", "c").orderBy(F.desc("c"), "w").limit(coded).collect()
    known = np.array([r.c for r in top], np.int64)
    rest = sums.n - int(known.sum())
    code = Code(np.array([r.w for r in top], np.int64).view(_U), known, ends + 1, rest + 1)
    # of the other words, the chance of a new one: as many as words seen once, against those seen again
    fresh = (sums.once + 1) / (sums.once + 2 * sums.twice + (rest - sums.once) + 2)

    def learn_spelling(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Speller()
        for frame in frames:
            s.learn(frame["s"].tolist())
        yield s.mixing.sent()

    shared_code = spark.sparkContext.broadcast(code)

    def learn_code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Coder(shared_code.value, tokens)
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in parts_of(texts, PART):
                c.learn(Tokens(texts[a:b]).look_back())
        yield c.mixing.sent()

    sent = "part int, at binary, counts binary"
    speller, coder = Speller(), Coder(code, tokens)
    speller.mixing.gather(counts.select("s").mapInPandas(learn_spelling, sent))
    coder.mixing.gather(rows.where("train").select("text").mapInPandas(learn_code, sent))
    shared_coder, shared_speller = spark.sparkContext.broadcast(coder), spark.sparkContext.broadcast(speller)
    log_all = math.log10(tokens + types + 1)

    kind = f"r long, id {rows.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, base double, score double, bytes long, w long, m long, s binary"
    names = ["r", "id", "n_tokens", "n_known", "base", "score", "bytes", "w", "m", "s"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Coder = shared_coder.value
        number = TaskContext.get().partitionId() << 40
        base_of = np.append(np.log10(c.code.counts + 1.0), [math.log10(ends + 1), 0.0]) - log_all
        none = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
        whole, real = pa.int64(), pa.float64()
        for batch in batches:
            texts, train = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in parts_of(texts, PART):
                t = Tokens(texts[a:b]).look_back()
                symbol = c.code.symbols(t.key, t.is_end)
                here = symbol < c.code.rest
                base = np.where(here, base_of[symbol], 0.0)
                told = here & ~(t.is_end & (ends == 0))
                part = np.arange(number, number + b - a)
                number += b - a
                add = lambda x: pa.array(np.add.reduceat(x, t.head))
                score = np.add.reduceat(c.costs(t, symbol), t.head) / -math.log(10)
                ids = batch.column(0).slice(a, b - a)
                yield pa.record_batch([pa.array(part), ids, pa.array(t.length), add(told.astype(np.int64)), add(base), pa.array(score), pa.array(t.size), *none(b - a, whole, whole, pa.binary())], names)
                other = np.flatnonzero(~here)
                if not len(other):
                    continue
                doc = np.repeat(np.arange(b - a), t.length)[other]
                order = np.lexsort((t.key[other], doc))
                other, doc = other[order], doc[order]
                start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (t.key[other[1:]] != t.key[other[:-1]])))
                many = np.diff(np.append(start, len(other)))
                word, doc = np.searchsorted(t.at, other[start]), doc[start]
                spelled = t.spelled(pa.array(word, mask=train[a:b][doc]))  # words of training texts are known
                yield pa.record_batch([pa.array(part[doc]), *none(len(doc), ids.type, whole, whole, real, real, whole), pa.array(t.key[other[start]].view(np.int64)), pa.array(many), spelled], names)

    judged = stored(rows.mapInArrow(judge, kind), "scored")

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared_speller.value
        for frame in frames:
            cost = -s.costs(frame["s"].tolist()) / math.log(10)
            yield pd.DataFrame({"r": frame["r"], "n": 0, "base": -log_all * frame["m"], "score": frame["m"] * (cost + math.log10(fresh))})

    others, sums_of = judged.where("w IS NOT NULL"), "r long, n long, base double, score double"
    told = others.join(counts.select("w", "c").hint("shuffle_hash"), "w").select("r", F.col("m").alias("n"), (F.col("m") * (F.log10(F.col("c") + 1) - log_all)).alias("base"), (F.col("m") * (F.log10("c") + (math.log10((1 - fresh) / rest) if rest else 0.0))).alias("score"))
    # words of training texts are all known
    new = others.where("s IS NOT NULL").join(counts.select("w").hint("shuffle_hash"), "w", "left_anti").select("r", "m", "s").mapInPandas(spell, sums_of)
    more = told.union(new).groupBy("r").agg(F.sum("n").alias("n"), F.sum("base").alias("b"), F.sum("score").alias("p"))
    whole = judged.where("w IS NULL").select("r", "id", "n_tokens", "n_known", "base", "score", "bytes").join(more, "r", "left")
    plus = lambda c, x: F.col(c) + F.coalesce(F.col(x), F.lit(0))
    return whole.select(F.col("id").alias(id_col), "n_tokens", plus("n_known", "n").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base", "b").alias("base_score"), plus("score", "p").alias("score"), (-plus("score", "p") * math.log2(10) / F.greatest(F.lit(1), "bytes")).alias("bits_per_byte"))
