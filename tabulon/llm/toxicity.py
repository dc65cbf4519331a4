"""Toxicity scores by noisy-channel deobfuscation: a Viterbi decoder restores disguised words, then words are scored."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import batched, count, islice, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, map_rows, stored

#: Labelled rows that are read to fit the classifier, and features that it keeps, at most.
SAMPLE, FEATURES = 20_000, 20_000
#: Least evidence (a likelihood-ratio statistic) and least log odds of a feature.
LEAST_G2, LEAST_ODDS = 20.0, 1.0
#: Words whose trigrams are counted at once, words whose counts a task holds, and features that it counts before it sends its sums.
WORDS_AT_ONCE, WORDS_HELD, FEATURES_HELD = 1 << 16, 1 << 17, 250_000
#: Trigrams that the tasks get whole, at most; of more, as many as three times this of the most frequent pieces (trigrams and
#: their pairs), and a bit for each of the others among so many.
SHARED, RARE_BITS = 60_000, 1 << 24
PREFIXES = (4, 5, 6, 7)
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SIGN_COST, DROP_COST, LOST_COST, REPEAT_COST, HALVED_COST = 2.0, 1.0, 6.0, 0.7, 2.5
#: What a word break in a run of words costs besides its characters, and the length from which a token is such a run.
BREAK_COST, PHRASE = 2.0, 61
EDGE = "\x00"
LETTERS = re.compile(r"[^\W\d_]+")
#: Four or more single characters between white space: a word spelled out.
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
#: A run of one character, a doubled character, a doubled sign.
RUN, DOUBLED, SIGNS = re.compile(r"(.)\1*", re.S), re.compile(r"(.)\1"), re.compile(r"(\W)\1")
OUTSIDE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…“”‘’«»¿¡"


@dataclass
class CharModel:
    """Character trigrams of words, with interpolated lower orders. counts: trigram to count, words padded with EDGE."""

    counts: dict[str, int]
    cost: dict[str, float] = field(default_factory=dict)
    #: How often a count was asked for that isn't known here.
    asks: int = 0

    def __post_init__(self):
        bi, uni = Counter(), Counter()
        for g, n in self.counts.items():
            bi[g[1:]] += n
            uni[g[2]] += n
        ctx2, ctx1 = Counter(), Counter()
        for g, n in self.counts.items():
            ctx2[g[:2]] += n
        for g, n in bi.items():
            ctx1[g[0]] += n
        self.total, self.uni, self.bi, self.ctx1, self.ctx2 = sum(uni.values()) or 1, uni, bi, ctx1, ctx2

    def __call__(self, key: str) -> float:
        """Nats that the last of three characters costs after the first two."""
        if (x := self.cost.get(key)) is None:
            p1 = (self.uni[key[2]] + 0.1) / (self.total + 100)
            p2 = (self.bi[key[1:]] + 2 * p1) / (self.ctx1[key[1]] + 2)
            x = self.cost[key] = -math.log((self.counts.get(key, 0) + 2 * p2) / (self.ctx2[key[:2]] + 2))
        return x


@dataclass
class Chars:
    """Counts of more trigrams than every task should hold. Pieces are trigrams, their last two characters, and their first
    two with two EDGEs behind. shared: counts of the most frequent pieces; rare: a bit for each of the others, by their
    hash; last and middle: how many trigrams have a character there; table: all pieces, on the cluster only."""

    shared: dict[str, int]
    rare: bytes
    last: dict[str, int]
    middle: dict[str, int]
    table: DataFrame | None = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}


class PartModel(CharModel):
    """A CharModel over Chars. What a text asks for of the other pieces is noted in `asked`; its readings count only once it
    asks for nothing: its pieces then are in `told`, with the exact counts, and a piece that isn't there doesn't occur."""

    def __init__(self, chars: Chars):
        self.chars, self.cost, self.asks, self.total = chars, {}, 0, sum(chars.last.values()) or 1
        self.asked: set[str] = set()
        self.told: dict[str, int] | None = None

    def count(self, piece: str) -> int:
        if (n := self.chars.shared.get(piece)) is not None:
            return n
        if self.told is not None:
            return self.told.get(piece, 0)
        at = zlib.crc32(piece.encode("utf-8", "surrogatepass")) % RARE_BITS
        if self.chars.rare[at >> 3] >> (at & 7) & 1:
            self.asked.add(piece)
            self.asks += 1
        return 0

    def __call__(self, key: str) -> float:
        if (x := self.cost.get(key)) is None:
            before = self.asks
            p1 = (self.chars.last.get(key[2], 0) + 0.1) / (self.total + 100)
            p2 = (self.count(key[1:]) + 2 * p1) / (self.chars.middle.get(key[1], 0) + 2)
            x = -math.log((self.count(key) + 2 * p2) / (self.count(key[:2] + 2 * EDGE) + 2))
            if self.asks == before:
                self.cost[key] = x
        return x


def char_model(chars: dict[str, int] | Chars) -> CharModel:
    return PartModel(chars) if isinstance(chars, Chars) else CharModel(chars)


@lru_cache(maxsize=1 << 16)
def arcs_of(c: str, n: int, breaks: bool) -> tuple[tuple[str, float], ...]:
    """What a run of n (3: or more) of one character may stand for ("" for nothing) and the cost: letters stand for
    themselves and signs for letters; a run may be a repetition of one; anything else, and any sign, may be a separator.
    With `breaks`, a word may end before any letter (" ")."""
    arcs: list[tuple[str, float]] = []
    for letter in c if c.isalpha() else LEET.get(c, ""):
        price = 0.0 if letter == c else SIGN_COST
        arcs.append((letter, price + (0 if n == 1 else HALVED_COST if n == 2 else REPEAT_COST)))
        if n > 1:
            arcs.append((letter * 2, price + (0 if n == 2 else REPEAT_COST)))
            if breaks:
                arcs.append((letter + " " + letter, price + (0 if n == 2 else REPEAT_COST)))
    if breaks:
        arcs += [(" " + letters, price) for letters, price in arcs]
    if not c.isalpha():
        arcs.append(("", LOST_COST if c in LEET and n == 1 else DROP_COST))
    return tuple(arcs)


def lattice(token: str, breaks: bool = False) -> list[tuple[tuple[str, float], ...]]:
    """The arcs of each run of one character."""
    return [arcs_of(m[1], min(3, len(m[0])), breaks) for m in RUN.finditer(token)]


def viterbi(token: str, model: CharModel, breaks: bool = False) -> str:
    """The cheapest reading of a token's lattice under the character model, its words with blanks between where `breaks`
    allows several; of equal ones that whose arcs come first. Time and memory are linear in the token's length."""
    start, known = EDGE + EDGE, model.cost
    # a state is the last two characters; with it go its cost and what was read, linked from the last arc back
    states: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for arcs in lattice(token, breaks):
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, said) in states.items():
            for letters, price in arcs:
                if breaks and state == start and letters[:1] == " ":
                    continue
                s, total = state, cost + price
                for c in letters:
                    if c == " ":
                        total += model(s + EDGE) + BREAK_COST
                        s = start
                        continue
                    key = s + c
                    x = known.get(key)
                    total += model(key) if x is None else x
                    s = key[1:]
                if s not in after or total < after[s][0]:
                    after[s] = (total, (said, letters))
        states = after
    said = min(states.items(), key=lambda x: x[1][0] + model(x[0] + EDGE))[1][1]
    read = []
    while said:
        said, letters = said
        read.append(letters)
    return "".join(reversed(read))


class Restorer:
    """Restored words of texts; what a token is restored to is kept, for up to `most` tokens."""

    def __init__(self, model: CharModel, most: int = 200_000):
        self.model, self.most, self.kept = model, most, {}

    def word(self, token: str) -> str:
        """A lower-cased token's word: bare letters, none doubled, as they are, others by the decoder. From PHRASE
        characters, a token may be several words, which are given with blanks between."""
        token = token.strip(OUTSIDE) if token[:1] in OUTSIDE or token[-1:] in OUTSIDE else token
        if not token or (LETTERS.fullmatch(token) and not DOUBLED.search(token)):
            return token
        return viterbi(token, self.model, len(token) >= PHRASE)

    def signed(self, token: str) -> str:
        """As word(), with signs at the ends as letters where that reads better."""
        if (token[-1:] in LEET or token[:1] in LEET) and LETTERS.search(token) and not SIGNS.search(token):
            return viterbi(token, self.model, len(token) >= PHRASE)
        return self.word(token)

    def spaced(self, low: str) -> set[str]:
        """The words of a lower-cased text's runs of single characters, each run decoded as a whole."""
        return {w for m in SPACED.finditer(low) for w in viterbi("".join(m[0].split()), self.model, True).split()}

    def texts_words(self, text: str) -> set[str]:
        """The distinct restored words of a whole text."""
        low = text.lower()
        words = set()
        kept, most = self.kept, self.most
        tokens = set(low.split())
        for t in tokens:
            w = kept.get(t)
            if w is None:
                before = self.model.asks
                w = self.signed(t)
                if len(kept) < most and self.model.asks == before:
                    kept[t] = w
            words.update(w.split())
        words |= self.spaced(low)
        words.discard("")
        return words


def word_features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}~" for k in PREFIXES if len(word) > k]


def trigrams(words: dict[str, int]) -> Counter:
    """Counts of the character trigrams of counted words, those of letters only and of up to 60 of them; EDGE pads words."""
    bare = ((w, n) for w, n in ((t.strip(OUTSIDE), n) for t, n in words.items()) if 0 < len(w) <= 60 and LETTERS.fullmatch(w))
    grams: Counter = Counter()
    for part in batched(bare, WORDS_AT_ONCE):
        grams.update(_trigrams(part))
    return grams


def _trigrams(bare: Sequence[tuple[str, int]]) -> dict[str, int]:
    code = np.frombuffer("".join(f"{EDGE}{EDGE}{w}{EDGE}" for w, _ in bare).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w, _ in bare])
    # a word's first trigram begins with it, its last two characters before the next word
    at = np.arange(int((size + 1).sum())) + np.repeat(2 * np.arange(len(size)), size + 1)
    key, of = np.unique(code[at] << 42 | code[at + 1] << 21 | code[at + 2], return_inverse=True)
    count = np.bincount(of, np.repeat([n for _, n in bare], size + 1)).astype(np.int64)
    return {chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF): n for k, n in zip(key.tolist(), count.tolist())}


def char_counts(docs: DataFrame, text_col: str = "text", shared: int | None = None) -> dict[str, int] | Chars:
    """Character trigrams of the letters-only words of all texts, none left out; each task sends its sums. Up to `shared`
    (SHARED) of them come whole, of more their most frequent pieces and the table of all of them."""
    shared = SHARED if shared is None else shared

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: Counter = Counter()
        for frame in frames:
            words: Counter = Counter()
            for text in frame.text:
                if text:
                    words.update(text.lower().split())
                if len(words) > WORDS_HELD:
                    grams.update(trigrams(words))
                    words.clear()
            grams.update(trigrams(words))
        yield pd.DataFrame({"gram": list(grams), "n": list(grams.values())}).astype({"gram": "object", "n": "int64"})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(lean(run), "gram string, n long")
    grams = stored(rows.groupBy("gram").agg(F.sum("n").alias("n")), "trigrams")
    found = grams.limit(shared + 1).collect()
    if len(found) <= shared:
        return {r.gram: r.n for r in sorted(found)}
    part = lambda of: grams.groupBy(of.alias("piece")).agg(F.sum("n").alias("n"))
    of = lambda a, n: F.substring("gram", a, n)
    table = stored(grams.toDF("piece", "n").union(part(of(2, 2))).union(part(F.concat(of(1, 2), F.lit(2 * EDGE)))), "pieces")
    most = table.orderBy(F.desc("n"), "piece").limit(3 * shared).collect()
    rest = table.where((F.col("n") < most[-1].n) | (F.col("n") == most[-1].n) & (F.col("piece") > most[-1].piece))
    rest = rest.select((F.crc32("piece") % RARE_BITS).alias("at")).select(F.floor(F.col("at") / 32768).cast("int").alias("b"), (F.col("at") % 32768).alias("at"))
    rare = bytearray(RARE_BITS >> 3)
    for r in rest.groupBy("b").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        rare[r.b << 12 : r.b + 1 << 12] = r.bits
    one = lambda a: {r.piece: r.n for r in part(of(a, 1)).collect()}
    return Chars({r.piece: r.n for r in most}, bytes(rare), one(3), one(2), table)


def told(asked: DataFrame, chars: Chars) -> DataFrame:
    """Rows of a table, numbered by r, with the exact counts of the pieces in `asked`: pieces, counts (null: none occurs)."""
    found = asked.select("r", F.explode("asked").alias("piece")).join(chars.table, "piece").groupBy("r").agg(F.collect_list(F.struct("piece", "n")).alias("told"))
    return asked.drop("asked").join(found, "r", "left").withColumns({"pieces": F.col("told.piece"), "counts": F.col("told.n")}).drop("told")


def _numbers() -> Iterator[int]:
    return count(TaskContext.get().partitionId() << 40)


def _counts(frame: pd.DataFrame) -> Iterator[dict[str, int] | None]:
    """For each row, the counts that it was told; None where the tasks hold all counts."""
    if "pieces" not in frame:
        return repeat(None, len(frame))
    return ({} if p is None else dict(zip(p, map(int, n))) for p, n in zip(frame.pieces, frame["counts"]))


def _asking(rows: DataFrame, chars: Chars) -> DataFrame:
    """Rows (text, y, part) with the counts that their texts need."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, number = Restorer(char_model(chars)), _numbers()
        for frame in frames:
            asked = []
            for text in frame.text:
                r.model.asked.clear()
                r.texts_words(text)
                asked.append(sorted(r.model.asked))
            yield frame.assign(asked=asked, r=[*islice(number, len(frame))])

    asked = rows.select("text", "y", "part").mapInPandas(lean(run), "text string, y int, part long, asked array<string>, r long")
    return told(stored(asked, "asked"), chars).select("text", "y", "part", "pieces", "counts")


@dataclass
class Model:
    chars: dict[str, int] | Chars
    weights: dict[str, float]
    beta: tuple[float, float, float]


def _stats(words: set[str], weights: dict[str, float]) -> tuple[float, float]:
    """Sum over words of their strongest feature's weight, and the largest one; 0 without any."""
    found = [x for w in words if (x := max((weights[f] for f in word_features(w) if f in weights), default=None)) is not None]
    return sum(found), max(found, default=0.0)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p) + 1e-9
        penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
        step = np.linalg.solve(x.T @ (x * w[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE, features: int = FEATURES, shared: int | None = None) -> Model:
    """Character counts of all texts; word weights from labelled rows for which `training` holds, at most `sample` of
    them, those of the smallest hash of their identifier. Three in four choose the features and weights; the rest set
    how weights become a probability, so chance features don't look better than they are."""
    chars = char_counts(docs, shared=shared)
    chosen = labels.where(training & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)))
    columns = ["text", "y"]
    if isinstance(chars, Chars):
        rows, columns = _asking(rows, chars), ["text", "y", "pieces", "counts"]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, seen = Restorer(char_model(chars)), (Counter(), Counter())

        def sums() -> pd.DataFrame:
            keys = [*seen[0].keys() | seen[1].keys()]
            return pd.DataFrame({"f": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]}).astype({"f": "object", "clean": "int64", "toxic": "int64"})

        for frame in frames:
            for text, y, r.model.told in zip(frame.text, frame.y, _counts(frame)):
                seen[y].update({f for w in r.texts_words(text) for f in word_features(w)} | {""})
                if len(seen[0]) + len(seen[1]) > FEATURES_HELD:
                    yield sums()
                    seen[0].clear(), seen[1].clear()
        yield sums()

    counted = rows.where("part > 0").select(*columns).mapInPandas(lean(add), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = counted.where("f = ''").collect()
    n0, n1 = (total[0].clean, total[0].toxic) if total else (0, 0)
    if not n0 or not n1:  # one class or none: every text gets the share of that class
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(chars, {}, (math.log(share / (1 - share)), 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    both, share1 = F.col("toxic") + F.col("clean"), n1 / (n0 + n1)
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (part(F.col("toxic"), both * share1) + part(F.col("clean"), both * (1 - share1)))
    kept = counted.where("f <> ''").select("f", odds.alias("w"), g2.alias("g2")).where((F.col("g2") >= LEAST_G2) & (F.col("w") >= LEAST_ODDS))
    weights = {r.f: r.w for r in kept.orderBy(F.desc("g2"), "f").limit(features).collect()}

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(char_model(chars))
        for frame in frames:
            yield pd.DataFrame([(y, *_stats(r.texts_words(t), weights)) for t, y, r.model.told in zip(frame.text, frame.y, _counts(frame))], columns=["y", "s", "m"]).astype({"y": "int32", "s": "float64", "m": "float64"})

    held = rows.where("part = 0").select(*columns).mapInPandas(lean(measure), "y int, s double, m double").toPandas()
    if held.y.nunique() < 2:
        return Model(chars, weights, (-3.0, 1.0, 0.5))
    return Model(chars, weights, tuple(_fit_logistic(held[["s", "m"]].to_numpy(), held.y.to_numpy())))


class Scorer:
    """Scores of texts under a model. Tokens that were restored before are kept, up to `most` of them, then afresh."""

    def __init__(self, model: Model, most: int = 400_000):
        self.restorer, self.weights, self.beta, self.most = Restorer(char_model(model.chars)), model.weights, model.beta, most
        self.seen: set[str] = set()
        self.weighty: dict[str, list[tuple[str, float]]] = {}

    def weight(self, words) -> list[tuple[str, float]]:
        """The words that have a weighted feature, each with its strongest one's weight."""
        weights = self.weights
        known = ((w, max((weights[f] for f in word_features(w) if f in weights), default=None)) for w in words)
        return [x for x in known if x[1] is not None]

    def __call__(self, text: str | None) -> float:
        low, found = (text or "").lower(), {}
        tokens = set(low.split())
        if len(self.seen) + len(tokens) > self.most:
            self.seen, self.weighty = set(), {}
        new, model = tokens - self.seen, self.restorer.model
        for t in [*new]:
            before = model.asks
            hit = self.weight(self.restorer.signed(t).split())
            if model.asks > before:
                new.discard(t)
            elif hit:
                self.weighty[t] = hit
        self.seen |= new
        for t in tokens.intersection(self.weighty) if len(self.weighty) < len(tokens) else (t for t in tokens if t in self.weighty):
            found.update(self.weighty[t])
        found.update(self.weight(self.restorer.spaced(low)))
        b0, b1, b2 = self.beta
        z = b0 + b1 * math.fsum(found.values()) + b2 * max(found.values(), default=0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id_col, score (0 to 1, the probability of toxicity), from the whole text and nothing else.

    A null or empty text has no words and gets the score of a text without any weighted word; a repeated row gets the
    same score again; an empty table gives an empty result; other columns of docs play no part. The model that goes to the
    tasks has a bounded number of features and trigrams; a text that needs the counts of others gets them by a join, and is
    scored then."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in frames:
            yield pd.DataFrame({"id": frame.id, "score": [scorer(x) for x in frame.text]}).astype({"score": "float64"})

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, number = Scorer(shared.value), _numbers()
        asked = scorer.restorer.model.asked
        for frame in frames:
            out = []
            for text in frame.text:
                asked.clear()
                x = scorer(text)
                out.append((None, text, sorted(asked)) if asked else (x, None, None))
            yield pd.DataFrame(out, columns=["score", "text", "asked"]).assign(id=frame.id.to_numpy(), r=[*islice(number, len(frame))]).astype({"score": "float64"})

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for frame in frames:
            yield pd.DataFrame({"id": frame.id, "score": [scorer(x) for x, scorer.restorer.model.told in zip(frame.text, _counts(frame))]}).astype({"score": "float64"})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not isinstance(model.chars, Chars):
        return map_rows(rows, lean(run), "id {id}, score double").withColumnRenamed("id", id_col)
    first = stored(map_rows(rows, lean(ask), "id {id}, score double, text string, asked array<string>, r long"), "scored")
    more = map_rows(told(first.where("asked IS NOT NULL").drop("score"), model.chars), lean(answer), "id {id}, score double")
    return first.where("asked IS NULL").select("id", "score").union(more).withColumnRenamed("id", id_col)
