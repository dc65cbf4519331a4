"""The training-data operators against brute force on small tables, with nulls, empty and repeated rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tabulon.llm import ann, bpe, components, exact_dedup, jaccard, licenses, lm, packing, repeats, toxicity, warc
from tabulon.llm.common import shingles_of

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = ["", None, "One", "oNE", " \t\n", "É é", "x" * 5000, "a b c", "a b c d e f g h", "A b c d e f g h"]


def texts(n=60, seed=0):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeé", k=r.randint(1, 6))) for _ in range(80)]
    passage = " ".join(r.choices(words, k=40))
    out = []
    for i in range(n):
        t = " ".join(r.choices(words, k=r.randint(0, 120)))
        if i % 5 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if out and i % 7 == 0:
            k = r.choice(out) or ""
            t = k.replace("a", "A") if i % 2 else k.replace(" ", "  ", 1) + " " + r.choice(words)
        out.append(t)
    return out + EDGE


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, 9) for i, t in enumerate(texts())]
    rows += [rows[4], (None, "lost", 9), (None, None, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id int").repartition(5).cache()


def test_exact_dedup(docs):
    norm = lambda t: (t or "").translate(LOWER)
    rows = docs.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        for i in ids:
            want[i, best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def brute_links(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (1, 60)])
def test_jaccard(docs, k, num):
    known = docs.where("doc_id IS NOT NULL")
    want = brute_links([(r.doc_id, r.text) for r in known.collect()], k, num, 100)
    # small blocks and chunks, so that blocks are compared with each other and chunks ask about shingles
    got = jaccard.jaccard_join(docs, k, num, 100, block=300, block_rows=4, chunk_bytes=4000).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_keys_meet():
    """Any two linked sets share a key."""
    r = np.random.default_rng(0)
    for n in (6, 13, 40, 200, 1000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(30):
            d = int(n * 0.16) // 2
            b = np.append(np.delete(a, r.choice(n, d, replace=False)), r.integers(0, 2**63, r.integers(0, d + 1)).astype(np.uint64))
            if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
                continue
            keys, of = jaccard.keys_of(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85, 100, jaccard.scheme(85, 100, 2000))
            assert set(keys[of == 0]) & set(keys[of == 1])


@pytest.mark.parametrize("num", [80, 85])
def test_keys_of_unrelated_sets_differ(num):
    """Disjoint sets share no key, whatever their size."""
    r, dealt = np.random.default_rng(1), jaccard.scheme(num, 100, 400)
    for n in (4, 6, 8, 11, 30, 60, 120, 300):
        values = r.integers(0, 2**63, 600 * n).astype(np.uint64)
        keys, of = jaccard.keys_of(values, np.arange(601) * n, num, 100, dealt)
        pairs = np.unique(np.column_stack([keys, of.astype(np.uint64)]), axis=0)
        assert len(np.unique(pairs[:, 0])) == len(pairs)


def test_jaccard_edges(spark):
    """An empty table, clashing columns, and a group of copies that are dealt to several blocks."""
    empty = spark.createDataFrame([], "doc_id long, text string, component string, block int")
    assert jaccard.jaccard_join(empty).count() == 0
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:-2] + [f"x{i}", f"y{i}"]), "c", 1) for i in range(60)] + [(900 + i, " ".join(f"z{i}_{j}" for j in range(30)), "c", 1) for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(spark.createDataFrame(rows, empty.schema), block_rows=8).collect()}
    assert got == {i: 0 for i in range(60)} | {900 + i: 900 + i for i in range(20)}


def test_long_texts_cut_into_parts():
    long = " ".join(f"w{i}" for i in range(50_000))
    v, begin = shingles_of([long, "", None, "a"], 4)
    assert np.diff(begin).tolist() == [49_997, 0, 0, 1]


def test_components(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize(("window", "hot"), [(50, 256), (50, 0), (12, 256), (5, 0)])
def test_repeats(docs, window, hot):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        for p in range(len(t) - window + 1):
            first[t[p : p + window]] = min(first.get(t[p : p + window], i), i)
    want = collections.Counter()
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if i is not None and first[t[p : p + window]] < i:
                gone[p : p + window] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want[i, len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()] += 1
    got = repeats.remove_repeats(docs, window, chunk_bytes=4000, hot=hot).collect()
    assert collections.Counter((*r[:4], bytes(r[4])) for r in got) == want


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


ODD = ["it's  \n\n we'll 123 456é  ", " " * 300, "a" * 500, "x 　 y z", "\x1c\x1d a", "'s 's'", "1" * 200 + " " * 40 + "b", "\n\nx " * 90]


@pytest.fixture(scope="module")
def byte_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(byte_bpe):
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    for t in [*(x or "" for x in texts()), *ODD]:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == byte_bpe.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


@pytest.mark.parametrize("chunk, overlap", [(50, 16), (64, 40), (1 << 16, 1 << 10)])
def test_bpe_frames(spark, docs, byte_bpe, chunk, overlap):
    """Chunks of texts are stitched to what the library gives for whole texts, also where an overlap has no boundary."""
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD, 900)), "doc_id long, text string"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = collections.Counter()
    for r in rows.collect():
        ids = byte_bpe.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((r.text or "").encode()))] += 1
    got = bpe.digest_round_trip(rows, PATH, public_tokenizers.PATTERN, chunk, overlap)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert collections.Counter(map(tuple, got.collect())) == want
    found = bpe.encode(rows, PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert collections.Counter((r.doc_id, r.n_tokens, sha(r.ids)) for r in found.collect()) == collections.Counter(x[:3] for x in want.elements())
    assert bpe.digest_round_trip(rows.limit(0), PATH, public_tokenizers.PATTERN, chunk, overlap).collect() == []


WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_token_cache():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    lib.encode_special_tokens = True
    mine = packing.Tokens(WORDS)
    for t in [*(x or "" for x in texts()), "It'LL d'D  don't", "İ ǅ ΑΣ ﬁ", "a<|endoftext|>b", "x\x85y\xa0z", "é", "ÀÉ ß ŉ ſ K"]:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_packing(docs):
    pieces = packing.pieces(docs, WORDS, capacity=64).cache()
    got = packing.pack(pieces, capacity=64, open_bins=4).collect()
    assert len(got) == pieces.count()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(bins) <= 1.3 * -(-total // 64)
    by_doc = collections.defaultdict(list)
    for r in got:
        if r.doc is not None and r.doc != 12:  # 12 is there twice
            by_doc[r.doc].append((r.piece, r.start, r.length))
    for p in by_doc.values():
        p.sort()
        assert all(x[1] == 64 * x[0] for x in p) and all(x[2] == 64 for x in p[:-1])


def test_pieces_against_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        cut = [ids[a : a + 64] for a in range(0, len(ids), 64)]
        want.update((r.doc_id, k, 64 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut))
    assert collections.Counter(map(tuple, packing.pieces(docs, WORDS, capacity=64).collect())) == want


def test_open_bins_against_plain_best_fit():
    r = random.Random(1)
    bins, free = packing.OpenBins(100, 10**9), []
    for _ in range(2000):
        n = r.randint(1, 100)
        fit = min((f for f in free if f >= n), default=None)
        if fit is None:
            free.append(100 - n)
        else:
            free.remove(fit)
            free.append(fit - n)
        _, offset = bins.put(n)
        assert offset == (0 if fit is None else 100 - fit)
    few = packing.OpenBins(100, 3)
    assert [few.put(n)[0] for n in (60, 70, 80, 90, 15)] == [0, 1, 2, 3, 1]  # 80 was the fullest and closed


def test_warc(spark, tmp_path):
    big = "ü" * 3000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, big), (6, big), (7, "x\r\n\r\ny"), (7, "x\r\n\r\ny"), (None, "z"), (None, "a"), (9, "end\r\n\r\n"), (10, "end\r\n")]
    pages = spark.createDataFrame([(*r, f"http://x/{r[0]}", 1, True) for r in rows], "page_id long, html string, url string, bytes int, revisit boolean")
    warc.write_warc(pages, str(tmp_path / "w"), chunk=1000, url_col="url")
    got = sorted((tuple(r) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    last = {"a": 2, "": 4, big: 6, "x\r\n\r\ny": 7, "z": None, "end\r\n\r\n": 9, "end\r\n": 10}
    want = sorted(((i, len((t or "").encode()), digest(t or ""), "response" if last[t or ""] == i else "revisit", None if last[t or ""] == i else last[t or ""]) for i, t in rows), key=str)
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    # every revisit names a record that is there, once
    chunks = warc.read_chunks(spark, str(tmp_path / "w")).collect()
    names = collections.Counter(r.record for r in chunks if r.type == "response")
    assert max(names[r] for r in names) == 1
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "w")).collect())
    assert "WARC-Target-URI: http://x/1" in text
    assert set(re.findall("WARC-Refers-To: <(.*)>", text)) <= set(names)
    assert sorted(r.chunk for r in chunks if r.page == 6) == list(range(1, 7)) and all(len(r.body) <= 1000 for r in chunks if r.body)


def test_warc_long_payload(spark):
    """A payload of many chunks, whose bodies have ends of records and characters across chunks in them."""
    big = ("é\r\n\r\nWARC/1.1\r\n" + "x" * 40) * 60_000
    pages = spark.createDataFrame([(1, big, "a"), (2, "b", None)], "page_id long, html string, url string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[1].payload_bytes == len(big.encode()) and got[1].payload_digest == warc.sha1_base32(big.encode()) and got[2].record_type == "response"


def test_nearest(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [1.0, 2.0]), (2005, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df.where("vec_id % 20 = 0 OR vec_id = 2004"), df, k=10, shard=600).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x.query_id].append(x)
    assert [(x.vec_id, x["rank"]) for x in by[2004]] == [(2005, 1)]
    hit = 0
    for q in range(0, 1500, 20):
        s = v.astype(float) @ v[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:10]
        assert all(abs(x.score - s[x.vec_id]) < 1e-9 for x in by[q]) and len(by[q]) == 10
        hit += len({x.vec_id for x in by[q]} & set(best.tolist()))
    assert hit / 750 >= 0.9


def test_nearest_among_copies(spark):
    """Groups of equal vectors, one of them larger than the beam, and an identifier that repeats: scores as by brute force."""
    r = np.random.default_rng(1)
    v = r.normal(size=(900, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for a, n in ((0, 60), (100, 200), (400, 90)):
        v[a : a + n] = v[a]
    ids = np.arange(900)
    ids[400:440] = 400
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<float>")
    queries = [3, 59, 100, 250, 400, 460, 600, 777]
    by = collections.defaultdict(list)
    for x in ann.nearest(df.where(F.col("vec_id").isin(queries)).dropDuplicates(["vec_id"]), df, k=20).orderBy("rank").collect():
        by[x.query_id].append((x.vec_id, x.score))
    for q in queries:
        s = v.astype(float) @ v[np.flatnonzero(ids == q)[0]].astype(float)
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s.round(9)))[:20]
        assert len(by[q]) == 20
        if q < 300 or 400 <= q < 490:  # within a group
            assert [i for i, _ in by[q]] == ids[best].tolist()
        else:
            assert len({i for i, _ in by[q]} & set(ids[best].tolist())) >= 18


@pytest.mark.parametrize("coded", [65_536, 20])
def test_lm(docs, coded):
    training = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = lm.score(docs, training, coded=coded).collect()
    tokens = [(r.doc_id, [*WORD.findall((r.text or "").translate(LOWER)), None]) for r in docs.collect()]
    c = collections.Counter(w for i, t in tokens if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm_held_out_texts_change_no_other_score(docs):
    training = F.col("doc_id") % 2 == 0
    whole = {r.doc_id: r.score for r in lm.score(docs, training).collect() if r.doc_id is not None}
    less = {r.doc_id: r.score for r in lm.score(docs.where("doc_id % 2 = 0 OR doc_id % 5 = 1"), training).collect() if r.doc_id is not None}
    assert less and all(abs(whole[i] - x) < 1e-6 * abs(x) for i, x in less.items())


def test_lm_edges(spark):
    schema = "doc_id long, text string, w long, r long"
    assert lm.score(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rows = [(None, "a b", 1, 1), (1, None, 1, 1), (2, "", 1, 1), (2, "", 1, 1)]
    for training in (F.lit(False), F.lit(True)):  # nothing to learn from, or hardly anything
        got = lm.score(spark.createDataFrame(rows, schema), training).collect()
        assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3] and all(math.isfinite(r.score) for r in got)
        assert len({r.score for r in got if r.doc_id is not None}) == 1


def trained_speller():
    s = lm.Speller()
    s.learn([b"some", b"text", b"texts", b"sum"] * 9)
    s.mixing.freeze()
    return s


def trained_coder():
    texts = ["a b a c a b", "b a é c", "c c b"] * 5
    counts = collections.Counter(w for t in texts for w in t.split())
    hashed = {w: int(lm.Tokens([w]).key[0]) for w in counts}
    code = lm.Code(np.array([hashed[w] for w in counts], np.uint64), np.array(list(counts.values())), 15, 1)
    c = lm.Coder(code, 100)
    for t in texts:
        c.learn(lm.Tokens([t]).look_back())
    c.mixing.freeze()
    return c, counts


def costs_of(c, t):
    return c.costs(t, c.code.symbols(t.key, t.is_end))


def test_lm_probabilities_add_up():
    """Those of all next tokens to one, and those of some words to less."""
    c, counts = trained_coder()
    after = [math.exp(-costs_of(c, lm.Tokens([f"a {w}".strip()]).look_back())[1]) for w in [*counts, "", "other"]]
    assert abs(sum(after) - 1) < 1e-4
    words = [b"", *(bytes([x]) for x in range(256)), b"some", b"text"]
    assert 0 < sum(math.exp(-x) for x in trained_speller().costs(words)) <= 1


def test_lm_costs_against_a_loop():
    """Each bit by itself, in plain arithmetic."""
    c, _ = trained_coder()
    t, m = lm.Tokens(["a b é", "zz a"]).look_back(), c.mixing
    got = costs_of(c, t)
    symbols = c.code.symbols(t.key, t.is_end)
    for i, s in enumerate(symbols.tolist()):
        total = 0.0
        for j in range(c.code.first[s], c.code.first[s] + c.code.length[s]):
            node, bit = int(c.code.nodes[j]), int(c.code.bits[j])
            slots = [node * lm.SCRIPTS + int(t.script[i])]
            for k, bits in enumerate(c.table_bits):
                h = (int(t.contexts[k][i]) + node * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 % 2**64
                slots.append((h >> (64 - bits)) + int(c.offsets[k + 1]))
            sure = [int(m.frozen[x : x + 1].view(np.int32)[0]) & 15 for x in slots]
            gate = min(sure[1], 10) // 2 * 4 + min(sure[2], 6) // 2
            z = float(c.code.static[node]) * float(m.weights[gate][0]) + sum(float(m.frozen[x]) * float(m.weights[gate][k + 1]) for k, x in enumerate(slots))
            z = max(-12.0, min(12.0, z))
            p = 1 / (1 + math.exp(-z))
            zero, one = m.bins[gate * lm.BINS + int((z + 12) * ((lm.BINS - 1) / 24) + 0.5)]
            p = 0.5 * p + 0.5 * (one + lm.BELIEF * p) / (zero + one + lm.BELIEF)
            total -= math.log(p if bit else 1 - p)
        assert abs(total - got[i]) < 1e-3 * max(1, total)


def test_lm_long_words_cost_all_their_bits(spark):
    run = "".join(random.Random(4).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5000))
    s = trained_speller()
    pieces = s.costs([run.encode()])[0]
    assert pieces > 600 and pieces > 10 * s.costs([run[:300].encode()])[0]
    rows = [(i, "some text that is known " * 5) for i in range(20)] + [(100, run), (101, run[:300])]
    by = {x.doc_id: x.score for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert by[100] < 8 * by[101] < 0


def test_lm_counts_beyond_16_bits(spark):
    """Counts add up whole, dense or sparse."""
    m = lm.Mixing(64, 2, 1, [0.5, 0.5])
    m.counts[:3] = [60_000, 240_000, 1 << 30]
    frames = [m.sent(), m.sent()]
    m.counts[:] = 7
    frames.append(m.sent())
    learned = spark.createDataFrame([(int(r.part), bytes(r.at), bytes(r.counts)) for f in frames for r in f.itertuples()], "part int, at binary, counts binary")
    out = lm.Mixing(64, 2, 1, [0.5, 0.5]).gather(learned)
    assert abs(float(out.frozen[0]) - math.log(480_007 / 120_007)) < 1e-3
    assert abs(float(out.frozen[1]) - math.log(7 / ((1 << 31) + 7))) < 0.1 and abs(float(out.frozen[9])) < 1e-5


def test_toxicity(spark):
    r = random.Random(0)
    plain = ["".join(r.choices("abcdefghilmnorstu", k=r.randint(3, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        t = r.choices(plain, k=30)
        bad = i % 3 == 0
        if bad:
            w = r.choice(["idiot", "worthless", "stupid"])
            if i % 2:
                w = {"idiot": "1d10t", "worthless": "w o r t h l e s s", "stupid": "stuuupid"}[w]
            t.insert(r.randint(0, 30), w)
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "A! " * 3000)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    m = toxicity.fit(docs, lab, ~held)
    got = {x.doc_id: x.score for x in toxicity.score(docs, m).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[900] < 0.5
    test = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == (i % 3 == 0) for i in test) / len(test)
    assert right > 0.9
    none = toxicity.fit(docs, lab.limit(0), ~held)
    assert {round(x.score, 3) for x in toxicity.score(docs, none).collect()} == {0.5}


def test_decoder():
    words = ["idiot", "worthless", "stupid", "moron", "the", "loser", "clown"] * 50
    grams = collections.Counter(("\0\0" + w + "\0")[i : i + 3] for w in words for i in range(len(w) + 1))
    r = toxicity.Restorer(toxicity.CharModel(dict(grams)))
    for said, meant in (("1d10t", "idiot"), ("stuuupid", "stupid"), ("$tup1d", "stupid"), ("i.d.i.o.t", "idiot"), ("worth-less", "worthless"), ("m0r0n###", "moron"), ("the", "the"), ("c10wn", "clown")):
        assert r.signed(said) == meant, said


def test_decoder_reads_long_runs_whole():
    words = ["idiot", "worthless", "stupid", "moron", "the", "loser", "clown", "table"] * 50
    grams = collections.Counter(("\0\0" + w + "\0")[i : i + 3] for w in words for i in range(len(w) + 1))
    r = toxicity.Restorer(toxicity.CharModel(dict(grams)))
    assert r.texts_words("yes " + " ".join("thetable" * 10 + "idiot") + " yes") >= {"the", "table", "idiot"}
    assert set(r.signed(".".join(["the", "table"] * 8 + ["1d10t"])).split()) == {"the", "table", "idiot"}
    assert r.texts_words(" ".join("loserstupid")) >= {"loser", "stupid"}
    assert (r.signed("stuupid"), r.signed("iidiioott"), r.signed("loser")) == ("stupid", "idiot", "loser")
    assert len(toxicity.viterbi("the-1d10t." * 2000, r.model, True).split()) == 4000


def test_licenses(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    rows = [(1, "foo bar\nReleased under the MIT License.\nbaz"), (2, mit.replace("Software", "Program")), (3, None), (4, ""), (5, "a driving license is needed here"), (6, "Licensed under CC BY-NC 4.0.\nx"), (7, "Licensed under CC BY 4.0."), (8, "word " * 30 + "All rights reserved."), (1, "Released under the MIT License.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (6, "CC-BY-NC-4.0"), (7, "CC-BY-4.0"), (8, "All-Rights-Reserved")]
    assert all(r.n_diff == 0 for r in got if r.doc_id in (1, 6, 7))


def test_license_notices_of_several_lines():
    wording = {n: t for n, t in reversed(licenses.TEMPLATES)}
    s = licenses.Scanner()
    fill = lambda t, n: "\n".join(__import__("textwrap").wrap(t, n))
    mit = wording["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    mit = "\n\n".join(fill(p, 75) for p in mit.split("\n\n"))
    bsd = "\n".join(" * " + x for x in fill(wording["BSD-3-Clause"], 72).split("\n"))
    for text, names in ((mit, ["MIT"]), (bsd, ["BSD-3-Clause"]), (f"Copyright (c) 2020 A\n\n{mit}\n\nint main()", ["MIT"]), (mit + "\n" + bsd, ["MIT", "BSD-3-Clause"]), (f"some words\n{bsd}\n{mit}\nAll rights\nreserved.", ["BSD-3-Clause", "MIT", "All-Rights-Reserved"]), (fill(wording["GPL-3.0"], 70), ["GPL-3.0"]), (fill(wording["GPL-2.0"], 70), ["GPL-2.0"])):
        got = s.scan(text)
        assert [x[2] for x in got] == names and all(x[5] == 0 for x in got)
    a, b = s.scan("x\n" + mit + "\ny")[0][:2]
    assert (a, b) == (2, len(mit) + 1)


def test_trigrams_against_a_loop():
    words = {"ab": 2, "A": 1, "x" * 60: 3, "x" * 61: 5, "!é!": 1, "1a": 7, "": 1, "\U00020000y": 4, "...": 2}
    want = collections.Counter()
    for w, n in words.items():
        w = w.strip(toxicity.OUTSIDE)
        if w.isalpha() and len(w) <= 60:
            padded = "\0\0" + w + "\0"
            for i in range(len(w) + 1):
                want[padded[i : i + 3]] += n
    assert toxicity.trigrams(words) == want and toxicity.trigrams({}) == {}


def test_scorer_starts_afresh_without_other_scores():
    """A table of restored tokens that is too small changes nothing, and equal words count once."""
    grams = toxicity.trigrams({"idiot": 50, "the": 90, "clown": 40})
    m = toxicity.Model(grams, {"idiot": 3.0, "clow~": 2.0}, (-3.0, 1.0, 0.5))
    said = ["the idiot", "the 1d10t idiot", "clowns c l o w n s", None, "", "the " * 50, "idiot clown"]
    whole, small = toxicity.Scorer(m), toxicity.Scorer(m, most=2)
    got = [whole(x) for x in said]
    assert got == [small(x) for x in said] == [whole(x) for x in said]
    assert got[0] == got[1] > 0.5 > got[3] == got[4] == got[5] and got[6] > got[0]


def test_toxicity_knows_every_trigram(spark):
    """Trigrams beyond those that every task gets count as well: readings and scores are those of a table of all of them."""
    r = random.Random(5)
    letters = [chr(c) for c in range(0xAC00, 0xAC00 + 400)]
    words = ["".join(r.sample(letters, 4)) for _ in range(25_000)]
    rows = [(i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(250)]
    doubled = [w[0] + w[1] * 2 + w[2:] for w in words[::50]] + [w[:2] + "." + w[2:] for w in words[25::50]]
    rows += [(1000 + i, f"{t} the") for i, t in enumerate(doubled)] + [(None, " ".join(words[0])), (None, None), (5000, "the " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = toxicity.trigrams(collections.Counter(t for _, x in rows for t in (x or "").split()))
    assert len(grams) > 60_000
    chars = toxicity.char_counts(docs)
    weights = {w: 1.0 + i % 7 for i, w in enumerate(words[::25])}
    plain = toxicity.Scorer(toxicity.Model(grams, weights, (-3.0, 1.0, 0.5)))
    want = sorted((str(i), plain(t)) for i, t in rows)
    assert sorted((str(x.doc_id), x.score) for x in toxicity.score(docs, toxicity.Model(chars, weights, (-3.0, 1.0, 0.5))).collect()) == want
    assert len({s for _, s in want}) > 5


def test_toxicity_fits_the_same_with_few_shared_trigrams(spark):
    rows = [(i, f"{'some' if i % 2 else 'nice'} text {i % 13} {'1d10t' if i % 3 == 0 else 'peoople'} w.o.r.d l e t t e r s") for i in range(240)] + [(900, "idiot people letters " * 30)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    found = []
    for shared in (60_000, 8):
        m = toxicity.fit(docs, lab, F.lit(True), shared=shared)
        found.append((m.weights, m.beta, dict(tuple(x) for x in toxicity.score(docs, m).collect())))
    assert found[0][0] == found[1][0] != {} and found[0][1] == pytest.approx(found[1][1]) and found[0][2] == pytest.approx(found[1][2])


def test_lm_looks_up_words_as_a_search_does():
    r = np.random.default_rng(3)
    crowd = (np.uint64(0xFFFFFFFFFFFF0000) + np.arange(9, dtype=np.uint64)) * np.uint64(1)  # the last leading bits, many alike
    for words in (r.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), crowd, np.array([0, 5], np.uint64), np.zeros(0, np.uint64)):
        code = lm.Code(words, np.full(len(words), 3), 9, 1)
        keys = np.concatenate([words, words + np.uint64(1), words - np.uint64(1), np.array([0, 1, 2**64 - 1], np.uint64)])
        known = {int(w): i for i, w in enumerate(sorted(words))}
        assert code.symbols(keys, np.zeros(len(keys), bool)).tolist() == [known.get(int(k), code.rest) for k in keys]
        assert set(code.symbols(keys, np.ones(len(keys), bool)).tolist()) == {code.end}


def test_words_hashed_by_eights():
    import pyarrow as pa

    from tabulon.llm.common import WORD, hashed_words

    some = ["", "a", "a\x00", "\x00a", "abcdefgh", "abcdefgh\x00", "abcdefghabcdefgi", "abcdefgiabcdefgh", "x" * 1000, "x" * 999 + "y", " \t\x0b a\x85b  é Éé ", "B b", "ﬁn\x1fz"]
    t = lm.Tokens(some)
    words = [w for x in some for w in WORD.findall(x.encode().translate(lm.LOWER_BYTES))]
    assert t.spelled(np.arange(len(words))).to_pylist() == words
    assert t.spelled(pa.array([1, None, 0])).to_pylist() == [words[1], None, words[0]]
    hashes = hashed_words(t.data, np.append(0, np.cumsum([len(x.encode()) + 1 for x in some])))[0]
    of = dict(zip(words, hashes.tolist()))
    assert [of[w] for w in words] == hashes.tolist() == t.key[t.at].tolist() and len(set(of.values())) == len(of)
    assert [int(lm.Tokens([w.decode()]).key[0]) for w in of] == list(of.values())


def test_words_by_ranks():
    import json
    import unicodedata
    from pathlib import Path

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    mine, made = packing.Tokens(WORDS), json.loads(Path(WORDS).read_text())
    # every token alone becomes itself, by the file and by the ranks
    vocab, of_byte = made["model"]["vocab"], {b: c for c, b in packing.byte_level().items()}
    assert all([t.id for t in lib.model.tokenize(x[:-4])] == [i] for x, i in vocab.items() if x.endswith("</w>"))
    r, letters = random.Random(4), [c for c in map(chr, range(33, 384)) if packing.PLAIN.fullmatch(c) and c == c.lower()]
    words = [x[:-4] for x in vocab if x.endswith("</w>") and x[:-4].isascii()] + ["".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(4000)]
    words += ["".join(r.choices("'srtvemld.,!é²ºªµ1", k=r.randint(1, 9))) for _ in range(4000)] + ["a" * 3000, "&&&", "it's,", "x²", "ß" * 99]
    words = [w for w in dict.fromkeys(w.lower() for w in words) if "<|" not in w and unicodedata.is_normalized("NFC", w)]
    assert all(mine.ids(w) == np.array(lib.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)
    assert mine.ranks is not None and "library" not in vars(mine) and of_byte[0x20] == "Ġ"  # none of them needed the library
    again = packing.Tokens(WORDS)
    again.ranks = None
    assert all(again.ids(w) == mine.ids(w) for w in words[::20])
