"""Alignment of two tokenizers against a plain version of the definition, and the laws of its fragments."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabulon.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain(texts):
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    byte = alignment.byte_level()
    found = []
    for t in texts:
        if not t:
            found.append(None)
            continue
        e = a_side.encode(" " + t, add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in p)) for i, p in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i, p in ((i, b_side.id_to_piece(i)) for i in b_side.encode(t))]
        if any(b"".join(x for _, x in side) != (" " + t).encode() for side in (a, b)):
            found.append(None)
            continue
        ends = [list(np.cumsum([len(x) for _, x in side])) for side in (a, b)]
        groups, low = [], 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            groups.append(tuple([i for (i, _), e in zip(side, e_) if low < e <= cut] for side, e_ in zip((a, b), ends)))
            low = cut
        found.append((len(a), len(b), groups))
    links = [collections.Counter((x, y) for ga, gb in f[2] for x in ga for y in gb) if f else {} for f in found]
    count = collections.Counter(p for x in links for p in x)
    top = collections.defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for f, own in zip(found, links):
        if not f:
            out.append((0,) * 6 + ("",))
            continue
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in f[2])
        out.append((f[0], f[1], len(f[2]), own.total(), sum(n for p, n in own.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest()))
    return out


EDGE = ["", None, " ", "  two  blanks ", "\n\nlines\n \nhere\n", "a▁b", "<|endoftext|> <s> </s> <unk> <0x0A>", "汉字没有空格" * 30, "x" * 700, "don't we'll I'd", "é é ﬁ \x00 \x1c\x85  z", "🙂🙂 🙂", "tab\tand  \t mixed", "ends with blank ", "3.14 3,14 1e-9", "▁", "the the the"]


def texts(n=40, seed=3):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghié-.,'", k=r.randint(1, 9))) for _ in range(60)] + ["The", "of", "tion", "\n", " "]
    return [" ".join(r.choices(words, k=r.randint(1, 90))) for _ in range(n)] + EDGE + ["the the the"]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 500}, {"long": 40, "stretch": 25, "width": 16, "fan": 2, "chunk": 300}, {"long": 200, "stretch": 64, "width": 7, "fan": 3}])
def test_align_against_the_definition(spark, sizes):
    rows = list(enumerate(texts())) + [(None, "the of tion"), (7, "again of the")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, id int, chunk int, keys int").repartition(3)
    got = [(r.doc_id, *r[1:]) for r in alignment.align(docs, A, B, **sizes).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows]))]
    key = lambda x: (x[0] is None, x[0] or 0, x[7])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_align_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 6), min_size=1, max_size=30), st.lists(st.integers(1, 40), max_size=6), st.randoms(use_true_random=False))
def test_fragments_compose_in_any_grouping(a_sizes, b_sizes, cuts, r):
    total = max(sum(a_sizes), sum(b_sizes))
    sides = []
    for sizes in (a_sizes, b_sizes):
        ends = np.cumsum([*sizes, total - sum(sizes)] if sum(sizes) < total else sizes)
        sides.append((np.arange(len(ends)), ends))
    whole, inner = alignment.fragment(*sides[0], *sides[1])
    edges = sorted({0, total, *(c for c in cuts if c < total)})
    parts, closed = [], []
    for low, high in zip(edges, edges[1:]):
        own = [x[(e > low) & (e <= high)] for i, e in sides for x in (i, e)]
        f, c = alignment.fragment(*own)
        parts.append(f)
        closed.append(c)
    while len(parts) > 1:
        i = r.randrange(len(parts) - 1)
        f, c = alignment.compose(parts[i], parts[i + 1])
        parts[i : i + 2] = [f]
        closed.append(c)
    f = parts[0]
    assert (f.first, f.last) == (whole.first, whole.last)
    assert all((getattr(f, c) == getattr(whole, c)).all() for c in ("a", "a_end", "b", "b_end"))
    found = [c for c in closed if c is not None]
    for name in ("a", "b"):
        want = [] if inner is None else getattr(inner, name).tolist()
        assert sorted(x for c in found for x in getattr(c, name).tolist()) == want


def test_a_stretch_edge_is_crossed_by_no_token():
    t = alignment.Tokens(A, B)
    assert t.by_word
    r = random.Random(5)
    for _ in range(300):
        text = " " + "".join(r.choices(["a", "B", "é", "汉", ".", ",", "'s", "!", " ", " ", "\n", "\t", "1", "(", "▁", " ", "🙂"], k=40))
        for m in alignment.A_EDGE.finditer(text):
            parts = [t.a.encode(x, add_special_tokens=False).ids for x in (text[: m.start()], text[m.start() :])]
            assert parts[0] + parts[1] == t.a.encode(text, add_special_tokens=False).ids
        for m in alignment.B_EDGE.finditer(text):
            parts = [t.b.encode(x[1:]) for x in (text[: m.start()], text[m.start() :])]
            assert parts[0] + parts[1] == t.b.encode(text[1:])
