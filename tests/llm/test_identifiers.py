"""Identifiers beyond 2**53 beside a null one, and tables without a text as long as a window."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tabulon.llm import alignment, bpe, exact_dedup, jaccard, licenses, lm, packing, quality, repeats, toxicity, warc

A, B = (1 << 53) + 1, (1 << 53) + 3
NOTICE = "Licensed under the MIT license. "
TEXT = NOTICE + " ".join(f"word{i} other{i % 7}" for i in range(40))
MACHINE = quality.Machine(0.0, quality.np.zeros((1 << 16) + len(quality.STATS), "float32"), quality.np.zeros(((1 << 16) + len(quality.STATS), 8), "float32"), quality.np.zeros(len(quality.STATS)), quality.np.ones(len(quality.STATS)))


@pytest.fixture(scope="module")
def beside(spark):
    return spark.createDataFrame([(A, TEXT), (None, TEXT), (B, TEXT + " more"), (5, "")], "doc_id long, text string").coalesce(1)


OPERATORS = {
    "exact_dedup": lambda d: exact_dedup.exact_dedup(d),
    "jaccard": lambda d: jaccard.jaccard_join(d, k=4, num=85, den=100),
    "bpe": lambda d: bpe.digest_round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "bpe_long": lambda d: bpe.encode(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, chunk=64, overlap=16),
    "toxicity": lambda d: toxicity.score(d, toxicity.Model({}, {}, (0.0, 0.0, 0.0))),
    "quality": lambda d: quality.score(d, MACHINE),
    "packing": lambda d: packing.pack(packing.pieces(d, P.path("word_bpe_49k.json"))).withColumnRenamed("doc", "doc_id"),
    "lm": lambda d: lm.score(d, F.lit(True)),
    "repeats": lambda d: repeats.remove_repeats(d, window=50),
    "alignment": lambda d: alignment.align(d, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")),
    "alignment_long": lambda d: alignment.align(d, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), long=50, stretch=40, width=32, fan=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_identifiers_beside_a_null(beside, name):
    got = [r.doc_id for r in OPERATORS[name](beside).select("doc_id").collect()]
    assert sorted(got, key=lambda x: (x is None, x or 0)) == [5, A, B, None]


def test_large_identifiers_in_other_columns(beside):
    found = {r.doc_id: r for r in jaccard.jaccard_join(beside, k=4, num=85, den=100).collect()}
    assert found[A].component_id == found[B].component_id == A
    assert {r.doc_id for r in licenses.scan(beside).collect()} == {A, B, None}
    pages = beside.select(F.col("doc_id").alias("page_id"), F.lit("same").alias("html"))
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert set(got) == {A, B, 5, None}
    assert got[A].refers_to == got[5].refers_to == got[None].refers_to == B and got[B].record_type == "response"


def test_neighbouring_large_identifiers_are_two_documents(spark):
    rows = [((1 << 53), TEXT), ((1 << 53) + 1, TEXT), (None, "x")]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), window=50).collect()}
    assert got == {1 << 53: 0, (1 << 53) + 1: len(TEXT), None: 0}


@pytest.mark.parametrize("rows", [[(1, "short"), (2, "text")], [(1, "")], [(None, "y" * 80)], [(1, None)], []])
def test_repeats_without_a_window(spark, rows):
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted((str(i), len(t or ""), 0, 0, (t or "").encode()) for i, t in rows)
