"""The pipeline's stages against plain versions on a small table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .test_llm import brute_links


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    same = " ".join(f"word{i}" for i in range(60))
    passage = " ".join(f"shared{i}" for i in range(70))
    texts = [same, same.upper(), same + " end", "own " + passage + " " + " ".join(f"mine{i}" for i in range(60)), "two " + passage + " " + " ".join(f"yours{i}" for i in range(60)), "you idiot " * 3, None, "", *(f"clean text number {i} some one wrote this about nothing much at all é" for i in range(40)), *(f"some idiot number {i} wrote this" for i in range(40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, place).cache()
    assert clean.columns == docs.columns and not clean.where("text LIKE '%idiot%'").count()
    assert clean.where("doc_id < 5").count() == 5 and clean.where("text LIKE 'clean%'").count() == 40
    single = stage["exact_dedup"](spark, clean, place).cache()
    assert {r.doc_id for r in single.where("doc_id < 8").collect()} == {0, 2, 3, 4, 6}
    near = stage["ngram_jaccard_join"](spark, single, place).cache()
    want = brute_links([(r.doc_id, r.text) for r in single.collect()], 5, 80, 100)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if c == i}
    cut = stage["suffix_array_dedup"](spark, near, place).cache()
    assert cut.columns == docs.columns and cut.count() == near.count()
    left = {r.doc_id: r.text for r in cut.collect()}
    assert "shared30" in left[3] and "shared30" not in left[4] and left[4].startswith("two")
    packed = stage["best_fit_packing"](spark, cut, place)
    assert packed.select("doc_id").distinct().count() == cut.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run(spark, place):
    assert corpus_pipeline.run(spark, place).count() > 40


def test_toxicity_does_not_pay_for_the_packing_before_it(spark, place):
    """What packing keeps in a worker (a library's tables and the words so far) ends when a task of toxicity begins there."""
    import public_tokenizers
    from tabulon.llm import common, packing

    def before(frames):
        packing.tokens(public_tokenizers.path("word_bpe_49k.json")).ids("some words")
        common_kept = len(common._KEPT)
        for frame in common.lean(lambda x: x)(frames):
            yield frame.assign(n=common_kept * 10 + len(common._KEPT))

    docs = spark.read.parquet(f"{place}/documents.parquet").select("text")
    assert {r.n for r in docs.mapInPandas(before, "text string, n long").collect()} == {10}
