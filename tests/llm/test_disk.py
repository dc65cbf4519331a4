"""What the near-duplicate stage leaves on disk and sends to it."""

import os
import time
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tabulon.llm import common, jaccard

from .test_llm import brute_links, texts


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{x}" for top in dirs for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    summed = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("s"))
    was = spark.conf.get(common.TIDY, None)
    got = common.stored(summed, "summed")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.TIDY, None) == was
    assert got.count() == 7 and common.stored(summed, "again").count() == 7 and summed.count() == 7


def test_what_stages_return_needs_few_shuffles(spark, tmp_path):
    """Near copies and repeated passages are found when a stage returns; what is left to run is a join of documents."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts(40, 4))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, most in (("ngram_jaccard_join", 7), ("suffix_array_dedup", 2)):
        before = shuffle_files(spark)
        out = dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        left = {x.rpartition("/")[2].split("_")[1] for x in shuffle_files(spark) - before}
        assert len(left) <= most, name


def test_gaps():
    for values in ([], [0], [5, 5, 9], [0, 2**40, 2**64 - 1]):
        assert common.from_gaps([common.gaps(np.array(values, np.uint64))], np.uint64).tolist() == values
    two = [common.gaps(np.array(x, np.uint64)) for x in ([3, 8], [1])]
    assert common.from_gaps(two, np.uint64).tolist() == [3, 8, 1]


def test_a_chunk_sends_about_three_bytes_a_shingle():
    """Compressed, as a shuffle is: whole hashes took over six bytes each."""
    keys = np.unique(np.random.default_rng(5).integers(0, 2**64, 1_000_000, dtype=np.uint64))
    size = lambda pack: sum(len(zlib.compress(pack(keys[x:y]), 1)) for _, x, y in jaccard._by_bucket(keys, 64))
    short = np.uint64(64 - jaccard.BITS)
    assert size(lambda x: common.gaps(x >> short)) < 3.3 * len(keys)
    assert size(common.planes) > 6 * len(keys)


def test_chance_matches_of_short_hashes_change_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BITS", 6)
    monkeypatch.setattr(jaccard, "SPARE", -40)
    docs = spark.createDataFrame(list(enumerate(texts(80, 3))), "doc_id long, text string").repartition(4)
    want = brute_links([(r.doc_id, r.text) for r in docs.collect()], 3, 70, 100)
    got = jaccard.jaccard_join(docs, k=3, num=70, chunk_bytes=4000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
