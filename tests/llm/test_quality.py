"""The factorisation machine: its identity against all pairs, what it learns, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import quality


def texts(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choices("abcdef", k=r.randint(2, 8))) for _ in range(r.randint(20, 60))]
        good = i % 3 > 0
        out.append((" ".join(words) + "." if good else " | ".join(w + r.choice(["$$$", "!!"]) for w in words), int(good)))
    return out


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(1)
    place, value, offset, stats = quality.features_of([t for t, _ in texts(12)] + ["", None, "one"])
    wide = stats.shape[1]
    m = quality.Machine(0.3, rng.normal(size=(1 << 16) + wide).astype("float32"), rng.normal(size=((1 << 16) + wide, 4)).astype("float32"), stats.mean(0), stats.std(0) + 0.1)
    dense = quality.scaled(m, stats)
    got = quality.margin(m, place, value, offset, dense)
    for i in range(len(got)):
        at = np.concatenate([place[offset[i] : offset[i + 1]], (1 << 16) + np.arange(wide)])
        x = np.concatenate([value[offset[i] : offset[i + 1]], dense[i]])
        pairs = sum(float(m.factors[at[a]].astype(float) @ m.factors[at[b]].astype(float)) * x[a] * x[b] for a in range(len(at)) for b in range(a))
        assert got[i] == pytest.approx(m.bias + m.weight[at].astype(float) @ x + pairs, rel=1e-3, abs=1e-2)


def test_statistics():
    _, _, _, stats = quality.features_of(["Ab CD. x9\nAb CD. x9\n\n!!", "", None])
    of = dict(zip(quality.STATS, stats[0]))
    assert of["bytes"] == pytest.approx(np.log1p(23)) and of["words"] == pytest.approx(np.log1p(7))
    assert of["upper"] == pytest.approx(6 / 23) and of["digit"] == pytest.approx(2 / 23) and of["line"] == pytest.approx(3 / 23)
    assert of["distinct"] == pytest.approx(4 / 7) and of["plain_words"] == pytest.approx(2 / 7) and of["shouted"] == pytest.approx(2 / 7)
    assert of["lines"] == pytest.approx(np.log1p(4)) and of["same_lines"] == pytest.approx(1 - 2 / 3)
    assert not np.delete(stats[1:], quality.STATS.index("lines"), 1).any()


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, t, len(t), "l", 5) for i, (t, _) in enumerate(texts(500))]
    labels = [(i, y, 0) for i, (_, y) in enumerate(texts(500))] + [(3, None, 0), (None, 1, 0), (10**9, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string, id int").repartition(4)
    return docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("doc_id") % 5 != 0, ["n_chars"])


def test_learned_on_other_rows(trained):
    docs, model = trained
    got = {r.doc_id: r.score for r in quality.score(docs.where("doc_id % 5 = 0"), model, ["n_chars"]).collect()}
    want = dict(enumerate(y for _, y in texts(500)))
    assert len(got) == 100 and sum((s >= 0.5) == want[i] for i, s in got.items()) >= 97


def test_edges(spark, trained):
    _, model = trained
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "", float("nan"), 1), (2, "word " * 200_000, 1e6, 1), (3, " \n\t", 3.0, 1), (4, "é汉🙂", 3.0, 1)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, n_chars double, score int"), model, ["n_chars"]).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality.score(spark.createDataFrame([], "doc_id long, text string, n_chars double"), model, ["n_chars"]).collect() == []


@pytest.mark.parametrize("labels", [[], [(0, 1)], [(0, 1), (1, 1), (2, 1)]])
def test_one_class_or_none(spark, trained, labels):
    docs, _ = trained
    m = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
    scores = {r.score for r in quality.score(docs, m).collect()}
    assert len(scores) == 1 and 0.4 < scores.pop() < 1
