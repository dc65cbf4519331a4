"""Trees grown by levels against trees grown in memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import trees
from tabulon.operators.levels import Data, grow_levels


def made(seed, n=300, ties=False):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    if ties:
        x = np.round(x * 2)
    y = 3 * (x[:, 0] > 0.3) + x[:, 1] + r.normal(0, 0.3, n)
    c = np.where(x[:, 2] > 0, "b", np.where(x[:, 0] > 0, "a", "c"))
    flip = r.random(n) < 0.1
    c[flip] = "a"
    return x, y, c


def same(a, b):
    assert a["n"] == b["n"] and a["value"] == pytest.approx(b["value"], abs=1e-9) and ("feature" in a) == ("feature" in b)
    if "feature" in a:
        assert (a["feature"], a["threshold"]) == (b["feature"], pytest.approx(b["threshold"], abs=1e-12)) and a["gain"] == pytest.approx(b["gain"], rel=1e-7, abs=1e-9)
        same(a["left"], b["left"])
        same(a["right"], b["right"])


@pytest.mark.parametrize("taken", [1 << 18, 0])
@pytest.mark.parametrize("classify", [False, True])
@pytest.mark.parametrize("ties", [False, True])
def test_levels_against_memory(spark, classify, ties, taken):
    x, y, c = made(1, ties=ties)
    df = spark.createDataFrame([(*map(float, a), float(b), str(k)) for a, b, k in zip(x, y, c)], "p double, q double, r double, y double, c string").repartition(4)
    data = Data(df, "c" if classify else "y", ["p", "q", "r"], classify)
    tree = grow_levels(data, 3, 5, taken=taken)
    want = trees.grow(x, np.searchsorted(["a", "b", "c"], c) if classify else y, 3 if classify else 0, 3, 5)
    same(tree, want)


def test_no_row_limit_and_missing_rows(spark):
    df = spark.range(300_000).select((F.col("id") % 1000).cast("double").alias("x"), F.when(F.col("id") % 7 > 0, (F.col("id") % 1000 >= 400).cast("string")).alias("c"))
    nodes = {r.path: r for r in trees.cart(df, "c", ["x"], depth=2)[0].collect()}
    assert set(nodes) == {"root", "x <= 399.5", "x > 399.5"} and nodes["root"].n == df.where("c IS NOT NULL").count()
    assert trees.cart(df.where("x < 0"), "c", ["x"])[0].collect() == []
    assert trees.root_split(df, "c", ["x"]).collect()[0].threshold == 399.5


def test_boosting_against_memory(spark):
    x, y, c = made(3, 200)
    df = spark.createDataFrame([(*map(float, a), float(b), str(k)) for a, b, k in zip(x, y, c)], "p double, q double, r double, y double, c string")
    trace, gains = (t.collect() for t in trees.boosting(df, "y", ["p", "q", "r"], rounds=4, depth=2))
    f, total = np.full(len(y), y.mean()), np.zeros(3)
    for row in sorted(trace, key=lambda r: r.round):
        tree = trees.grow(x, y - f, 0, 2, 1)
        trees._gains(tree, total)
        f = f + 0.1 * trees.apply_tree(tree, x, 0)[:, 0]
        assert row.error == pytest.approx(((y - f) ** 2).sum(), rel=1e-9)
    assert [g.importance for g in gains] == pytest.approx((total / total.sum()).tolist(), rel=1e-9)

    t, w, votes = np.searchsorted(["a", "b", "c"], c), np.full(len(y), 1 / len(y)), np.zeros((len(y), 3))
    trace = sorted(trees.boosting(df, "c", ["p", "q", "r"], classify=True, rounds=4, depth=2)[0].collect(), key=lambda r: r.round)
    assert len(trace) == 4
    for row in trace:
        p = trees.apply_tree(trees.grow(x, t, 3, 2, 1, weight=w), x, 3).argmax(1)
        e = w[p != t].sum() / w.sum()
        a = np.log((1 - e) / e) + np.log(2)
        votes[np.arange(len(t)), p] += a
        w = w * np.exp(a * (p != t))
        w /= w.sum()
        assert row.loss == pytest.approx(e, rel=1e-9) and row.error == pytest.approx((votes.argmax(1) != t).mean())
