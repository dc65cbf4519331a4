"""Nearest neighbours against all pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import multivar, nearest


def brute(rows, k, leave_one_out):
    """(columns, class, predicted) of each row, all rows in the order of columns and class."""
    rows = sorted(rows)
    x = np.array([r[:-1] for r in rows], float)
    out = []
    for i, r in enumerate(rows):
        d = np.zeros(len(rows))
        for j in range(x.shape[1]):
            d += (x[i, j] - x[:, j]) ** 2
        near = [j for j in np.argsort(d, kind="stable") if j != i or not leave_one_out][:k]
        said = [rows[j][-1] for j in near]
        many = Counter(said)
        out.append((*r, max(said, key=lambda c: (many[c], -said.index(c))) if said else None))
    return Counter(out)


def table(spark, kind: str):
    r = np.random.default_rng(7)
    if kind == "one column, ties":
        return [(float(v), "abc"[c]) for v, c in zip(r.integers(0, 60, 400), r.integers(0, 3, 400))]
    if kind == "two columns":
        return [(*map(float, v), "ab"[c]) for v, c in zip(r.normal(size=(500, 2)).round(2), r.integers(0, 2, 500))]
    if kind == "nine columns":
        return [(*map(float, v), "abcd"[c]) for v, c in zip(r.normal(size=(300, 9)), r.integers(0, 4, 300))]
    if kind == "one hot point":
        return [(1.0, 1.0, "ab"[i % 3 == 0]) for i in range(200)] + [(float(i), 0.0, "c") for i in range(40)] + [(1e300, -1e300, "z"), (-1e300, 5.0, "z")]
    return [(float(i), 2.0 * i, "ab"[i % 2]) for i in range({"none": 0, "one": 1, "few": 4}[kind])]


@pytest.mark.parametrize("kind", ["one column, ties", "two columns", "nine columns", "one hot point", "few", "one", "none"])
def test_knn_is_that_of_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "CELL", 16)
    monkeypatch.setattr(nearest, "ASKED", 20)
    rows = table(spark, kind)
    cols = [f"v{i}" for i in range(len(rows[0]) - 1 if rows else 2)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", g string").repartition(3)
    for k, leave_one_out in ((5, True), (3, False)):
        got = multivar.knn(df, cols, "g", k, leave_one_out)
        assert got.columns == [*cols, "g", "predicted"]
        assert Counter(map(tuple, got.collect())) == brute(rows, k, leave_one_out)


def test_knn_leaves_out_missing_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b"), (3.0, " "), (4.0, None), (float("nan"), "b"), (9.0, "b")], "v double, g string")
    assert sorted(map(tuple, multivar.knn(df, ["v"], "g").collect())) == [(1.0, "a", "a"), (2.0, "a", "a"), (9.0, "b", "a")]


def test_knn_of_more_rows_than_it_took(spark):
    """Beyond 20,000 rows, it was an error. Classes are runs of 10 places, so that only rows at their edges can be wrong."""
    df = spark.range(30_000).select(F.col("id").cast("double").alias("v"), (F.floor(F.col("id") / 10) % 2).cast("string").alias("g"))
    got = multivar.confusion(multivar.knn(df, ["v"], "g"), "g").collect()
    assert sum(r.n for r in got) == 30_000
    rows = [(float(i), str(i // 10 % 2)) for i in range(400)]
    edge = {r[:2] for r in brute(rows, 5, True) if r[1] != r[2] and 20 < r[0] < 380}
    wrong = multivar.knn(df, ["v"], "g").where("g <> predicted AND v > 20 AND v < 380").collect()
    assert {(r.v, r.g) for r in wrong} == edge


def test_knn_refuses_more_than_a_given_bound(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("v"), F.lit("a").alias("g"))
    with pytest.raises(multivar.TooManyRows):
        multivar.knn(df, ["v"], "g", max_rows=9)
