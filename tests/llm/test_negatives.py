"""Hard negatives against a plain search of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import negatives
from tabulon.llm.negatives import Goal, Lists, search

KIND = "vec_id long, embedding array<float>, label int, row int, windows string"


def plain(rows, anchors, positives=5, k=10, low=30, high=90):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, y) in enumerate(whole):
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for n, (j, w, z) in enumerate(whole) if n != at]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            window = sorted(x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(window[:k], 1)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 10 == 0, **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(seed, n, dim, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) + (i % 3 == d) * 2 for d in range(dim)], i % 4, 1, "x") for i in range(n)]


@pytest.mark.parametrize("rows_a_block", [8192, 17])
def test_mine_against_all_pairs(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(negatives, "ROWS", rows_a_block)
    monkeypatch.setattr(negatives, "TURN", 3)
    rows = table(1, 150, 6)
    rows += [(200, [0.0] * 6, 1, 1, "x"), (201, [], 1, 1, "x"), (None, [1.0] * 6, 1, 1, "x"), (210, None, 1, 1, "x"), (220, [1.0] * 6, None, 1, "x"), (230, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 1, "x"), (240, [float("nan")] * 6, 1, 1, "x"), (250, [float("inf")] * 6, 1, 1, "x")]
    rows += [(300 + i, [0.5, 0.25, 0.5, 0.0, 0.0, 0.0], i % 2, 1, "x") for i in range(30)] + [rows[10], rows[20], (400, [1.0, 2.0], 0, 1, "x")]
    assert mined(spark.createDataFrame(rows, KIND).repartition(4)) == plain(rows, lambda i: i % 10 == 0)


def test_mine_large_identifiers_and_empty(spark):
    base = (1 << 53) // 10 * 10
    rows = [(base + i, *r[1:]) for i, r in enumerate(table(2, 40, 3))] + [(None, [1.0, 1.0, 1.0], 1, 1, "x")]
    assert mined(spark.createDataFrame(rows, KIND)) == plain(rows, lambda i: i % 10 == 0)
    assert mined(spark.createDataFrame([], KIND)) == []


def test_search_stops_early_and_is_exact():
    r = np.random.default_rng(0)
    q = r.integers(-5, 6, (5000, 4)).astype(np.int64)
    q[:40] *= 100  # a few rows ahead of the rest, as nearest ones are
    lists = Lists(q, np.arange(5000), np.arange(5000), np.zeros(5000, np.int64))
    for anchor in q[:20]:
        goal, seen = Goal(5), []
        access = lists.access
        lists.access = lambda a: ((seen.append(len(x[0])), x)[1] for x in access(a))
        search(lists, anchor, np.ones(5000, bool), [goal])
        lists.access = access
        score = q @ anchor
        want = sorted(range(5000), key=lambda i: (-score[i], i))[:5]
        assert goal.at.tolist() == want
        assert sum(seen) < 2500


def test_integers_beyond_doubles_and_longs():
    for size in (1 << 20, 1 << 27, 1 << 40):
        q = np.array([[size, 1], [size, 2], [-size, 3], [0, 0]], np.int64)
        lists = Lists(q, np.arange(4), np.arange(4), np.zeros(4, np.int64))
        goal = Goal(3)
        search(lists, q[1], np.array([True, False, True, True]), [goal])
        assert [int(x) for x in goal.score] == [size * size + 2, 0, 6 - size * size] and goal.at.tolist() == [0, 3, 2]
