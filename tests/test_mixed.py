"""The mixed model by sizes of groups against the likelihood with the rows' whole covariance matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import regress


def likelihood(x, y, g, lam):
    v = np.eye(len(y)) + lam * np.equal.outer(g, g)
    inv = np.linalg.inv(v)
    info = x.T @ inv @ x
    beta = np.linalg.solve(info, x.T @ inv @ y)
    r = y - x @ beta
    d = len(y) - x.shape[1]
    s2 = r @ inv @ r / d
    return 0.5 * (d * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(info)[1]), beta, s2, np.sqrt(np.diag(np.linalg.inv(info)) * s2), r, inv


def test_mixed_against_the_whole_matrix(spark):
    r = np.random.default_rng(4)
    g = np.repeat(np.arange(12), [1, 1, 2, 3, 3, 3, 5, 8, 8, 9, 11, 20])
    x = np.column_stack([np.ones(len(g)), r.normal(size=len(g))])
    y = x @ [2.0, -1.0] + r.normal(0, 1.5, 12)[g] + r.normal(size=len(g))
    rows = [(float(b), float(c), str(k)) for b, c, k in zip(y, x[:, 1], g)] + [(None, 1.0, "0"), (1.0, None, "1"), (1.0, 1.0, None)]
    fixed, parts, effects = regress.mixed(spark.createDataFrame(rows, "y double, x double, g string"), "y", ["x"], "g")
    parts = {p.component: p.value for p in parts.collect()}
    lam = parts["group"] / parts["residual"]
    best, beta, s2, se, left, inv = likelihood(x, y, g, lam)
    assert all(best <= likelihood(x, y, g, lam * f)[0] + 1e-9 for f in (0.5, 0.99, 1.01, 2.0))
    assert [c.estimate for c in fixed.collect()] == pytest.approx(beta.tolist(), rel=1e-8) and [c.se for c in fixed.collect()] == pytest.approx(se.tolist(), rel=1e-8)
    assert parts["residual"] == pytest.approx(s2, rel=1e-8) and parts["icc"] == pytest.approx(lam / (1 + lam))
    got = {e.group: (e.n, e.effect) for e in effects.collect()}
    for k in range(12):
        assert got[str(k)] == (int((g == k).sum()), pytest.approx(float(lam * (inv @ left)[g == k].sum()), rel=1e-7))


def test_mixed_of_many_groups_and_of_too_few(spark):
    df = spark.range(300_000).select((F.col("id") % 100_000).alias("g"), (F.col("id") % 7).alias("x"), (F.col("id") % 11 + F.col("id") % 100_000 % 3).alias("y"))
    fixed, parts, effects = regress.mixed(df, "y", ["x"], "g")
    assert effects.count() == 100_000 and fixed.count() == 2 and parts.count() == 3
    assert [t.count() for t in regress.mixed(df.where("g = 1"), "y", ["x"], "g")] == [0, 0, 0]
