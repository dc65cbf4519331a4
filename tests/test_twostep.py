"""Two-step clusters against the plain definition, and cluster features of more rows than one place keeps."""

import math

import numpy as np
import pytest

from tabulon.operators import multivar


def plain(x, cats, most):
    """BIC by joins of the nearest pair, every term from the members themselves; the silhouette from all pairs."""
    n, p = x.shape
    z = (x - x.mean(0)) / x.std(0)

    def xi(rows):
        s = sum(0.5 * math.log(1 + z[rows, j].var()) for j in range(p))
        for c in cats.T:
            _, k = np.unique(c[rows], return_counts=True)
            s -= (k / len(rows) * np.log(k / len(rows))).sum()
        return -len(rows) * s

    live, saved = [[i] for i in range(n)], {}
    while True:
        if len(live) <= most:
            saved[len(live)] = [list(m) for m in live]
        if len(live) == 1:
            break
        own = [xi(m) for m in live]
        _, i, j = min((own[i] + own[j] - xi(sorted(live[i] + live[j])), i, j) for i in range(len(live)) for j in range(i + 1, len(live)))
        live[i] = sorted(live[i] + live.pop(j))
    free = 2 * p + sum(len(set(c)) - 1 for c in cats.T)
    bic = {k: -2 * sum(xi(m) for m in ms) + k * free * math.log(n) for k, ms in saved.items()}
    best = min(bic, key=bic.get)
    lab = np.zeros(n, int)
    for c, m in enumerate(saved[best]):
        lab[m] = c
    g = (np.abs(x[:, None] - x[None]) / np.ptp(x, axis=0)).sum(2) + (cats[:, None] != cats[None]).sum(2)
    g = g / (p + cats.shape[1])
    sil = []
    for i in range(n):
        own = (lab == lab[i]) & (np.arange(n) != i)
        if not own.any():
            sil.append(0.0)
            continue
        a, b = g[i, own].mean(), min(g[i, lab == c].mean() for c in set(lab) - {lab[i]})
        sil.append((b - a) / max(a, b))
    return bic, best, lab, float(np.mean(sil))


def blobs(seed, n):
    r = np.random.default_rng(seed)
    k = r.integers(0, 3, n)
    x = np.round(np.column_stack([k * 5 + r.normal(0, 0.6, n), (k == 1) * 7 + r.normal(0, 0.7, n)]), 3)
    return k, x, np.column_stack([np.where(r.random(n) < 0.9, k, 0), r.integers(0, 2, n)]).astype(str)


def rows_of(spark, x, c):
    return spark.createDataFrame([(*map(float, a), *map(str, b)) for a, b in zip(x, c)], "p double, q double, g string, h string").repartition(6)


def same_parts(a, b):
    return len({*zip(a, b)}) == len({*a}) == len({*b})


def test_twostep_against_the_definition(spark):
    _, x, c = blobs(1, 60)
    x[10], c[10] = x[11], c[11]
    bic, best, lab, sil = plain(x, c, 5)
    got = multivar.twostep(rows_of(spark, x, c), ["p", "q"], ["g", "h"], 5)
    table = {r.k: r for r in got["bic"].collect()}
    assert {k: r.bic for k, r in table.items()} == pytest.approx(bic)
    assert table[best].silhouette == pytest.approx(sil)
    found = {(r.p, r.q, r.g, r.h): r.cluster for r in got["clusters"].collect()}
    assert same_parts([found[(*map(float, a), *map(str, b))] for a, b in zip(x, c)], lab.tolist())


def test_twostep_of_many_rows(spark):
    k, x, c = blobs(2, 6000)
    got = multivar.twostep(rows_of(spark, x, c), ["p", "q"], ["g", "h"], 6, leaves=300)
    rows = got["clusters"].collect()
    assert len(rows) == 6000
    where = {(r.p, r.q, r.g, r.h): r.cluster for r in rows}
    found = [where[(*map(float, a), *map(str, b))] for a, b in zip(x, c)]
    blob = {f: set() for f in set(found)}
    for f, b in zip(found, k.tolist()):
        blob[f].add(b)
    mixed = sum(f != max(set(found), key=found.count) and len(blob[f]) > 1 for f in blob)
    assert len(blob) >= 3 and mixed <= 1
    one = next(r.bic for r in got["bic"].collect() if r.k == 1)
    z = multivar.Features(np.array([6000.0]), np.zeros((1, 2)), np.full((1, 2), 6000.0), np.array([[(c[:, 0] == v).sum() for v in "012"] + [(c[:, 1] == v).sum() for v in "01"]], float))
    assert one == pytest.approx(-2 * z.xi()[0] + (4 + 2 + 1) * math.log(6000), rel=1e-9)


def test_twostep_of_too_few_rows(spark):
    _, x, c = blobs(3, 5)
    got = multivar.twostep(rows_of(spark, x, c), ["p", "q"], ["g", "h"])
    assert got["clusters"].count() == got["bic"].count() == 0


def test_features_add_up():
    r = np.random.default_rng(0)
    z, hot = r.normal(size=(40, 2)), np.eye(3)[r.integers(0, 3, 40)]
    f = multivar.Features(np.ones(40), z, z * z, hot)
    small = multivar.shrink(f, 7)
    assert len(small.m) == 7 and small.table().sum(0) == pytest.approx(f.table().sum(0))
