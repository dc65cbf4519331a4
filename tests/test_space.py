"""Points near each other: against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import space


def brute(x, ids, eps, least):
    sq = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1]))
    near = sq <= eps * eps
    core = near.sum(1) >= least
    at = {}
    for i in sorted(np.flatnonzero(core), key=lambda i: ids[i]):
        if i in at:
            continue
        number, todo = len(set(at.values())) + 1, [i]
        while todo:
            j = todo.pop()
            if j not in at:
                at[j] = number
                todo += [m for m in np.flatnonzero(near[j] & core) if m not in at]
    return {ids[i]: (at.get(i, min((at[j] for j in np.flatnonzero(near[i] & core)), default=-1)), bool(core[i])) for i in range(len(x))}


def points(seed, n, d):
    r = np.random.default_rng(seed)
    centre = r.uniform(0, 6, (4, d))
    x = centre[r.integers(0, 4, n)] + r.normal(0, 0.5, (n, d))
    x[: n // 4] = r.uniform(-2, 8, (n // 4, d))
    x[n // 4 : n // 3] = np.round(x[n // 4 : n // 3])  # on corners of cells, and repeated
    x[-5:] = x[-6]
    return x


@pytest.mark.parametrize("d,eps,least,work", [(1, 0.05, 3, 4096), (2, 1.0, 4, 0), (3, 1.0, 8, 2)])
def test_dbscan_against_all_pairs(spark, d, eps, least, work):
    x, ids = points(d, 240, d), [f"p{i:03d}" for i in range(240)]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in zip(ids, x)], ["id", *(f"v{i}" for i in range(d))]).repartition(3)
    got = {r.id: (r.cluster, r.core) for r in space.dbscan(df, [f"v{i}" for i in range(d)], eps, least, "id", work).collect()}
    assert got == brute(x, ids, eps, least)


def test_dbscan_of_a_dense_cell_and_missing_rows(spark):
    df = spark.range(200_000).select("id", (F.col("id") / 1e7).alias("x"), F.when(F.col("id") != 5, 0.0).alias("y"))
    df = df.union(spark.createDataFrame([(900_000, 0.5, 0.0), (900_001, 9.0, 0.0), (900_002, 9.0, 0.0), (None, 9.0, 0.0)], "id long, x double, y double"))
    got = space.dbscan(df, ["x", "y"], 0.49, 100, "id").groupBy("cluster", "core").count().collect()
    assert {(r.cluster, r.core): r["count"] for r in got} == {(1, True): 200_000, (-1, False): 2}
    assert space.dbscan(df.where("x < 0"), ["x", "y"], 0.49, 100, "id").collect() == []
    with pytest.raises(ValueError):
        space.dbscan(df, ["x"], 0.0, 2, "id")
    with pytest.raises(ValueError):
        space.dbscan(df.withColumn("x", F.col("x") * 1e30), ["x"], 0.1, 2, "id")


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(500, 100 + i) for i in range(60)]
    got = {r.node: r.root for r in space.components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 == len({got[b] for _, b in star} | {got[500]}) and got[0] != got[500] and len(got) == 122
    assert space.components(spark.createDataFrame([], "a long, b long")).collect() == []
