"""Running sums over ranges against plain ones: skewed, all distinct, extreme values, groups, both directions."""

import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.operators.describe import quantiles, ranked_counts
from tabulon.operators.running import order_bits, running_sums


def test_order_bits_grow_with_doubles(spark):
    r = random.Random(1)
    values = {0.0, 5e-324, -5e-324, 1e-310, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1.5, 2.0, 4.0, 3.9999999999999996, 1e300, 0.1, 2.0**1023, 2.0**-1022}
    values |= {math.nextafter(2.0**e, d) for e in range(-1074, 1024, 7) for d in (0.0, math.inf)} | {-(2.0**e) for e in range(-300, 300, 11)}
    values |= {x for x in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)) if math.isfinite(x)} | {r.gauss(0, 1) for _ in range(2000)} | {float(i) for i in range(-50, 50)}
    got = spark.createDataFrame([(x,) for x in values], "v double").select("v", order_bits(F.col("v")).alias("k")).collect()
    keys = [r.k for r in sorted(got, key=lambda r: r.v)]
    assert keys == sorted(keys) and None not in keys
    assert len(set(keys)) > 0.999 * len(keys)


def plain(rows, descending):
    out = {}
    for g in {r[0] for r in rows}:
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: r[1], reverse=descending), 0
        whole = sum(r[2] for r in own)
        for _, v, x in own:
            total += x
            out[(g, v)] = (total, whole)
    return out


SHAPES = {
    "distinct": lambda r: [(None if i % 17 == 0 else f"g{i % 3}", i * 0.1, r.randint(0, 9)) for i in range(4000)],
    "one narrow range": lambda r: [("a", 1e9 + i * 1e-6, r.randint(0, 9)) for i in range(3000)],
    "one large group": lambda r: [("big" if i % 20 else f"s{i}", r.gauss(0, 10.0 ** r.randint(-6, 6)), 1) for i in range(3000)],
    "powers": lambda r: [("a", s * 2.0**e, 1) for s in (1, -1) for e in range(-1000, 1000)] + [("a", 0.0, 5)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, shape, descending):
    rows = SHAPES[shape](random.Random(2))
    df = spark.createDataFrame(rows, "g string, v double, x long").repartition(5)
    got = running_sums(df, "v", {"up": "x"}, ["g"], descending, {"all": "up"}).collect()
    assert len(got) == len(rows) and {(r.g, r.v): (r.up, r["all"]) for r in got} == plain(rows, descending)


def test_running_sums_of_an_empty_table(spark):
    assert running_sums(spark.createDataFrame([], "v double, x long"), "v", {"up": "x"}, totals={"all": "up"}).collect() == []


def test_every_window_is_of_a_range_or_over_ranges(spark):
    df = spark.range(1000).select((F.rand(1) * 1000).alias("v"))
    plan = ranked_counts(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_fine" in w or "_coarse" in w or "_t0" in w for w in windows)
    assert not any("[v#" in w.split("windowspecdefinition")[1].split("ASC")[0].split(",")[0] for w in windows if "_fine" not in w and "_coarse" not in w)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=60))
def test_quantiles_against_numpy(spark, values):
    import numpy as np

    got = quantiles(spark.createDataFrame([(x,) for x in values], "v double"), "v", (0.25, 0.5, 0.75), definition="type7").collect()[0]
    assert list(got) == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-9, abs=1e-9)
