"""Fits of transforms and lines on large and awkward groups."""

import numpy as np
from pyspark.sql import functions as F

from framewise.operators import asterism, rank, robust_fit


def test_simplest_fit_of_few_and_coinciding_pairs(spark):
    """A group at one point has a translation; what the pairs are made from may be small files, so they are never broadcast."""
    rows = [("one", 3.0, 4.0, 5.0, 7.0), ("same", 1.0, 1.0, 2.0, 3.0), ("same", 1.0, 1.0, 2.0, 3.0)]
    rng = np.random.default_rng(1)
    turned = {"moved": (1, 0, 0, 1), "turned": (0.8, -0.6, 0.6, 0.8), "grown": (1.6, -1.2, 1.2, 1.6), "sheared": (1, 0.5, 0, 1)}
    for name, (a, b, d, e) in turned.items():
        rows += [(name, float(x), float(y), float(a * x + b * y + 2), float(d * x + e * y - 1)) for x, y in rng.uniform(0, 50, (12, 2))]
    pairs = spark.createDataFrame(rows, "g string, x double, y double, u double, v double")
    found = asterism.simplest_fit(pairs, ["g"], 1e-6)
    assert {r["g"]: r["model"] for r in found.collect()} == {"one": "translation", "same": "translation", "moved": "translation", "turned": "euclidean", "grown": "similarity", "sheared": "affine"}
    for r in found.where(F.col("g").isin(list(turned))).collect():
        assert r["rms"] < 1e-9 and np.allclose([r["transform"][k] for k in "abde"], turned[r["g"]])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_median_of_many_is_the_median(spark):
    rng = np.random.default_rng(2)
    groups = {"one": [3.5], "two": [0.0, 1e9], "zeros": [0.0] * 7 + [1.0] * 3, "alike": list(5 + rng.uniform(0, 1e-6, 101)), "wide": list(10 ** rng.uniform(-12, 12, 200)), "steps": [1e-3] * 50 + [1e3] * 50}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("one", None)], "g string, v double").repartition(3)
    assert {r["g"]: r["med"] for r in rank.median_of_many(df, ["g"], "v").collect()} == {g: float(np.median(v)) for g, v in groups.items()}


def test_robust_line_keeps_no_group_in_memory(spark):
    """Residuals hardly repeat: an aggregate that holds each distinct one grows with the group."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 50, 300)
    y = 2.5 * x - 4 + rng.normal(0, 0.1, 300)
    y[::10] += 60
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "g string, x double, y double")
    found = robust_fit.robust_line(df, ["g"], "x", "y")
    assert "median(" not in found._jdf.queryExecution().optimizedPlan().toString() and "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    w = np.ones(300)
    for _ in range(3):
        gain, shift = np.polyfit(x, y, 1, w=np.sqrt(w))
        r = y - gain * x - shift
        k = 4 * 1.4826 * np.median(abs(r))
        w = np.where(abs(r) < k, (1 - (r / k) ** 2) ** 2, 0)
    got = found.first()
    assert got["n"] == 300 and np.allclose([got["gain"], got["shift"]], [gain, shift], atol=1e-9)
