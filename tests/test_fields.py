"""Systems solved inside rows, reweighted fits, and what curvature adds, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import linear
from framewise.operators import basis_fit


@pytest.mark.parametrize("n", [1, 3, 6])
def test_solve_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    rows, want = [], []
    for i in range(12):
        a = rng.normal(size=(n + 2, n))
        m, b = a.T @ a, rng.normal(size=n)
        rows.append((i, [float(m[p, q]) for p in range(n) for q in range(p + 1)], b.tolist()))
        want.append(np.linalg.solve(m, b))
    rows.append((12, [0.0] * (n * (n + 1) // 2), [1.0] * n))
    got = spark.createDataFrame(rows, "i int, m array<double>, b array<double>").select("i", linear.solve(F.col("m"), F.col("b"), n).alias("x")).orderBy("i").collect()
    assert got[12]["x"] is None
    for r, x in zip(got, want):
        assert np.allclose(r["x"], x, rtol=1e-6, atol=1e-8)


def test_outliers_weigh_nothing(spark):
    rng = random.Random(7)
    rows = []
    for g in range(3):
        for _ in range(60):
            x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
            v = 2 + g * x - y + rng.gauss(0, 0.01) + rng.choice([-50, 50, *[0] * 18])
            rows.append((g, x, y, v))
    rows += [(9, 0.0, 0.0, 1.0)] * 30 + [(8, 0.1, 0.2, 1.0), (8, None, None, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double, v double")
    got = {r["g"]: r["coefficients"] for r in basis_fit.robust_fit(df, ["g"], [F.lit(1.0), F.col("x"), F.col("y")], F.col("v"), passes=3).collect()}
    assert set(got) == {0, 1, 2}  # too few rows, or all in one place, make no fit
    assert all(np.allclose(got[g], [2, g, -1], atol=0.1) for g in got)


def test_curvature_is_taken_where_it_is_certain(spark):
    rows = []
    for key, curve, noise in (("flat", 0.0, 1e-6), ("curved", -0.2, 1e-6), ("unsure", -0.002, 1.0)):
        rows += [(key, x / 5, y / 5, 1 + 0.3 * x / 5 + curve * (x * x + y * y) / 25, noise) for x in range(-5, 6) for y in range(-5, 6)]
    rows += [("few", 0.1 * i, 0.0, 1.0, 1e-6) for i in range(5)] + [("line", 0.1 * i, 0.0, 1.0, 1e-6) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, x double, y double, v double, var double").withColumn("w", F.lit(1.0))
    m = basis_fit.moments(df, ["k"], "w", "x", "y", "v", "var")
    parts = basis_fit.moments(df.where("x < 0"), ["k"], "w", "x", "y", "v", "var").unionByName(basis_fit.moments(df.where("x >= 0"), ["k"], "w", "x", "y", "v", "var"))
    whole = {r["k"]: r["normal"] for r in m.collect()}
    for k, normal in whole.items():
        assert np.allclose(np.sum([r["normal"] for r in parts.where(F.col("k") == k).collect()], axis=0), normal)
    got = {r["k"]: r for r in basis_fit.checked_curvature(m, ["k"]).collect()}
    assert got["few"]["why"] == "effective_samples" and got["line"]["why"] == "quadratic_condition"
    assert abs(got["flat"]["delta"]) < 1e-9 and got["flat"]["blend"] == 0
    assert abs(got["curved"]["delta"] - 0.2 * 2 * np.mean([x * x / 25 for x in range(-5, 6)])) < 1e-6 and got["curved"]["blend"] > 0.9
    assert got["unsure"]["blend"] == 0
    assert all(0 <= r["blend"] <= 1 for r in basis_fit.checked_curvature(m, ["k"], bounded=True).collect() if r["why"] is None)
