"""Projections: there and back, horizons, folds and faulty parameters."""

import math

from pyspark.sql import functions as F

from framewise.functions import projection as pr

GOOD = dict(cx=50.0, cy=40.0, norm=60.0, k=-0.05, p1=0.002, p2=-0.001, h=[math.cos(0.2), -math.sin(0.2), 0.1, math.sin(0.2), math.cos(0.2), 0.0, 0.02, -0.03, 1.0], ox=200.0, oy=150.0, scale=55.0)
CASES = {
    "good": {}, "flat": {"k": 0.0, "p1": 0.0, "p2": 0.0}, "strong": {"k": 0.3}, "singular": {"h": [1.0, 2.0, 0.0, 2.0, 4.0, 0.0, 0.0, 0.0, 1.0]},
    "null": {"k": None}, "nan": {"ox": float("nan")}, "scale": {"norm": 0.0}, "horizon": {"h": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0]}, "folded": {"k": -3.0},
}


def test_there_and_back(spark):
    rows = [(name, x, y, *(GOOD | change).values()) for name, change in CASES.items() for x, y in ((50.0, 40.0), (10.0, 75.0), (95.0, 5.0))]
    df = spark.createDataFrame(rows, "name string, x double, y double, cx double, cy double, norm double, k double, p1 double, p2 double, h array<double>, ox double, oy double, scale double")
    df = df.select("name", "x", "y", F.explode(F.array(pr.projection(**{n: F.col(n) for n in pr.FIELDS}))).alias("p"))
    df = df.select("name", "x", "y", "p", pr.fault(F.col("p")).alias("fault"), F.explode(F.array(pr.forward(F.col("p"), F.col("x"), F.col("y")))).alias("q"))
    got = df.select("name", "x", "y", "fault", "q", pr.backward(F.col("p"), F.col("q.x"), F.col("q.y")).alias("back")).collect()
    for r in got:
        if r["name"] in ("good", "flat", "strong"):
            assert r["fault"] is None and math.hypot(r["back"]["x"] - r["x"], r["back"]["y"] - r["y"]) < 1e-4
        elif r["name"] in ("singular", "null", "nan", "scale"):
            assert r["fault"] == {"singular": "singular", "null": "nonfinite", "nan": "nonfinite", "scale": "scale"}[r["name"]] and r["q"] is None and r["back"] is None
    centre = [r for r in got if r["name"] == "horizon" and (r["x"], r["y"]) == (50.0, 40.0)]
    assert centre[0]["fault"] == "singular" or centre[0]["q"] is None
    good = next(r for r in got if r["name"] == "flat" and (r["x"], r["y"]) == (10.0, 75.0))
    u, v = (10 - 50) / 60, (75 - 40) / 60
    z = 0.02 * u - 0.03 * v + 1
    assert math.isclose(good["q"]["x"], (math.cos(0.2) * u - math.sin(0.2) * v + 0.1) / z * 55 + 200)
