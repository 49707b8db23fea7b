"""Detection and measurement of planted stars, halos, forests and potentials against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import geometry as geo
from framewise.operators import detect, graph

SIZE, RULES = 32, detect.Rules(region=16, keep=12)


def field(sigma_x, sigma_y, stars, wide=6, seed=3):
    """One frame of wide x wide tiles: noise on a sky with four levels, and stars of given width."""
    n = wide * SIZE
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n]
    v = np.array([0.06, 0.09, 0.09, 0.08])[y % 2 * 2 + x % 2] + rng.normal(0, 1e-4, (n, n))
    for sx, sy in stars:
        v += 0.5 * np.exp(-((x - sx) ** 2) / (2 * sigma_x**2) - (y - sy) ** 2 / (2 * sigma_y**2))
    v = np.floor(v * 1e5 + 0.5) / 1e5
    return [(0, tx, ty, v[ty * SIZE : ty * SIZE + SIZE, tx * SIZE : tx * SIZE + SIZE].ravel().tolist()) for ty in range(wide) for tx in range(wide)]


PLANTED = [(29 + i * 33 + (i * 0.37 + j * 0.61) % 2, 29 + j * 33 + (i * 0.53 + j * 0.29) % 2) for i in range(5) for j in range(5)]  # some on tile edges


@pytest.fixture(scope="module")
def tiles(spark):
    rows = {"round": (1.5, 1.5), "long": (2.4, 1.2)}
    return {k: spark.createDataFrame(field(*s, PLANTED), "frame long, tx long, ty long, plane array<double>").repartition(4) for k, s in rows.items()}


def measured(tiles):
    sky = detect.sky(tiles, SIZE)
    cut = detect.signals(detect.windows(detect.detect(tiles, sky, SIZE, RULES), tiles, SIZE, RULES.window), sky)
    return detect.measured(cut.join(detect.response(cut), "frame"), RULES).orderBy("cx").collect()


def test_planted_stars_are_found_and_measured(tiles):
    got = measured(tiles["round"])
    assert len(got) == len(PLANTED)
    # A cell's origin is up to two sites from its star, so a core of 2.5 sites is cut on one side.
    assert all(min(math.hypot(r["cx"] - x, r["cy"] - y) for x, y in PLANTED) < 1.0 for r in got)
    middle = sorted(r["hfd"] for r in got)[len(got) // 2]
    assert abs(middle - 2.355 * 1.5) < 0.4 and sorted(r["eccentricity"] for r in got)[len(got) // 2] < 0.5  # a Gaussian's half-flux diameter is its width at half maximum


def test_elongation_has_its_direction(tiles):
    got = measured(tiles["long"])
    assert len(got) > 15
    assert 0.7 < sorted(r["eccentricity"] for r in got)[len(got) // 2] < 0.95 and abs(sorted(r["angle"] for r in got)[len(got) // 2]) < 8


def test_a_tile_without_neighbours_finds_nothing_at_its_edge(spark, tiles):
    one = tiles["round"].where("tx = 1 AND ty = 1")
    sky = detect.sky(one, SIZE)
    assert detect.detect(one, sky, SIZE, RULES).count() == 0
    assert detect.detect(one.limit(0), sky, SIZE, RULES).count() == 0


def test_rims_come_from_the_neighbours(spark):
    n, size, reach = 3, 4, 2
    plane = np.arange((n * size) ** 2).reshape(n * size, n * size).astype(float)
    rows = [(0, x, y, plane[y * size : y * size + size, x * size : x * size + size].ravel().tolist()) for x in range(n) for y in range(n)]
    grown = detect.with_rim(spark.createDataFrame(rows, "frame int, tx int, ty int, v array<double>"), "v", size, reach)
    padded = np.pad(plane, reach, constant_values=-1)
    for r in grown.collect():
        want = padded[r["ty"] * size : r["ty"] * size + size + 2 * reach, r["tx"] * size : r["tx"] * size + size + 2 * reach].ravel()
        assert [-1 if v is None else v for v in r["v"]] == want.tolist()


def test_crowded_candidates_go_both(spark):
    c = spark.createDataFrame([(0, 20, 20, 9.0), (0, 24, 22, 8.0), (0, 40, 40, 7.0)], "frame int, cx long, cy long, s double")
    assert [r["cx"] for r in detect.uncrowded(c, detect.Rules(region=64)).collect()] == [40]


def test_forest_is_the_strongest_and_transforms_follow_it(spark):
    rng = random.Random(4)
    nodes = list(range(24)) + [100]
    links = {}
    for _ in range(60):
        a, b = sorted(rng.sample(range(12) if rng.random() < 0.5 else range(12, 24), 2))
        links[a, b] = (rng.randrange(6), rng.uniform(-0.3, 0.3), rng.uniform(-5, 5), rng.uniform(-5, 5))
    df = spark.createDataFrame([(a, b, w, th, x, y) for (a, b), (w, th, x, y) in links.items()], "a long, b long, weight int, th double, x double, y double")
    df = df.select("a", "b", "weight", geo.similarity(F.col("th"), F.lit(1.0), F.col("x"), F.col("y")).alias("t"))
    placed, tree = graph.forest(spark.createDataFrame([(n,) for n in nodes], "node long"), df)
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    kept = []
    for a, b in sorted(links, key=lambda k: (-links[k][0], k)):
        if root(a) != root(b):
            parent[root(b)] = root(a)
            kept.append((a, b))
    assert sorted((r["a"], r["b"]) for r in tree.collect()) == sorted(kept)
    matrix = lambda w, th, x, y: np.array([[math.cos(th), -math.sin(th), x], [math.sin(th), math.cos(th), y], [0, 0, 1]])
    steps = {}
    for a, b in kept:
        m = matrix(*links[a, b])
        steps.setdefault(a, []).append((b, m))
        steps.setdefault(b, []).append((a, np.linalg.inv(m)))
    want = {}
    for n in nodes:
        if n not in want:
            want[n], queue = (n, np.eye(3)), [n]
            for at in queue:
                for to, m in steps.get(at, []):
                    if to not in want:
                        want[to] = (n, want[at][1] @ m)
                        queue.append(to)
    for r in placed.collect():
        comp, m = want[r["node"]]
        assert r["comp"] == comp and np.allclose([r["t"][k] for k in geo.AFFINE], m[:2].ravel(), atol=1e-9)


def test_potentials_solve_the_normal_equations(spark):
    rng = random.Random(5)
    rows = [(a, b, rng.uniform(-1, 1), rng.uniform(0.1, 3)) for a, b in [(i, i + 1) for i in range(14)] + [tuple(rng.sample(range(15), 2)) for _ in range(12)]]
    rows += [(50, 51, 1.0, 1.0), (50, 51, 2.0, 0.0), (3, 3, 9.0, 1.0)]
    links = spark.createDataFrame(rows, "a long, b long, value double, weight double")
    known = graph.anchored(links, spark.createDataFrame([(4,)], "node long"))
    got = {r["node"]: r["x"] for r in graph.potentials(links, known).collect()}
    a, y = np.zeros((len(rows), 15)), np.zeros(len(rows))
    for i, (p, q, value, w) in enumerate(rows):
        if p != q and q < 15:
            a[i, q] += math.sqrt(w)
            a[i, p] -= math.sqrt(w)
            y[i] = math.sqrt(w) * value
    free = [i for i in range(15) if i != 4]
    want = dict(zip(free, np.linalg.lstsq(a[:, free], y, rcond=None)[0])) | {4: 0.0}
    assert set(got) == set(range(15)) and all(abs(got[n] - want[n]) < 1e-6 for n in got)
