"""Shifts of patches against moves that are known; the window holds still, so found moves are up to a tenth short."""

import numpy as np
import pytest

from framewise.operators import correlate


def blobs(n, dx, dy, seed=1):
    """A smooth patch, moved by (dx, dy)."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n]
    return sum(a * np.exp(-((x - px - dx) ** 2 + (y - py - dy) ** 2) / 8) for a, px, py in zip(rng.uniform(0.3, 1, 12), rng.uniform(4, n - 4, 12), rng.uniform(4, n - 4, 12)))


@pytest.mark.parametrize("move", [(0, 0), (3, -2), (1.36, 0.72), (-2.5, 4.44)])
def test_a_known_move_is_found(move):
    n = 32
    dx, dy, peak, usable = correlate.correlate(np.stack([blobs(n, *move)] * 2), np.stack([blobs(n, 0, 0)] * 2))
    assert usable.all() and np.allclose(dx, move[0], atol=0.45) and np.allclose(dy, move[1], atol=0.45) and (peak > 0.1).all()


def test_awkward_patches_have_nulls(spark):
    n = 8
    good = np.random.default_rng(2).normal(size=n * n).tolist()
    rows = [(1, good, good), (2, None, good), (3, [0.5] * 64, good), (4, good[:-1] + [None], good), (5, good[:10], good), (6, good[:-1] + [float("nan")], good), (1, good, good)]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>").repartition(2)
    got = sorted((r["id"], r["dx"], r["dy"]) for r in correlate.shifts(df, n).collect())
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5, 6]
    assert all(abs(x) < 0.011 and abs(y) < 0.011 for _, x, y in got[:2]) and all(x is None and y is None for _, x, y in got[2:])
    assert correlate.shifts(df.limit(0), n).count() == 0
