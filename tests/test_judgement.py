"""Properties of plane functions, geometry, phases, noise fits, merges and survey flags on made inputs, against numpy or plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from framewise.functions import geometry as geo
from framewise.functions import photometry as light
from framewise.functions import tiles as plane
from framewise.operators import coverage, merge, noise, rank, spatial, survey


def np_blur(p):
    for axis in (1, 0):
        e = np.pad(p, [(1, 1) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        a, b, c = (e[:, :-2], e[:, 1:-1], e[:, 2:]) if axis else (e[:-2], e[1:-1], e[2:])
        p = (a + 2 * b + c) / 4
    return p


def np_grad(p):
    gx, gy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    return gx, gy


def test_plane_functions_equal_numpy(spark):
    rng = np.random.default_rng(2)
    planes = [rng.normal(0.5, 0.2, (16, 24)) for _ in range(3)]
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(planes)], "i int, e array<double>")
    e = F.col("e")
    got = df.select(
        "i", plane.blur3(e, 24).alias("blur"), plane.downsample2(e, 24).alias("half"), plane.tenengrad(e, 24).alias("ten"), plane.anisotropy(e, 24).alias("an"),
        plane.multiscale_laplacian(e, 24, 16).alias("lap"), plane.local_contrast(e, 24).alias("con"), plane.excess(e, 24).alias("ex"), plane.bilinear(e, 24, 16, F.lit(3.25), F.lit(-2.0)).alias("bi"),
        plane.bicubic(e, 24, 16, F.lit(5.0), F.lit(7.0)).alias("cu"), plane.mad_sigma(e).alias("mad"),
    ).collect()
    for r in got:
        p = planes[r["i"]]
        b, (gx, gy) = np_blur(p), np_grad(p)
        assert np.allclose(r["blur"], b.ravel()) and np.allclose(r["half"], p.reshape(8, 2, 12, 2).mean(axis=(1, 3)).ravel()) and math.isclose(r["ten"], (gx**2 + gy**2).mean())
        t = np.array([[(gx * gx).mean(), (gx * gy).mean()], [(gx * gy).mean(), (gy * gy).mean()]])
        low, high = np.linalg.eigvalsh(t)
        assert math.isclose(r["an"], (high - low) / (high + low))
        lap, cur, w = 0.0, p, 1.0
        for _ in range(3):
            if min(cur.shape) < 8:
                break
            nb = np_blur(cur)
            lap, w = lap + w * ((cur - nb) ** 2).mean(), w / 2
            cur = nb.reshape(nb.shape[0] // 2, 2, nb.shape[1] // 2, 2).mean(axis=(1, 3))
        assert math.isclose(r["lap"], lap) and math.isclose(r["con"], math.sqrt(((p - np_blur(b)) ** 2).mean()))
        assert r["ex"][0] is None and math.isclose(r["bi"], p[0, 3] * 0.75 + p[0, 4] * 0.25) and math.isclose(r["cu"], p[7, 5]) and math.isclose(r["mad"], 1.4826 * np.median(abs(p - np.median(p))))


def test_transforms_undo_each_other(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([tuple(rng.uniform(-2, 2) for _ in range(6)) for _ in range(40)] + [(1.0, 2.0, 0.0, 2.0, 4.0, 0.0)], "a double, b double, c double, d double, e double, f double")
    t = df.select(geo.affine(*[F.col(k) for k in geo.AFFINE]).alias("t"))
    both = t.select("t", geo.compose(F.col("t"), geo.inverse(F.col("t"))).alias("i"))
    rows = both.select("i.*").collect()
    assert [None] * 6 == list(rows[-1]) and all(np.allclose(list(r), [1, 0, 0, 0, 1, 0], atol=1e-6) for r in rows[:-1])
    models = spark.createDataFrame([(0.0, 1.0, 0.0), (0.02, 1.0, 0.0), (0.02, 1.02, 0.0), (0.02, 1.02, 0.1)], "th double, sc double, sh double")
    m = models.select(geo.similarity(F.col("th"), F.col("sc"), F.lit(3.0), F.lit(-2.0)).alias("t"), "sh").select(F.col("t").withField("b", F.col("t.b") + F.col("sh")).alias("t"))
    kinds = m.select(geo.effective_model(F.col("t"), F.lit(100.0), F.lit(80.0), 0.05).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["translation", "euclidean", "similarity", "affine"]


def test_brightness_maps_and_bounds(spark):
    rng = random.Random(8)
    rows = [tuple(rng.uniform(-1, 1) for _ in range(7)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, u double, v double")
    k = [F.col(x) for x in "abcde"]
    u, v = (F.col("u"), F.col("u") + 0.7), (F.col("v"), F.col("v") + 0.4)
    low, high = light.gain_bounds(k, u, v)
    inside = [light.gain_factor(k, F.col("u") + 0.7 * i / 4, F.col("v") + 0.4 * j / 4) for i in range(5) for j in range(5)]
    assert df.where(F.least(*inside) < low - 1e-9).count() == 0 and df.where(F.greatest(*inside) > high + 1e-9).count() == 0


def test_effective_phases_by_the_largest_gap(spark):
    rng = random.Random(1)
    groups = {0: [0.1], 1: [0.25, 0.75], 2: [i / 16 for i in range(16)], 3: [rng.random() for _ in range(40)], 4: [0.3] * 5}
    got = {r["g"]: r["effective"] for r in coverage.effective_phases(spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "g int, phase double"), ["g"], cells=8).collect()}
    for g, ps in groups.items():
        s = sorted(ps)
        gap = max([b - a for a, b in zip(s, s[1:])] + [s[0] + 1 - s[-1]])
        assert math.isclose(got[g], min(max(1 / gap, 1), len(s)))
    a = spark.createDataFrame([(0, 0.95), (0, 0.05), (1, 0.0), (1, 0.5)], "f int, p double")
    means = {r["f"]: r["phase"] for r in coverage.mean_phases(a, ["f"], "p").collect()}
    assert min(means[0], 1 - means[0]) < 1e-9 and means[1] is None


def test_noise_line_is_found_below_texture(spark):
    rng = np.random.default_rng(3)
    m = rng.uniform(0.05, 0.9, 4000)
    v = 0.002 * m + 0.0001
    v = np.where(rng.random(4000) < 0.4, v * rng.uniform(2, 50, 4000), v)  # blocks on edges
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(m, v)] + [("few", 0.1 * i, 0.1) for i in range(10)], "g string, m double, v double")
    fit = noise.lower_envelope(df, ["g"], "m", "v", 0.15).collect()
    assert len(fit) == 1 and abs(fit[0]["alpha"] - 0.002) < 2e-5 and abs(fit[0]["beta"] - 0.0001) < 3e-5


def test_moments_and_deposits_add_up_over_any_split(spark):
    s = spark.range(300).selectExpr("id % 5 AS cell", "id % 7 + 1 AS w", "id % 3 - 1 AS dx", "id % 4 - 2 AS dy", "id * 13 % 50 AS v", "id", "id % 11 / 3 AS x", "id % 13 / 4 AS y")
    of = lambda df: merge.moments(df, ["cell"], F.col("w"), F.col("dx"), F.col("dy"), F.col("v"), F.col("v") >= 49)
    assert sorted(of(s).collect()) == sorted(merge.add_moments(of(s.where("id % 3 = 0")), of(s.where("id % 3 > 0")), ["cell"]).select(*of(s).columns).collect())
    put = lambda df: merge.deposit(df, F.lit(0.7), "v")
    split = put(s.where("id < 90")).unionByName(put(s.where("id >= 90"))).groupBy("ox", "oy").agg(*[F.sum(c).alias(c) for c in ("sum_w", "sum_wv", "n")])
    assert sorted(put(s).collect()) == sorted(split.collect())


def test_a_frame_that_disagrees_loses_weight(spark):
    rng = random.Random(6)
    rows = []
    for site in range(64):
        for f in range(8):
            moved = f == 3 and site == 8
            rows.append((f, site, "R", 500 + rng.randrange(-2, 3) + (300 if moved else 0), 1000))
    rows.append((0, 99, "R", 500, 1000))
    df = spark.createDataFrame([(f, s % 8, s // 8, c, q, n) for f, s, c, q, n in rows], "frame int, cx int, cy int, ch string, s long, n long")
    compared = merge.others(df, ["cx", "cy", "ch"])
    got = {(r["frame"], r["cy"] * 8 + r["cx"]): r["weight"] for r in merge.robustness(compared, "frame", ["cx", "cy"], "ch", F.col("cx") % 4 == 0, 0.001, 0.0001).collect()}
    assert got[3, 8] == 0 and got[0, 99] == 255 and min(w for (f, s), w in got.items() if f != 3 and s != 8) == 255


def test_grids_are_not_mixed(spark):
    parts = spark.createDataFrame([("a", 0, 0, 2.0), ("a", 0, 0, 3.0), ("b", 0, 0, 9.0), ("a", 1, 0, 1.0)], "grid string, x int, y int, sum_w double")
    sums, refused = merge.combine_grids(parts, "grid", ["x", "y"])
    assert sorted(map(tuple, sums.collect())) == [("a", 0, 0, 5.0), ("a", 1, 0, 1.0)] and [tuple(r) for r in refused.collect()] == [("b", 1)]


def test_frames_are_named_against_their_own_filter(spark):
    ha = [("H", 1.0 + i / 50, 0.3, 200, None) for i in range(8)]
    o = [("O", 10.0, 0.3, 60, None) for _ in range(6)] + [("O", 7.0, 0.3, 60, None), ("O", 10.0, 0.6, 20, None), ("O", 9.0, None, None, None), ("O", None, None, None, "cut")]
    few = [("S", 1.0, 0.1, 9, None), ("S", 0.1, 0.9, 1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ha + o + few)], "i int, grp string, sharpness double, eccentricity double, stars int, error string")
    got = {r["i"]: (r["grp"], r["flags"], r["relative"]) for r in survey.flag_frames(df, "grp").collect()}
    assert all(f == [] for g, f, _ in got.values() if g in "HS")
    assert [got[i][1] for i in range(8, 18)] == [[]] * 6 + [["soft"], ["elongated", "few-stars"], ["no-stars"], ["unreadable"]]
    assert got[16][2] is None and got[17][2] is None and got[14][2] == 0.7


def test_confidence_is_relative_to_the_group(spark):
    rows = [("a", 50, 0.6 + i / 1000, 40, 50, 0.9) for i in range(9)] + [("a", 50, 3.0, 40, 50, 0.9), ("a", 0, 1.0, 0, 0, 0.5), ("b", 9, 0.5, 5, 9, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, probes int, residual double, inliers int, measured int, overlap double")
    got = {r["i"]: r["confidence"] for r in survey.normalised_confidence(df, "g").collect()}
    assert abs(got[0] - 0.72) < 0.02 and got[9] < 0.1 and got[10] is None and got[11] is None


def test_medians_and_overlap_counts(spark):
    rng = random.Random(9)
    values = [(g, rng.randrange(40)) for g in range(4) for _ in range(g * 5 + 1)]
    got = {r["g"]: (r["med"], r["n"]) for r in rank.median(spark.createDataFrame(values, "g int, v long"), ["g"], "v").collect()}
    assert got == {g: (float(np.median([v for h, v in values if h == g])), g * 5 + 1) for g in range(4)}
    a, b = ([(i, lo := rng.randrange(50), lo + rng.randrange(9)) for i in range(40)] for _ in "ab")
    n = {r["id"]: r["n"] for r in spatial.overlap_counts(spark.createDataFrame(a, "id int, lo int, hi int"), spark.createDataFrame(b, "id int, lo int, hi int")).collect()}
    assert n == {i: sum(lo <= h and k <= hi for _, k, h in b) for i, lo, hi in a}
