"""Every query of the catalogue against its SQL on the small tables, and properties that hold on any input."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from framewise.operators import rank, raster, sequence, spatial
from framewise.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    result = duck.execute(catalogue.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == cols
    expected = sorted(tuple(plain(dict(zip(theirs, r))[c]) for c in cols) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == expected


def test_entry_has_every_query(spark):
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_checkpoints_are_even_and_grow_by_a_quarter():
    points = sequence.checkpoints(1000)
    assert points[:6] == [4, 6, 8, 10, 14, 18] and all(n % 2 == 0 for n in points)


def test_partial_sums_add_up_over_any_split(spark):
    s = spark.range(500).select((F.col("id") % 7).alias("x"), (F.col("id") % 11).alias("q"), (F.col("id") % 3).alias("w"), "id")
    whole = raster.deposit(s, ["x"], "q", "w").orderBy("x").collect()
    parts = [raster.deposit(s.where(F.col("id") % 4 == i), ["x"], "q", "w") for i in range(4)]
    assert raster.combine(parts, ["x"]).select("x", "sum_w", "sum_wv", "sum_ww", "n").orderBy("x").collect() == whole
    with pytest.raises(ValueError):
        raster.combine([parts[0], parts[1].drop("n")], ["x"])


def test_two_level_running_sum_equals_one_window(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("g"), F.floor(F.col("id") / 37).alias("step"), "id", ((F.col("id") * 7919) % 101).alias("v"))
    got = {r["id"]: (r["n"], r["run_sum"], r["split_sum"]) for r in sequence.split_curve(rows, ["g"], "step", ["id"], "v").collect()}
    seen = {}
    for i in range(400):
        n, s, d = seen.get(i % 3, (0, 0, 0))
        v = i * 7919 % 101
        seen[i % 3] = n + 1, s + v, d + (v if n % 2 == 0 else -v)
        assert got[i] == seen[i % 3]


@pytest.mark.parametrize("values", [[], [5], [1, 1, 1], [3, 1, 2, 2], list(range(20))])
def test_rank_select(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "g string, v long")
    out = rank.rank_select(df, ["g"], "v", {"up": rank.upper_median(), "p90": rank.floor_rank(0.9)}).collect()
    s = sorted(values)
    assert [(r["up"], r["p90"]) for r in out] == ([(s[len(s) // 2], s[int((len(s) - 1) * 0.9)])] if s else [])


def test_nearest_agrees_with_all_distances(spark):
    import random

    rng = random.Random(3)
    a = [(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(60)]
    b = [(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(60)]
    schema = "id long, x double, y double"
    got = {r["a"]: r["b"] for r in spatial.nearest(spatial.within(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 2.0)).collect()}
    for i, x, y in a:
        d, j = min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b)
        assert got.get(i) == (j if d <= 4 else None)
