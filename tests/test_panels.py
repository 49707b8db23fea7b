"""Panels of dense tables: many exposures of one pointing, most of which link each other."""

import duckdb
import pytest
from pyspark.sql import functions as F

from framewise.operators import graph, spatial
from framewise.plans import catalogue, panels


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Two nations' exposures within a few pixels, a second group out of reach of the first, and strays."""
    d = str(tmp_path_factory.mktemp("dense"))
    bal = F.pmod(F.col("id") * 7919, F.lit(97)) * 1.5 + F.when(F.col("id") % 3 == 0, 400.0).otherwise(0.0) + F.when(F.col("id") % 41 == 0, 900.0).otherwise(0.0)
    c = spark.range(240).select(F.col("id").alias("c_custkey"), bal.alias("c_acctbal"), F.when(F.col("id") % 41 == 0, F.col("id") % 5).otherwise(F.col("id") % 2).cast("int").alias("c_nationkey"))
    c.write.parquet(f"{d}/customer.parquet")
    return d


def sql(d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet/*.parquet'")
    return con.execute(catalogue.oracle_sql()[name])


def same(spark, d, name):
    theirs = sql(d, name)
    cols = [x[0] for x in theirs.description]
    plain = lambda r: tuple(round(float(v), 5) for v in r)
    return sorted(plain(r) for r in theirs.fetchall()) == sorted(plain(r) for r in catalogue.queries()[name](spark, d).select(*cols).collect())


def test_components_of_dense_panels_make_few_pairs(spark, dense, monkeypatch):
    made = []
    real = panels._links
    monkeypatch.setattr(panels, "_links", lambda pairs: (made.append(pairs.count()), real(pairs))[1])
    assert same(spark, dense, "panel_components")
    assert len(made) == 2 and sum(made) < 14 * 240  # all pairs within reach are 27,503


@pytest.mark.parametrize("name", ["panel_tree", "panel_transforms"])
def test_forests_link_representatives_only(spark, dense, monkeypatch, name):
    made = []
    real = panels._links
    monkeypatch.setattr(panels, "_links", lambda pairs: (made.append(pairs.count()), real(pairs))[1])
    assert same(spark, dense, name)
    assert len(made) == 3 and made[2] < 240


def test_pairs_between_components_are_all_there(spark):
    rows = [(i, float(i * 37 % 50), float(i * 11 % 23), (i * i) % 3) for i in range(60)] + [(60, None, 1.0, 2)]
    got = {frozenset((r["p"]["id"], r["q"]["id"])) for r in spatial.between(spark.createDataFrame(rows, "id long, x double, y double, comp long"), 6.0).collect()}
    want = {frozenset((a[0], b[0])) for a in rows[:-1] for b in rows[:-1] if a[3] != b[3] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 36.0}
    assert got == want


def test_components_of_chains_stars_and_unknown_nodes(spark):
    links = [(i, i + 1) for i in range(40)] + [(90, i) for i in range(60, 70)] + [(95, 95), (96, 777), (71, 70), (70, 71)]
    nodes = [*range(45), *range(60, 100)]
    want = {n: n for n in nodes} | {n: 0 for n in range(41)} | {n: 60 for n in [90, *range(60, 70)]} | {71: 70}
    found = graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["comp"] for r in found.collect()} == want
