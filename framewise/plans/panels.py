"""Queries of panels: which exposures share a pointing, how pointings hang together, and the brightness that links ask for; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import graph, spatial
from ..sources.shared import materialize
from ..sources.tables import table
from .catalogue import query

WIDE, HIGH, REACH, NEAR, SAME, LINKED = 64, 48, 80.0, 32.0, 61, 20
_five = lambda c: (F.floor(F.col(c) * 100000 + 0.5) / 100000).alias(c)
_FIVE = lambda x: f"floor(({x}) * 100000 + 0.5) / 100000"

# Each customer is an exposure: its balance and nation say where it points, its key how it is turned; links are a little off.
_LINKS = f"""w AS (SELECT c_custkey AS id, c_acctbal::DOUBLE / 10 AS c, c_nationkey * 40.0 AS f, (c_custkey % 7 - 3) * 0.01 AS th FROM customer),
near AS (SELECT a.id AS a, b.id AS b, a.c AS ac, a.f AS af, a.th AS ath, b.c AS bc, b.f AS bf, b.th AS bth FROM w a JOIN w b ON a.id < b.id AND (a.c - b.c) * (a.c - b.c) + (a.f - b.f) * (a.f - b.f) <= {REACH * REACH}),
rel AS (
  SELECT a, b, cos(bth - ath) AS m, sin(bth - ath) AS n, cos(ath) * (bc - ac) + sin(ath) * (bf - af) + ((a * 31 + b * 17) % 7 - 3) * 0.01 AS c, -sin(ath) * (bc - ac) + cos(ath) * (bf - af) + ((a * 13 + b * 29) % 5 - 2) * 0.01 AS f FROM near),
grid AS (SELECT i * {(WIDE - 1) / 8} AS gx, j * {(HIGH - 1) / 8} AS gy FROM (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j)),
link AS (
  SELECT a, b, m, n, c, f, count(*) FILTER (m * gx - n * gy + c >= 0 AND m * gx - n * gy + c < {WIDE} AND n * gx + m * gy + f >= 0 AND n * gx + m * gy + f < {HIGH}) AS inside FROM rel, grid GROUP BY a, b, m, n, c, f),
both_ways AS (SELECT a AS x, b AS y FROM link WHERE inside >= {SAME} UNION ALL SELECT b, a FROM link WHERE inside >= {SAME}),
reach AS (SELECT id AS x, id AS y FROM w UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
panel AS (SELECT x AS id, min(y) AS panel FROM reach GROUP BY x)"""
_TREE = _LINKS + f""", edge AS (SELECT * FROM link WHERE inside >= {LINKED} AND a IN (SELECT panel FROM panel) AND b IN (SELECT panel FROM panel)),
way AS (SELECT a AS x, b AS y, inside, a, b FROM edge UNION ALL SELECT b, a, inside, a, b FROM edge),
better AS (
  SELECT a, b, a AS at FROM edge
  UNION SELECT r.a, r.b, w.y FROM better r JOIN edge e ON e.a = r.a AND e.b = r.b JOIN way w ON w.x = r.at AND (w.inside > e.inside OR w.inside = e.inside AND (w.a < e.a OR w.a = e.a AND w.b < e.b))),
tree AS (SELECT e.* FROM edge e WHERE NOT EXISTS (SELECT 1 FROM better r WHERE r.a = e.a AND r.b = e.b AND r.at = e.b))"""


def _exposures(spark, d) -> DataFrame:
    c = F.col
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), (c("c_acctbal").cast("double") / 10).alias("x"), (c("c_nationkey") * 40.0).alias("y"), ((c("c_custkey") % 7 - 3) * 0.01).alias("th"))


def _links(pairs: DataFrame) -> DataFrame:
    """Links (a, b, inside, t) of pairs (p, q) of exposures: t leads from b's sites to a's, a being the smaller one; inside counts the points of a grid over b that land in a."""
    c = F.col
    one = F.col("p.id") < F.col("q.id")
    pairs = pairs.select(F.when(one, c("p")).otherwise(c("q")).alias("p"), F.when(one, c("q")).otherwise(c("p")).alias("q"))
    both = pairs.where("p.id < q.id").select(*[c(f"{s}.{k}").alias(n + k) for s, n in (("p", "a"), ("q", "b")) for k in ("id", "x", "y", "th")]).withColumnRenamed("aid", "a").withColumnRenamed("bid", "b")
    turn, dx, dy = c("bth") - c("ath"), c("bx") - c("ax"), c("by") - c("ay")
    t = geo.affine(
        F.cos(turn), -F.sin(turn), F.cos("ath") * dx + F.sin("ath") * dy + ((c("a") * 31 + c("b") * 17) % 7 - 3) * 0.01,
        F.sin(turn), F.cos(turn), -F.sin("ath") * dx + F.cos("ath") * dy + ((c("a") * 13 + c("b") * 29) % 5 - 2) * 0.01,
    )
    both = both.select("a", "b", F.explode(F.array(t)).alias("t"))
    grid = F.array(*[F.struct(F.lit(i * (WIDE - 1) / 8).alias("x"), F.lit(j * (HIGH - 1) / 8).alias("y")) for j in range(9) for i in range(9)])

    def lands(p) -> F.Column:
        x, y = geo.apply(c("t"), p["x"], p["y"])
        return (x >= 0) & (x < WIDE) & (y >= 0) & (y < HIGH)

    return both.withColumn("inside", F.size(F.filter(grid, lands)))


def _panels(w: DataFrame) -> DataFrame:
    """(node, comp): components over links of SAME points and more, which join exposures less than NEAR apart: three rows or columns of a grid outside are
    27 of its 81 points. First a few near pairs of each exposure, then all pairs of exposures that aren't together yet, so no link is left out."""
    same = lambda pairs: _links(pairs).where(F.col("inside") >= SAME).select("a", "b")
    first = graph.components(w.select(F.col("id").alias("node")), same(spatial.chained(w, NEAR)))
    apart = spatial.between(w.join(first.withColumnRenamed("node", "id"), "id"), NEAR)
    comp = lambda n: first.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    rest = materialize(same(apart), "rest").join(comp("a"), "a").join(comp("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = graph.components(first.select(F.col("comp").alias("node")), rest).select(F.col("node").alias("comp"), F.col("comp").alias("low"))
    return first.join(joined, "comp").select("node", F.col("low").alias("comp"))


def _forest(spark, d) -> tuple[DataFrame, DataFrame]:
    """The forest over the panels' representatives, their smallest exposures."""
    w = _exposures(spark, d)
    own = materialize(_panels(w).select(F.col("comp").alias("id")).distinct().join(w, "id"), "representatives")
    pairs = spatial.within(own, own, REACH).where("a < b").select("a", "b")
    side = lambda n, s: own.select(F.col("id").alias(n), F.struct("id", "x", "y", "th").alias(s))
    some = _links(pairs.join(side("a", "p"), "a").join(side("b", "q"), "b")).where(F.col("inside") >= LINKED)
    return graph.forest(own.select(F.col("id").alias("node")), some.select("a", "b", F.col("inside").alias("weight"), "t"))


@query(f"WITH RECURSIVE {_LINKS} SELECT id, panel, count(*) OVER (PARTITION BY panel) AS exposures FROM panel")
def panel_components(spark, d):
    """The exposures of one pointing: three quarters of a grid over one land in the other; the panel's name is its smallest exposure."""
    found = _panels(_exposures(spark, d))
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("exposures"))
    return found.join(sizes, "comp").select(F.col("node").alias("id"), F.col("comp").alias("panel"), "exposures")


@query(f"WITH RECURSIVE {_TREE} SELECT a, b FROM tree")
def panel_tree(spark, d):
    """The links between panels that the strongest spanning forest keeps."""
    return _forest(spark, d)[1].select("a", "b")


@query(f"""WITH RECURSIVE {_TREE},
  step AS (SELECT a AS x, b AS y, m, n, c, f FROM tree UNION ALL SELECT b, a, m, -n, -(m * c + n * f), -(m * f - n * c) FROM tree),
  own AS (SELECT DISTINCT panel AS id FROM panel),
  joined AS (SELECT id AS x, id AS y FROM own UNION SELECT j.x, s.y FROM joined j JOIN step s ON s.x = j.y),
  origin AS (SELECT x AS id, min(y) AS origin FROM joined GROUP BY x),
  path AS (
    SELECT origin, id, 1.0::DOUBLE AS m, 0.0::DOUBLE AS n, 0.0::DOUBLE AS c, 0.0::DOUBLE AS f, -1::BIGINT AS before FROM origin WHERE origin = id
    UNION ALL SELECT p.origin, s.y, p.m * s.m - p.n * s.n, p.n * s.m + p.m * s.n, p.m * s.c - p.n * s.f + p.c, p.n * s.c + p.m * s.f + p.f, p.id FROM path p JOIN step s ON s.x = p.id AND s.y <> p.before)
  SELECT id, origin, {_FIVE('m')} AS a, {_FIVE('-n')} AS b, {_FIVE('c')} AS c, {_FIVE('n')} AS d, {_FIVE('f')} AS f FROM path""")
def panel_transforms(spark, d):
    """From each panel to its component's origin, along the forest."""
    found = _forest(spark, d)[0]
    t = found.select(F.col("node").alias("id"), F.col("comp").alias("origin"), "t.*")
    return t.select("id", "origin", *[_five(k) for k in ("a", "b", "c", "d", "f")])


# Each line item links its supplier's nation to its customer's: the difference of their levels that it asks for, and one over its variance.
PASSES, SCALE = 2, 2.0
_ROWS = "item AS (SELECT s_nationkey AS a, c_nationkey AS b, (l_discount - l_tax)::DOUBLE AS value, l_quantity::DOUBLE AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey)"


def _solved(k: int) -> str:
    """SQL that solves the normal equations of item{k} directly: x{k} (node, x)."""
    return f"""pair{k} AS (SELECT a, b, sum(w) AS w, sum(w * value) AS wv FROM item{k} GROUP BY a, b),
  entry{k} AS (
    SELECT a AS i, b AS j, -w AS v, 0.0 AS r FROM pair{k} UNION ALL SELECT b, a, -w, 0.0 FROM pair{k} UNION ALL SELECT a, a, w, -wv FROM pair{k} UNION ALL SELECT b, b, w, wv FROM pair{k}),
  node{k} AS (SELECT i AS node, row_number() OVER (ORDER BY i) AS k, sum(r) AS r FROM entry{k} WHERE i <> 0 GROUP BY i),
  row{k} AS (
    SELECT p.k, list_append(list(coalesce(e.v, 0.0) ORDER BY q.k), any_value(p.r)) AS row FROM node{k} p CROSS JOIN node{k} q LEFT JOIN (SELECT i, j, sum(v) AS v FROM entry{k} GROUP BY i, j) e ON e.i = p.node AND e.j = q.node GROUP BY p.k),
  step{k} AS (
    SELECT 0 AS k, list(row ORDER BY k) AS m FROM row{k}
    UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1]) ELSE list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM step{k} WHERE k < len(m)),
  x{k} AS (SELECT node, m[n.k][len(m) + 1] AS x FROM step{k} s, node{k} n WHERE s.k = len(m) UNION ALL SELECT 0, 0.0)"""


def _reweighted(k: int) -> str:
    far = f"(value - y.x + z.x) * sqrt(weight) / {SCALE}"
    return f"item{k + 1} AS (SELECT i.a, i.b, value, weight, weight / sqrt(1 + pow({far}, 2)) AS w FROM item{k} i JOIN x{k} y ON y.node = i.b JOIN x{k} z ON z.node = i.a)"


_GAINS = f"{_ROWS}, item0 AS (SELECT *, weight AS w FROM item), " + ", ".join(f"{_solved(k)}, {_reweighted(k)}" for k in range(PASSES - 1)) + f", {_solved(PASSES - 1)}"


def _items(spark, d) -> DataFrame:
    c = F.col
    who = table(spark, d, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey").join(table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("b")), "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (c("l_discount") - c("l_tax")).cast("double").alias("value"), c("l_quantity").cast("double").alias("weight"))
    by = li.join(table(spark, d, "supplier").select(c("s_suppkey").alias("l_suppkey"), c("s_nationkey").alias("a")), "l_suppkey").join(who, "l_orderkey")
    return by.where("a <> b").select("a", "b", "value", "weight")


@query(f"WITH RECURSIVE {_GAINS} SELECT node, {_FIVE('x')} AS x FROM x{PASSES - 1}")
def panel_gains(spark, d):
    """The levels of all nations that their links agree on best, outlying links weighing less in each pass; nation 0 is the zero."""
    links = materialize(_items(spark, d), "links")
    zero = spark.range(1).select(F.col("id").cast("int").alias("node"))
    return graph.robust_potentials(links, zero, PASSES, SCALE)[0].select("node", _five("x"))
