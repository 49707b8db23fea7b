"""Queries of interpolation, brightness maps, masks, patterns, memberships and plan checks; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import photometry as light
from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE, clamp, micro
from ..operators import noise, rank, selection, sequence
from ..sources.tables import frames, samples, table, tiles
from .catalogue import FRAMES, SAMPLES, TILES, M, query
from .geometry import _T, _transforms

_five = lambda c: F.floor(c * 100000 + 0.5) / 100000
_FIVE = lambda x: f"floor(({x}) * 100000 + 0.5) / 100000"


def _plane(spark, d):
    return tiles(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


# --- interpolation --------------------------------------------------------------------------------------------------------

_W = ["0.5 * (2 * t * t - t * t * t - t)", "0.5 * (3 * t * t * t - 5 * t * t + 2)", "0.5 * (4 * t * t - 3 * t * t * t + t)", "0.5 * (t * t * t - t * t)"]
_CASE = lambda t, k: "CASE " + k + "".join(f" WHEN {i} THEN {w.replace('t', t)}" for i, w in enumerate(_W)) + " END"


@query(f"""WITH {TILES}, q AS (SELECT vec_id, k, (vec_id * 13 + k * 29) % 90 / 10 - 0.75 AS px, (vec_id * 7 + k * 17) % 90 / 10 - 0.75 AS py FROM embeddings, (SELECT unnest(range(0, 3)) AS k)),
  f AS (SELECT *, floor(px)::INTEGER AS i, floor(py)::INTEGER AS j, px - floor(px) AS fx, py - floor(py) AS fy FROM q),
  n AS (SELECT f.*, a, b, v FROM f, (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b), sites s WHERE s.vec_id = f.vec_id AND s.x = least(greatest(i + a - 1, 0), 7) AND s.y = least(greatest(j + b - 1, 0), 7)),
  w AS (SELECT *, {_CASE('fx', 'a')} * {_CASE('fy', 'b')} AS w, CASE a WHEN 1 THEN 1 - fx WHEN 2 THEN fx ELSE 0 END * CASE b WHEN 1 THEN 1 - fy WHEN 2 THEN fy ELSE 0 END AS l FROM n)
  SELECT vec_id, k::INTEGER AS k, {_FIVE('sum(l * v)')} AS linear, {_FIVE('sum(w * v)')} AS cubic FROM w GROUP BY vec_id, k""")
def plane_samples(spark, d):
    t = _plane(spark, d).select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    x, y = (F.col("vec_id") * 13 + F.col("k") * 29) % 90 / 10 - 0.75, (F.col("vec_id") * 7 + F.col("k") * 17) % 90 / 10 - 0.75
    t = t.withColumn("x", x).withColumn("y", y)
    x, y, e = F.col("x"), F.col("y"), F.col("e")
    return t.select("vec_id", "k", _five(plane.bilinear(e, 8, 8, x, y)).alias("linear"), _five(plane.bicubic(e, 8, 8, x, y)).alias("cubic"))


# A displacement for each node of a 5 by 5 grid, 160 pixels apart.
_NODE = ("(x * 3 - y) / 10", "(x + y * 2) / 20")


@query(f"""WITH p AS (SELECT c_custkey, (c_custkey * 37 % 700)::DOUBLE AS x, (c_custkey * 53 % 500)::DOUBLE AS y FROM customer), g AS (SELECT *, 0.98 * x + 0.05 * y + 4 AS gx, -0.05 * x + 0.98 * y - 3 AS gy FROM p),
  c AS (SELECT *, least(greatest(gx / 160, 0), 4) AS nx, least(greatest(gy / 160, 0), 4) AS ny FROM g) SELECT c_custkey, {_FIVE('gx + (nx * 3 - ny) / 10')} AS mx, {_FIVE('gy + (nx + ny * 2) / 20')} AS my, {_FIVE('sqrt(pow((nx * 3 - ny) / 10, 2) + pow((nx + ny * 2) / 20, 2))')} AS moved FROM c""")
def warp_map(spark, d):
    """A global transform, then the displacement of a node grid read between its nodes."""
    node = lambda f: F.array(*[F.lit(f(i, j)) for j in range(5) for i in range(5)])
    u, v = node(lambda i, j: (i * 3 - j) / 10), node(lambda i, j: (i + j * 2) / 20)
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", (k * 37 % 700).cast("double").alias("x"), (k * 53 % 500).cast("double").alias("y"))
    p = p.select("c_custkey", (0.98 * F.col("x") + 0.05 * F.col("y") + 4).alias("gx"), (-0.05 * F.col("x") + 0.98 * F.col("y") - 3).alias("gy"))
    at = lambda f: plane.bilinear(f, 5, 5, clamp(F.col("gx") / 160, 0.0, 4.0), clamp(F.col("gy") / 160, 0.0, 4.0))
    return p.select("c_custkey", _five(F.col("gx") + at(u)).alias("mx"), _five(F.col("gy") + at(v)).alias("my"), _five(F.sqrt(at(u) * at(u) + at(v) * at(v))).alias("moved"))


@query(f"""WITH p AS (SELECT c_custkey, c_custkey * 37 % 700 - 350.0 AS dx, c_custkey * 53 % 500 - 250.0 AS dy FROM customer), c AS (SELECT p.*, c, CASE c WHEN 0 THEN 0.0004 WHEN 1 THEN 0 ELSE -0.0003 END AS k0, CASE c WHEN 0 THEN 0.0011 WHEN 1 THEN 0 ELSE -0.7 END AS k1 FROM p, (SELECT unnest([0, 1, 2]) AS c)),
  m AS (SELECT *, 1 + k0 + k1 * (dx * dx + dy * dy) / (430.0 * 430.0) AS m FROM c) SELECT c_custkey, c, {_FIVE('350 + CASE WHEN (k0 = 0 AND k1 = 0) OR m <= 0.5 THEN dx ELSE dx / m END')} AS x, {_FIVE('250 + CASE WHEN (k0 = 0 AND k1 = 0) OR m <= 0.5 THEN dy ELSE dy / m END')} AS y FROM m""")
def radial_magnification(spark, d):
    """Each channel's magnification about the centre; a correction that would more than double the distance isn't applied."""
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("c") + 1)
    p = table(spark, d, "customer").select("c_custkey", (k * 37 % 700 - 350.0).alias("dx"), (k * 53 % 500 - 250.0).alias("dy"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("c"))
    k0, k1 = pick((0.0004, 0.0, -0.0003)), pick((0.0011, 0.0, -0.7))
    m = 1 + k0 + k1 * (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (430.0 * 430.0)
    by = lambda c: F.when(((k0 == 0) & (k1 == 0)) | (m <= 0.5), F.col(c)).otherwise(F.col(c) / m)
    return p.select("c_custkey", "c", _five(350 + by("dx")).alias("x"), _five(250 + by("dy")).alias("y"))


@query(f"""WITH {TILES}, t AS (SELECT vec_id, max(v) FILTER (WHERE pos = 0) AS a, max(v) FILTER (WHERE pos = 1) AS b, max(v) FILTER (WHERE pos = 2) AS c FROM sites GROUP BY vec_id), e AS (SELECT *, sqrt((a - c) * (a - c) + 4 * b * b) AS disc, a - 2 * b + c AS den FROM t)
  SELECT vec_id, {_FIVE('(a + c + disc) / 2')} AS l1, {_FIVE('(a + c - disc) / 2')} AS l2, {_FIVE('CASE WHEN abs(b) > 1e-20 THEN atan2(b, (a + c + disc) / 2 - c) WHEN a >= c THEN 0 ELSE pi() / 2 END')} AS turn,
    {_FIVE('CASE WHEN abs(den) < 1e-20 THEN 0 ELSE least(greatest(0.5 * (a - c) / den, -1), 1) END')} AS peak, {_FIVE('CASE WHEN abs(a) <= 0.1 THEN 1 ELSE 0.1 / abs(a) END')} AS huber FROM e""")
def small_algebra(spark, d):
    """Eigenvalues and axis of a symmetric 2 by 2 matrix, the vertex through three values, and a Huber weight."""
    t = _plane(spark, d).select("vec_id", *[F.element_at("e", i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    disc, den = F.sqrt((a - c) * (a - c) + 4 * b * b), a - 2 * b + c
    turn = F.when(F.abs(b) > 1e-20, F.atan2(b, (a + c + disc) / 2 - c)).when(a >= c, 0.0).otherwise(F.pi() / 2)
    peak = F.when(F.abs(den) < 1e-20, 0.0).otherwise(clamp(0.5 * (a - c) / den, -1.0, 1.0))
    huber = F.when(F.abs(a) <= 0.1, 1.0).otherwise(0.1 / F.abs(a))
    return t.select("vec_id", _five((a + c + disc) / 2).alias("l1"), _five((a + c - disc) / 2).alias("l2"), _five(turn).alias("turn"), _five(peak).alias("peak"), _five(huber).alias("huber"))


@query(f"""WITH {_T}, i AS (SELECT *, a * e - b * d AS det FROM m), g AS (SELECT i.*, x * 16 AS x, y * 16 AS y FROM i, (SELECT unnest(range(0, 40)) AS x), (SELECT unnest(range(0, 30)) AS y)),
  s AS (SELECT id, (e * (x - c) - b * (y - f)) / det AS sx, (a * (y - f) - d * (x - c)) / det AS sy FROM g) SELECT id, {_FIVE('avg(CASE WHEN floor(sx * 1e6 + 0.5) >= 0 AND floor(sy * 1e6 + 0.5) >= 0 AND sx < 640 AND sy < 480 THEN 1 ELSE 0 END)')} AS overlap FROM s GROUP BY id""")
def overlap_fraction(spark, d):
    """The share of a 16-pixel lattice over the reference that a frame still covers."""
    lattice = F.explode(F.sequence(F.lit(0), F.lit(39)))
    g = _transforms(spark, d).withColumn("x", lattice).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29))))
    x, y = geo.apply(geo.inverse(F.col("t")), F.col("x") * 16, F.col("y") * 16)
    inside = (F.floor(x * 1e6 + 0.5) >= 0) & (F.floor(y * 1e6 + 0.5) >= 0) & (x < 640) & (y < 480)
    return g.groupBy("id").agg(_five(F.avg(inside.cast("int"))).alias("overlap"))


@query(f"""WITH f AS (SELECT p_partkey, p_size * 40 + 60 AS w, p_size * 30 + 50 AS h FROM part), u AS (SELECT *, w - 64 AS uw, h - 64 AS uh FROM f WHERE w >= 66 AND h >= 66), s AS (SELECT *, greatest(greatest(uw, uh) / 12, 32.0) AS st FROM u),
  n AS (SELECT *, greatest(floor(uw / st)::INTEGER, 1) AS nx, greatest(floor(uh / st)::INTEGER, 1) AS ny FROM s), g AS (SELECT *, unnest(range(0, (nx + 1) * (ny + 1))) AS k FROM n)
  SELECT p_partkey, k::INTEGER AS k, {_FIVE('32 + uw * ((k % (nx + 1)) / nx)')} AS x, {_FIVE('32 + uh * ((k // (nx + 1)) / ny)')} AS y FROM g UNION ALL SELECT p_partkey, 0, w / 2, h / 2 FROM f WHERE w < 66 OR h < 66""")
def probe_grid(spark, d):
    """Centres of 64-pixel patches, about 12 along the longer side; the middle of a frame that is too small."""
    f = table(spark, d, "part").selectExpr("p_partkey", "p_size * 40 + 60 AS w", "p_size * 30 + 50 AS h")
    n = f.where("w >= 66 AND h >= 66").selectExpr("p_partkey", "w - 64 AS uw", "h - 64 AS uh").withColumn("st", F.greatest(F.greatest("uw", "uh") / 12, F.lit(32.0)))
    n = n.withColumn("nx", F.greatest(F.floor(F.col("uw") / F.col("st")).cast("int"), F.lit(1))).withColumn("ny", F.greatest(F.floor(F.col("uh") / F.col("st")).cast("int"), F.lit(1)))
    g = n.selectExpr("*", "explode(sequence(0, (nx + 1) * (ny + 1) - 1)) AS k")
    g = g.select("p_partkey", "k", _five(32 + F.col("uw") * (F.expr("k % (nx + 1)") / F.col("nx"))).alias("x"), _five(32 + F.col("uh") * (F.expr("k div (nx + 1)") / F.col("ny"))).alias("y"))
    return g.unionByName(f.where("w < 66 OR h < 66").select("p_partkey", F.lit(0).alias("k"), (F.col("w") / 2).alias("x"), (F.col("h") / 2).alias("y")))


# --- brightness maps, masks, signal ---------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 5 THEN 0.0 ELSE 0.5 + c_custkey % 25 / 20 END AS g, (c_nationkey % 5 - 2) / 10 AS o FROM customer)
  SELECT m.id, {_FIVE('m.g * 0.5 + m.o')} AS applied, CASE WHEN abs(m.g) >= 1e-6 THEN {_FIVE('1 / m.g')} END AS back_gain, CASE WHEN abs(m.g) >= 1e-6 THEN {_FIVE('-m.o / m.g')} END AS back_offset, {_FIVE('m.g * n.g')} AS gain, {_FIVE('m.g * n.o + m.o')} AS offset_of FROM m JOIN m n ON n.id = m.id + 1""")
def brightness_maps(spark, d):
    k, r = F.col("c_custkey"), F.col("c_nationkey") % 5
    m = table(spark, d, "customer").select(k.alias("id"), light.linear(F.when(k % 6 == 5, 0.0).otherwise(0.5 + k % 25 / 20), (r - 2) / 10).alias("m"))
    both = m.join(m.select((F.col("id") - 1).alias("id"), F.col("m").alias("n")), "id")
    back, two = light.inverse(F.col("m")), light.compose(F.col("m"), F.col("n"))
    return both.select("id", _five(light.apply(F.col("m"), F.lit(0.5))).alias("applied"), _five(back["gain"]).alias("back_gain"), _five(back["offset"]).alias("back_offset"), _five(two["gain"]).alias("gain"), _five(two["offset"]).alias("offset_of"))


@query(f"""WITH c AS (SELECT s_suppkey, (s_suppkey % 7 - 3) / 10 AS a, (s_nationkey % 5 - 2) / 10 AS b, (s_suppkey % 3 - 1) / 5 AS c, (s_nationkey % 3 - 1) / 5 AS d, 0.1 AS e, (s_suppkey % 4 - 2) / 2 AS u0, (s_suppkey % 4 - 2) / 2 + 0.75 AS u1, -0.5 AS v0, 0.25 AS v1 FROM supplier),
  t AS (SELECT *, CASE WHEN u0 <= 0 AND u1 >= 0 THEN 0.0 ELSE least(u0 * u0, u1 * u1) END AS uu0, greatest(u0 * u0, u1 * u1) AS uu1, least(u0 * v0, u0 * v1, u1 * v0, u1 * v1) AS uv0, greatest(u0 * v0, u0 * v1, u1 * v0, u1 * v1) AS uv1, 0.0 AS vv0, 0.25 AS vv1 FROM c)
  SELECT s_suppkey, {_FIVE('exp(a * u0 + b * v0 + c * u0 * u0 + d * u0 * v0 + e * v0 * v0)')} AS factor, {_FIVE('exp(least(a * u0, a * u1) + least(b * v0, b * v1) + least(c * uu0, c * uu1) + least(d * uv0, d * uv1) + least(e * vv0, e * vv1))')} AS low,
    {_FIVE('exp(greatest(a * u0, a * u1) + greatest(b * v0, b * v1) + greatest(c * uu0, c * uu1) + greatest(d * uv0, d * uv1) + greatest(e * vv0, e * vv1))')} AS high FROM t""")
def gain_bounds(spark, d):
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    c = [(s % 7 - 3) / 10, (n % 5 - 2) / 10, (s % 3 - 1) / 5, (n % 3 - 1) / 5, F.lit(0.1)]
    u, v = ((s % 4 - 2) / 2, (s % 4 - 2) / 2 + 0.75), (F.lit(-0.5), F.lit(0.25))
    low, high = light.gain_bounds(c, u, v)
    return table(spark, d, "supplier").select("s_suppkey", _five(light.gain_factor(c, u[0], v[0])).alias("factor"), _five(low).alias("low"), _five(high).alias("high"))


@query(f"""WITH {TILES}, m AS (SELECT vec_id, x, y, v > 0.2 AS b FROM sites), dl AS (SELECT DISTINCT vec_id, x + i AS x, y + j AS y FROM m, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE b AND x + i BETWEEN 0 AND 7 AND y + j BETWEEN 0 AND 7),
  ix AS (SELECT *, CASE x WHEN 0 THEN 1 WHEN 7 THEN 6 ELSE x END AS ix, CASE y WHEN 0 THEN 1 WHEN 7 THEN 6 ELSE y END AS iy FROM m), ed AS (SELECT k.vec_id, k.x, k.y, k.b OR ((k.x IN (0, 7) OR k.y IN (0, 7)) AND (p.b OR q.b OR r.b)) AS b FROM ix k JOIN m p ON p.vec_id = k.vec_id AND p.x = k.ix AND p.y = k.iy
    JOIN m q ON q.vec_id = k.vec_id AND q.x = k.ix AND q.y = k.y JOIN m r ON r.vec_id = k.vec_id AND r.x = k.x AND r.y = k.iy)
  SELECT vec_id, (SELECT count(*) FROM dl WHERE dl.vec_id = e.vec_id) AS dilated, count(*) FILTER (WHERE b) AS extended, sum(CASE WHEN b THEN y * 8 + x ELSE 0 END)::BIGINT AS places FROM ed e GROUP BY vec_id""")
def blocked_masks(spark, d):
    t = _plane(spark, d).select("vec_id", F.transform("e", lambda v: (v > 0.2).cast("int")).alias("m"))
    t = t.select("vec_id", plane.dilated(F.col("m"), 8, 8).alias("a"), plane.extended_to_edge(F.col("m"), 8, 8).alias("b"))
    count = lambda m: F.aggregate(m, F.lit(0).cast("long"), lambda s, v: s + v)
    return t.select("vec_id", count("a").alias("dilated"), count("b").alias("extended"), count(F.transform("b", lambda v, i: v * i)).alias("places"))


@query(f"""WITH {SAMPLES}, c AS (SELECT ch, x, y, sum(q) / count(*) / 50 AS v FROM samples GROUP BY ALL), s AS (SELECT ch, {M('median(v)')} AS sky FROM c GROUP BY ch), k AS (SELECT ch, x // 2 AS cx, y // 2 AS cy, floor((v - sky) * 1000000 + 0.5)::BIGINT AS e, sky FROM c JOIN s USING (ch))
  SELECT ch, cx, cy, {_FIVE('0.5 * sum(e) / 1000000 / sqrt(greatest(0.02 * greatest(any_value(sky), 0) + 0.001, 1e-12))')} AS snr FROM k GROUP BY ch, cx, cy""")
def cell_signal(spark, d):
    """Signal over noise of 2 by 2 cells above the channel's background: four sites, halved."""
    c = samples(spark, d).groupBy("ch", "x", "y").agg((F.sum("q") / F.count(F.lit(1)) / 50).alias("v"))
    s = rank.median(c, ["ch"], "v", "sky").select("ch", micro(F.col("sky")).alias("sky"))
    k = c.join(s, "ch").selectExpr("ch", "x div 2 AS cx", "y div 2 AS cy", "sky", "cast(floor((v - sky) * 1000000 + 0.5) AS long) AS e")
    sigma = F.sqrt(noise.variance(F.first("sky"), F.lit(0.02), F.lit(0.001)))
    return k.groupBy("ch", "cx", "cy").agg(_five(0.5 * F.sum("e") / 1000000 / sigma).alias("snr"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 5 > 0 AND p_retailprice > 950 THEN {_FIVE('p_size / 10 * 206.265 * (p_size % 5) / p_retailprice')} END AS arcsec, {_FIVE('p_size / 50 / greatest(sqrt(greatest(0.02 * (p_size / 50) + 0.001, 1e-12)), 1e-12)')} AS snr FROM part""")
def star_width(spark, d):
    """Widths as angles, null for unknown optics, and the signal over noise at a level."""
    size = F.col("p_size")
    focal = F.when(F.col("p_retailprice") > 950, F.col("p_retailprice"))
    level = size / 50
    return table(spark, d, "part").select("p_partkey", _five(light.arcseconds(size / 10, size % 5, focal)).alias("arcsec"), _five(level / F.greatest(F.sqrt(noise.variance(level, F.lit(0.02), F.lit(0.001))), F.lit(1e-12))).alias("snr"))


@query(f"""WITH {TILES}, g AS (SELECT label, pos, median(v) AS m FROM sites GROUP BY label, pos), f AS (SELECT vec_id, list_sort(list(floor(abs(v - m) * 1000000 + 0.5)::BIGINT)) AS r FROM sites JOIN g USING (label, pos) GROUP BY vec_id) SELECT vec_id, r[floor(63 * 0.98)::INT + 1] / 1000000 AS deviation FROM f""")
def typicality(spark, d):
    """A high rank of a frame's distance from the median frame of its group: what stands in its way."""
    sites = _plane(spark, d).select("vec_id", "label", F.posexplode("e").alias("pos", "v"))
    m = rank.median(sites, ["label", "pos"], "v", "m").drop("n")
    r = sites.join(m, ["label", "pos"]).select("vec_id", F.floor(F.abs(F.col("v") - F.col("m")) * 1000000 + 0.5).alias("r"))
    packed = r.groupBy("vec_id").agg(F.sort_array(F.collect_list("r")).alias("r"))  # the values of one tile
    return packed.select("vec_id", (F.element_at("r", F.floor((F.size("r") - 1) * 0.98).cast("int") + 1) / 1000000).alias("deviation"))


# --- patterns and colour --------------------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT l_suppkey AS camera, (l_orderkey % 2) * 2 + l_linenumber % 2 AS cell, sum(l_quantity::BIGINT + CASE WHEN (l_suppkey % 3 = 0 AND (l_orderkey + l_linenumber) % 2 = 1) OR (l_suppkey % 3 = 1 AND (l_orderkey + l_linenumber) % 2 = 0) THEN 60 ELSE 0 END * (1 + l_linenumber % 2)) / count(*) AS m FROM lineitem GROUP BY ALL),
  p AS (SELECT camera, max(m) FILTER (WHERE cell = 0) AS a, max(m) FILTER (WHERE cell = 1) AS b, max(m) FILTER (WHERE cell = 2) AS c, max(m) FILTER (WHERE cell = 3) AS d FROM m GROUP BY camera HAVING count(*) = 4),
  g AS (SELECT camera, abs(a - d) AS mn, abs(b - c) AS an FROM p) SELECT camera, CASE WHEN an * 4 < mn THEN true WHEN mn * 4 < an THEN false END AS antidiagonal, CASE WHEN mn * 4 < an AND NOT an * 4 < mn THEN 'GBRG' ELSE 'RGGB' END AS pattern FROM g""")
def reconciled_pattern(spark, d):
    """Which diagonal of a 2 by 2 cell holds the two like means, with a factor of four between; a header's RGGB is moved by a row where
    the pixels say otherwise."""
    li = table(spark, d, "lineitem")
    odd, s = (F.col("l_orderkey") + F.col("l_linenumber")) % 2, F.col("l_suppkey") % 3
    extra = F.when(((s == 0) & (odd == 1)) | ((s == 1) & (odd == 0)), 60).otherwise(0) * (1 + F.col("l_linenumber") % 2)
    m = li.select(F.col("l_suppkey").alias("camera"), (F.col("l_orderkey") % 2 * 2 + F.col("l_linenumber") % 2).alias("cell"), (F.col("l_quantity").cast("long") + extra).alias("v"))
    of = lambda k: F.sum(F.when(F.col("cell") == k, F.col("v"))) / F.count(F.when(F.col("cell") == k, 1))
    p = m.groupBy("camera").agg(*[of(k).alias(f"m{k}") for k in range(4)]).where("m0 IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL AND m3 IS NOT NULL")
    main, anti = F.abs(F.col("m0") - F.col("m3")), F.abs(F.col("m1") - F.col("m2"))
    seen = F.when(anti * 4 < main, True).when(main * 4 < anti, False)
    return p.select("camera", seen.alias("antidiagonal"), F.when(seen.eqNullSafe(False), "GBRG").otherwise("RGGB").alias("pattern"))


@query(f"""WITH {SAMPLES}, c AS (SELECT ch, x, y, sum(q) / count(*) AS v FROM samples GROUP BY ALL), p AS (SELECT x, y, max(v) FILTER (WHERE ch = 'R') AS r, max(v) FILTER (WHERE ch = 'A') AS g, max(v) FILTER (WHERE ch = 'N') AS b FROM c GROUP BY x, y)
  SELECT x, y, {M('1.6 * (r / 0.5) / 1.1 - 0.4 * g / 1.1 - 0.1 * (b / 0.8) / 1.1')} AS red, {M('-0.2 * (r / 0.5) + 1.5 * g - 0.3 * (b / 0.8)')} AS green, {M('0.05 * (r / 0.5) / 0.95 - 0.5 * g / 0.95 + 1.4 * (b / 0.8) / 0.95')} AS blue FROM p WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL""")
def colour_transform(spark, d):
    """White balance by the green level, then a 3 by 3 matrix whose rows are made to sum to one."""
    balance, matrix = (0.5, 1.0, 0.8), ((1.6, -0.4, -0.1), (-0.2, 1.5, -0.3), (0.05, -0.5, 1.4))
    c = samples(spark, d).where("ch IN ('R', 'A', 'N')").groupBy("x", "y").pivot("ch", ["R", "A", "N"]).agg(F.sum("q").alias("s"), F.count("q").alias("n"))
    p = c.where("R_n > 0 AND A_n > 0 AND N_n > 0").select("x", "y", *[(F.col(f"{k}_s") / F.col(f"{k}_n") / w).alias(k) for k, w in zip("RAN", balance)])
    row = lambda m: sum((k * F.col(c) / round(sum(m), 6) for k, c in zip(m[1:], "AN")), m[0] * F.col("R") / round(sum(m), 6))
    return p.select("x", "y", *[micro(row(m)).alias(n) for m, n in zip(matrix, ("red", "green", "blue"))])


# Which channels a named palette shows as red, green and blue.
_PALETTES = {"sho": "SHO", "hubble": "SHO", "hso": "HSO", "hoo": "HOO", "ohh": "OHH", "rgb": "RGB", "natural": "RGB"}


@query("""WITH n AS (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'SHO' WHEN 1 THEN 'Hubble' WHEN 2 THEN 'hso' WHEN 3 THEN 'HOO' WHEN 4 THEN 'ohh' WHEN 5 THEN 'rgb' WHEN 6 THEN 'Natural' ELSE 'none' END AS name FROM part)
  SELECT p_partkey, CASE WHEN lower(name) IN ('sho', 'hubble') THEN 'SHO' WHEN lower(name) = 'hso' THEN 'HSO' WHEN lower(name) = 'hoo' THEN 'HOO' WHEN lower(name) = 'ohh' THEN 'OHH' WHEN lower(name) IN ('rgb', 'natural') THEN 'RGB' END AS channels FROM n""")
def palettes(spark, d):
    names = F.array(*map(F.lit, ("SHO", "Hubble", "hso", "HOO", "ohh", "rgb", "Natural", "none", "none")))
    known = F.create_map(*[F.lit(x) for kv in _PALETTES.items() for x in kv])
    return table(spark, d, "part").select("p_partkey", F.try_element_at(known, F.lower(F.element_at(names, F.col("p_size") % 9 + 1))).alias("channels"))


@query(f"""WITH {SAMPLES}, s AS (SELECT x, y, ['R', 'A', 'A', 'N'][(y % 2) * 2 + x % 2 + 1] AS ch, sum(q) * 1000000 / count(*) AS v FROM samples WHERE ch = ['R', 'A', 'A', 'N'][(y % 2) * 2 + x % 2 + 1] GROUP BY ALL), k AS (SELECT x, y, ch, floor(v + 0.5)::BIGINT AS v FROM s),
  n AS (SELECT k.ch, k.x + i AS x, k.y + j AS y, i * i + j * j AS d2, v, floor(1000000 / (1 + i * i + j * j))::BIGINT AS w FROM k, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE k.ch <> 'A' OR (abs(i) <= 1 AND abs(j) <= 1)),
  a AS (SELECT ch, x, y, sum(w * v) AS wv, sum(w) AS w, max(v) FILTER (WHERE d2 = 0) AS own FROM n WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63 GROUP BY ALL) SELECT ch, x::INTEGER AS x, y::INTEGER AS y, floor(coalesce(own::DOUBLE, wv / w) + 0.5) / 1000000 AS v FROM a""")
def demosaic(spark, d):
    """Every channel at every site: its own value, else the mean of the channel's sites nearby, the nearer the heavier."""
    pattern = F.element_at(F.array(*map(F.lit, ("R", "A", "A", "N"))), (F.col("y") % 2 * 2 + F.col("x") % 2 + 1).cast("int"))
    k = samples(spark, d).where(F.col("ch") == pattern).groupBy("ch", "x", "y").agg(F.floor(F.sum("q") * 1000000 / F.count(F.lit(1)) + 0.5).alias("v"))
    near = lambda r: [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]
    steps = lambda r: F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1000000 // (1 + i * i + j * j)).alias("w")) for i, j in near(r)])
    n = k.select("ch", "x", "y", "v", F.explode(F.when(F.col("ch") == "A", steps(1)).otherwise(steps(2))).alias("s"))
    n = n.select("ch", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), "v", F.col("s.w").cast("long").alias("w")).where("x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63")
    a = n.groupBy("ch", "x", "y").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("sw"), F.max(F.when(F.col("w") == 1000000, F.col("v"))).alias("own"))
    return a.select("ch", "x", "y", (F.floor(F.coalesce(F.col("own").cast("double"), F.col("wv") / F.col("sw")) + 0.5) / 1000000).alias("v"))


# --- memberships and plans ------------------------------------------------------------------------------------------------


@query(f"""WITH {FRAMES}, e AS (SELECT frame_id, greatest(coalesce(known, 100) / 100, 1e-9) * greatest(coalesce(CASE WHEN frame_id % 5 <> 0 THEN frame_id % 7 * 100 END, 100), 1) AS level FROM frames) SELECT frame_id, {M('level')} AS level FROM e""")
def exposure_level(spark, d):
    iso = F.when(F.col("frame_id") % 5 != 0, F.col("frame_id") % 7 * 100)
    level = F.greatest(F.coalesce("known", F.lit(100)) / 100, F.lit(1e-9)) * F.greatest(F.coalesce(iso, F.lit(100)), F.lit(1))
    return frames(spark, d).select("frame_id", micro(level).alias("level"))


@query(f"""WITH {FRAMES}, u AS (SELECT *, camera <> 'P' AND frame_id % 9 <> 0 AS usable FROM frames), f AS (SELECT grp, min(frame_id) AS first FROM u GROUP BY grp), k AS (SELECT grp, count(*) AS members, max_by(frame_id, (cents, frame_id)) AS best FROM u WHERE usable GROUP BY grp)
  SELECT grp, members, CASE WHEN (SELECT any_value(usable) FROM u WHERE frame_id = first) THEN first ELSE best END AS reference FROM k JOIN f USING (grp)""")
def registered_groups(spark, d):
    """The usable members of each group; the reference stays if it is one, else the member of the highest confidence takes its place."""
    u = frames(spark, d).withColumn("usable", (F.col("camera") != "P") & (F.col("frame_id") % 9 != 0))
    first = u.groupBy("grp").agg(F.min(F.struct("frame_id", "usable")).alias("f"))
    k = u.where("usable").groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.max_by("frame_id", F.struct("cents", "frame_id")).alias("best"))
    return k.join(first, "grp").select("grp", "members", F.when(F.col("f.usable"), F.col("f.frame_id")).otherwise(F.col("best")).alias("reference"))


@query(f"""WITH {FRAMES}, g AS (SELECT min(frame_id) AS grid FROM frames), m AS (SELECT grp, camera, frame_id, cents FROM frames WHERE frame_id <> (SELECT grid FROM g)) SELECT grp, camera, count(*) AS members, max_by(frame_id, (cents, frame_id)) AS reference FROM m GROUP BY grp, camera""")
def without_grid_frame(spark, d):
    """The frame that only sets the grid leaves its group; groups elect their references anew, and empty ones go."""
    f = frames(spark, d)
    grid = f.agg(F.min("frame_id").alias("grid"))  # one row
    m = f.join(F.broadcast(grid), F.col("frame_id") == F.col("grid"), "left_anti")
    return m.groupBy("grp", "camera").agg(F.count(F.lit(1)).alias("members"), F.max_by("frame_id", F.struct("cents", "frame_id")).alias("reference"))


@query(f"""WITH {FRAMES}, a AS (SELECT grp, frame_id, row_number() OVER (PARTITION BY grp ORDER BY ts, frame_id) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM frames WHERE known > 100000), r AS (SELECT grp, min(frame_id) AS reference FROM frames GROUP BY grp),
  t AS (SELECT DISTINCT grp, j * (n - 1) // 5 AS k FROM (SELECT DISTINCT grp, n FROM a), (SELECT unnest(range(0, 6)) AS j)) SELECT a.grp, a.frame_id FROM a JOIN r USING (grp) LEFT JOIN t ON t.grp = a.grp AND t.k = a.k WHERE n <= 6 OR t.k IS NOT NULL OR frame_id = reference""")
def sampled_contributors(spark, d):
    """Six contributors spread over a group's order, and its reference if it contributes."""
    f = frames(spark, d)
    a = f.where("known > 100000")
    placed = sequence.numbered(a, ["grp"], "day", ["ts", "frame_id"], "i").join(a.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "grp")
    r = f.groupBy("grp").agg(F.min("frame_id").alias("frame_id"))
    return selection.spread_of_groups(placed, "i", "n", 6).select("grp", "frame_id").unionByName(placed.join(r, ["grp", "frame_id"], "left_semi").select("grp", "frame_id")).distinct()


@query("""WITH l AS (SELECT turn, conv_id, trim(trim(role || '-' || turn), '"') AS entry FROM conversations), m AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'user-' || page_id ELSE 'system-' || page_id END AS id, 'assistant-' || page_id AS path FROM pages)
  SELECT conv_id, turn, coalesce(a.page_id, b.page_id) AS member FROM l LEFT JOIN m a ON a.id = entry LEFT JOIN m b ON b.path = entry""")
def review_lookup(spark, d):
    """Entries of a list as members: by id, else by path; null for what is not a member."""
    entries = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("-", "role", "turn").alias("entry"))
    k = F.col("page_id")
    m = table(spark, d, "pages").select("page_id", F.concat(F.when(k % 2 == 0, "user-").otherwise("system-"), k).alias("id"), F.concat(F.lit("assistant-"), k).alias("path"))
    by = lambda key, name: m.select(F.col(key).alias("entry"), F.col("page_id").alias(name))
    return entries.join(by("id", "a"), "entry", "left").join(by("path", "b"), "entry", "left").select("conv_id", "turn", F.coalesce("a", "b").alias("member"))


@query(f"""WITH p AS (SELECT l_orderkey AS plan, count(*) AS stars, {M('median(l_discount) * 10')} AS p50, {M('max(l_discount) * 15')} AS p90, min(l_linenumber) AS scale, max(l_tax) AS noise FROM lineitem GROUP BY l_orderkey),
  v AS (SELECT plan, unnest([CASE WHEN scale NOT BETWEEN 1 AND 8 THEN 'scale' END, CASE WHEN stars < 3 THEN 'stars' END, CASE WHEN p50 > 0.75 THEN 'median' END, CASE WHEN p90 > 1.5 THEN 'tail' END, CASE WHEN noise <= 0 OR NOT isfinite(noise) THEN 'noise' END]) AS broken FROM p) SELECT plan, broken FROM v WHERE broken IS NOT NULL""")
def plan_violations(spark, d):
    """Each rule that a plan breaks; a plan without a row is sound."""
    li = table(spark, d, "lineitem")
    p = rank.median(li, ["l_orderkey"], "l_discount", "p50").join(li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("stars"), F.max("l_discount").alias("worst"), F.min("l_linenumber").alias("scale"), F.max("l_tax").alias("noise")), "l_orderkey")
    rules = {"scale": ~F.col("scale").between(1, 8), "stars": F.col("stars") < 3, "median": micro(F.col("p50") * 10) > 0.75, "tail": micro(F.col("worst") * 15) > 1.5, "noise": (F.col("noise") <= 0) | F.isnan("noise") | (F.abs("noise") == float("inf"))}
    broken = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    return p.select(F.col("l_orderkey").alias("plan"), F.explode(broken).alias("broken"))


@query(f"""WITH w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_nationkey * 9 - 100.0 END AS dec, s_acctbal / 1e7 AS c1, s_nationkey / 1e6 AS c2 FROM supplier), s AS (SELECT *, sqrt(abs(c1 * c1 + c2 * c2)) * 3600 AS scale FROM w)
  SELECT s_suppkey, coalesce(abs(dec) <= 90 AND scale > 0.01 AND scale < 3600, false) AS plausible FROM s""")
def plausible_solutions(spark, d):
    """Whether a solution of the sky can be used: finite, on the sky, and of a scale that an instrument has."""
    s = table(spark, d, "supplier")
    dec = F.when(F.col("s_suppkey") % 11 != 0, F.col("s_nationkey") * 9 - 100.0)
    a, b = F.col("s_acctbal") / 1e7, F.col("s_nationkey") / 1e6
    scale = F.sqrt(F.abs(a * a + b * b)) * 3600
    return s.select("s_suppkey", F.coalesce((F.abs(dec) <= 90) & (scale > 0.01) & (scale < 3600), F.lit(False)).alias("plausible"))


@query(f"""WITH {SAMPLES}, c AS (SELECT ch, x, y, max(q) AS v FROM samples GROUP BY ALL), n AS (SELECT c.ch, c.x, c.y, c.v, max(o.v) FILTER (WHERE o.x <> c.x OR o.y <> c.y) AS top, count(*) AS k, sum(o.v) FILTER (WHERE o.x <> c.x OR o.y <> c.y) AS s FROM c JOIN c o ON o.ch = c.ch AND abs(o.x - c.x) <= 1 AND abs(o.y - c.y) <= 1 GROUP BY ALL)
  SELECT ch, x, y, v FROM n WHERE k >= 4 AND v * (k - 1) > s AND (v * (k - 1) - s) * (v * (k - 1) - s) >= 4 * (k - 1) * (k - 1) AND v > top""")
def isolated_hot(spark, d):
    """Sites above all their known neighbours, and above their mean by two deviations at least."""
    c = samples(spark, d).groupBy("ch", "x", "y").agg(F.max("q").alias("v"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    o = c.select("ch", "x", "y", F.col("v").alias("o"), F.explode(steps).alias("d")).select("ch", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"), "o")
    n = c.join(o.groupBy("ch", "x", "y").agg(F.max("o").alias("top"), F.sum("o").alias("s"), F.count(F.lit(1)).alias("k")), ["ch", "x", "y"])
    far = F.col("v") * F.col("k") - F.col("s")
    return n.where((F.col("k") >= 3) & (far > 0) & (far * far >= 4 * F.col("k") * F.col("k")) & (F.col("v") > F.col("top"))).select("ch", "x", "y", "v")


@query(f"""WITH {SAMPLES}, c AS (SELECT frame_id % 16 AS frame, ch, x // 4 AS bx, y // 4 AS cy, sum(q) / count(*) / 50 AS v FROM samples WHERE x % 4 < 3 GROUP BY ALL), m AS (SELECT frame, ch, median(v) AS sky FROM c GROUP BY frame, ch), k AS (SELECT frame, ch, any_value(sky) AS sky, median(abs(v - sky)) AS mad FROM c JOIN m USING (frame, ch) GROUP BY frame, ch)
  SELECT frame, ch, {M('sky')} AS sky, {M(f'mad * {MAD_SCALE}')} AS spread, {M('max(sky) OVER (PARTITION BY ch) - min(sky) OVER (PARTITION BY ch)')} AS range_of FROM k""")
def sky_levels(spark, d):
    """Each frame's background and spread by channel, and how far the frames' backgrounds lie apart."""
    c = samples(spark, d).where("x % 4 < 3").selectExpr("frame_id % 16 AS frame", "ch", "x div 4 AS bx", "y div 4 AS cy", "q")
    c = c.groupBy("frame", "ch", "bx", "cy").agg((F.sum("q") / F.count(F.lit(1)) / 50).alias("v"))
    m = rank.median_mad(c, ["frame", "ch"], "v")
    w = Window.partitionBy("ch")  # one row for each frame
    return m.select("frame", "ch", micro(F.col("med")).alias("sky"), micro(F.col("mad") * MAD_SCALE).alias("spread"), micro(F.max("med").over(w) - F.min("med").over(w)).alias("range_of"))


@query("""WITH f AS (SELECT l_orderkey AS frame_id, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*) AS obstructed, max(l_discount) * 12 AS swing FROM lineitem GROUP BY l_orderkey)
  SELECT frame_id, CASE WHEN obstructed > 0.3 THEN 'obstructed' WHEN floor(swing * 1000000 + 0.5) > 1000000 THEN 'uneven' END AS reason FROM f""")
def photometric_exclusion(spark, d):
    """Why a frame is left out: too much of it is covered, or its brightness swings too far; null for frames that stay."""
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id")).agg((F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("obstructed"), (F.max("l_discount") * 12).alias("swing"))
    return f.select("frame_id", F.when(F.col("obstructed") > 0.3, "obstructed").when(F.floor(F.col("swing") * 1000000 + 0.5) > 1000000, "uneven").alias("reason"))


@query(f"WITH {FRAMES}, m AS (SELECT grp, median(cents) AS med FROM frames GROUP BY grp) SELECT frame_id, {M('CASE WHEN camera = ' + chr(39) + 'P' + chr(39) + ' THEN 0 ELSE least(greatest((frame_id % 13) / 10, 0), 1) * least(greatest(cents / med, 0.5), 2) END')} AS weight FROM frames JOIN m USING (grp)")
def usable_weights(spark, d):
    """Confidence times sharpness against the group, each within its bounds; nothing for a frame that can't be used."""
    r = sequence.relative_to_median(frames(spark, d), ["grp"], "cents")
    value = clamp(F.col("frame_id") % 13 / 10, 0.0, 1.0) * clamp(F.col("rel"), 0.5, 2.0)
    return r.select("frame_id", micro(F.when(F.col("camera") == "P", 0.0).otherwise(value)).alias("weight"))


@query(f"WITH {FRAMES}, c AS (SELECT grp, camera, median(cents) AS med FROM frames GROUP BY grp, camera), z AS (SELECT grp, median(cents) AS z FROM frames GROUP BY grp), g AS (SELECT grp, {M('med / z')} AS gain FROM c JOIN z USING (grp)) SELECT grp, count(*) AS cameras, min(gain) AS low, max(gain) AS high, {M('max(gain) / min(gain)')} AS spread, max(gain) > 1.1 * min(gain) AS warned FROM g GROUP BY grp")
def gain_report(spark, d):
    f = frames(spark, d)
    g = rank.median(f, ["grp", "camera"], "cents").drop("n").join(rank.median(f, ["grp"], "cents", "z").drop("n"), "grp").select("grp", micro(F.col("med") / F.col("z")).alias("gain"))
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("cameras"), F.min("gain").alias("low"), F.max("gain").alias("high"), micro(F.max("gain") / F.min("gain")).alias("spread"), (F.max("gain") > 1.1 * F.min("gain")).alias("warned"))


@query(f"""WITH {FRAMES}, d AS (SELECT grp, count(*) AS frames, {M('coalesce(sum(known), 0) / 100 / 3600')} AS hours, count(DISTINCT camera) AS cameras, count(DISTINCT ts::DATE) AS nights, min(ts) AS first, max(ts) AS last, count(*) FILTER (WHERE known IS NULL) AS unknown FROM frames GROUP BY grp)
  SELECT row_number() OVER (ORDER BY frames DESC, grp)::INTEGER AS place, * FROM d""")
def catalog_overview(spark, d):
    """Each filter's frames, hours, cameras and nights, the largest first."""
    f = frames(spark, d)
    g = f.groupBy("grp").agg(F.count(F.lit(1)).alias("frames"), micro(F.coalesce(F.sum("known"), F.lit(0)) / 100 / 3600).alias("hours"), F.countDistinct("camera").alias("cameras"), F.countDistinct(F.to_date("ts")).alias("nights"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("frames"), "grp")))  # one row for each filter


@query(f"""WITH {SAMPLES}, c AS (SELECT ch, x, y, sum(q) / count(*) / 50 AS v, (x + 0.5) / 64 * 2 - 1 AS nx, (y + 0.5) / 64 * 2 - 1 AS ny FROM samples GROUP BY ALL), r AS (SELECT *, (nx * nx + ny * ny) / 2 AS r2 FROM c)
  SELECT ch, x, y, {M('v / greatest(1 - 0.3 * r2 - 0.1 * r2 * r2, 0.2) - (0.02 * nx - 0.01 * ny)')} AS v FROM r""")
def flattened(spark, d):
    """A vignette divided out and a gradient taken off, by the distance from the centre and the place in the frame."""
    c = samples(spark, d).groupBy("ch", "x", "y").agg((F.sum("q") / F.count(F.lit(1)) / 50).alias("v"))
    c = c.withColumn("nx", (F.col("x") + 0.5) / 64 * 2 - 1).withColumn("ny", (F.col("y") + 0.5) / 64 * 2 - 1)
    r2 = (F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")) / 2
    return c.select("ch", "x", "y", micro(F.col("v") / F.greatest(1 - 0.3 * r2 - 0.1 * r2 * r2, F.lit(0.2)) - (0.02 * F.col("nx") - 0.01 * F.col("ny"))).alias("v"))
