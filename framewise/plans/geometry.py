"""Queries of affine, projective and sky geometry, phase coverage, merges and robustness; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.robust import micro
from ..operators import asterism, coverage, merge, raster
from ..sources import lists
from ..sources.tables import samples, seq, stars, table
from .catalogue import SAMPLES, SEQ, M, query

_five = lambda c: F.floor(c * 100000 + 0.5) / 100000
_FIVE = lambda x: f"floor(({x}) * 100000 + 0.5) / 100000"

# A transform for each customer: none, a turn, a turn with scale, or a shear, all with a shift.
_T = """t AS (SELECT c_custkey AS id, c_custkey % 25 AS k, c_nationkey % 5 AS r FROM customer),
  p AS (SELECT id, CASE k % 4 WHEN 0 THEN 0.0 ELSE 0.01 * k END AS th, CASE WHEN k % 4 >= 2 THEN 1 + r / 50 ELSE 1.0 END AS sc, k * 1.5 AS dx, r - 2.0 AS dy, CASE WHEN k % 4 = 3 THEN 0.25 ELSE 0.0 END AS sh FROM t),
  m AS (SELECT id, sc * cos(th) AS a, -sc * sin(th) + sh AS b, dx AS c, sc * sin(th) AS d, sc * cos(th) AS e, dy AS f FROM p)"""


def _transforms(spark, d):
    k, r = F.col("c_custkey") % 25, F.col("c_nationkey") % 5
    theta = F.when(k % 4 == 0, 0.0).otherwise(0.01 * k)
    size = F.when(k % 4 >= 2, 1 + r / 50).otherwise(1.0)
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), geo.similarity(theta, size, k * 1.5, r - 2.0).alias("t"), F.when(k % 4 == 3, 0.25).otherwise(0.0).alias("sh"))
    return t.select("id", F.col("t").withField("b", F.col("t.b") + F.col("sh")).alias("t"))


@query(f"""WITH {_T}, i AS (SELECT id, a * e - b * d AS det, * EXCLUDE (id) FROM m), v AS (SELECT id, e / det AS a, -b / det AS b, -d / det AS d, a / det AS e, c AS c0, f AS f0 FROM i WHERE abs(det) >= 1e-12)
  SELECT id, {_FIVE('a')} AS a, {_FIVE('b')} AS b, {_FIVE('-(a * c0 + b * f0)')} AS c, {_FIVE('d')} AS d, {_FIVE('e')} AS e, {_FIVE('-(d * c0 + e * f0)')} AS f FROM v""")
def affine_inverse(spark, d):
    t = _transforms(spark, d).select("id", geo.inverse(F.col("t")).alias("t")).where("t IS NOT NULL")
    return t.select("id", *[_five(F.col(f"t.{k}")).alias(k) for k in geo.AFFINE])


@query(f"""WITH {_T} SELECT m.id, {_FIVE('m.a * o.a + m.b * o.d')} AS a, {_FIVE('m.a * o.b + m.b * o.e')} AS b, {_FIVE('m.a * o.c + m.b * o.f + m.c')} AS c, {_FIVE('m.d * o.a + m.e * o.d')} AS d, {_FIVE('m.d * o.b + m.e * o.e')} AS e, {_FIVE('m.d * o.c + m.e * o.f + m.f')} AS f,
  {_FIVE('sqrt(m.a * m.a + m.d * m.d) / 2 + sqrt(m.b * m.b + m.e * m.e) / 2')} AS scale, {_FIVE('atan2(m.d, m.a)')} AS turn, {_FIVE('m.c * 2')} AS c2 FROM m JOIN m o ON o.id = m.id + 1""")
def affine_compose(spark, d):
    t = _transforms(spark, d)
    o = t.select((F.col("id") - 1).alias("id"), F.col("t").alias("u"))
    both = t.join(o, "id").select("id", "t", geo.compose(F.col("t"), F.col("u")).alias("p"))
    own = F.col("t")
    return both.select("id", *[_five(F.col(f"p.{k}")).alias(k) for k in geo.AFFINE], _five(geo.scale(own)).alias("scale"), _five(geo.rotation(own)).alias("turn"), _five(geo.rescale(own, 2.0)["c"]).alias("c2"))


_FAR = lambda u: "greatest(" + ", ".join(f"sqrt(pow((m.a - ({u[0]})) * {x} + (m.b - ({u[1]})) * {y} + (m.c - m.c), 2) + pow((m.d - ({u[2]})) * {x} + (m.e - ({u[3]})) * {y}, 2))" for x, y in ((0, 0), (640, 0), (0, 480), (640, 480))) + ")"
_TURN, _SIZE = "atan2(m.d, m.a)", "(sqrt(m.a * m.a + m.d * m.d) / 2 + sqrt(m.b * m.b + m.e * m.e) / 2)"


@query(f"""WITH {_T} SELECT id, {_FIVE('a * 320 + b * 240 + c - 320')} AS cx, {_FIVE('d * 320 + e * 240 + f - 240')} AS cy, {_FIVE(_FAR(('1', '0', '0', '1')))} AS moved,
  CASE WHEN {_FAR(('1', '0', '0', '1'))} <= 0.05 THEN 'translation' WHEN {_FAR((f'cos({_TURN})', f'-sin({_TURN})', f'sin({_TURN})', f'cos({_TURN})'))} <= 0.05 THEN 'euclidean'
    WHEN {_FAR((f'{_SIZE} * cos({_TURN})', f'-{_SIZE} * sin({_TURN})', f'{_SIZE} * sin({_TURN})', f'{_SIZE} * cos({_TURN})'))} <= 0.05 THEN 'similarity' ELSE 'affine' END AS model FROM m""")
def effective_models(spark, d):
    w, h, t = F.lit(640.0), F.lit(480.0), F.col("t")
    cx, cy = geo.centre_offset(t, w, h)
    still = geo.affine(F.lit(1.0), F.lit(0.0), t["c"], F.lit(0.0), F.lit(1.0), t["f"])
    return _transforms(spark, d).select("id", _five(cx).alias("cx"), _five(cy).alias("cy"), _five(geo.max_difference(t, still, w, h)).alias("moved"), geo.effective_model(t, w, h, 0.05).alias("model"))


_H = """h AS (SELECT s_suppkey, 1 + s_nationkey / 100 AS m0, 0.02 AS m1, s_suppkey % 50 AS m2, -0.01 AS m3, 1.0 AS m4, s_nationkey AS m5, (s_suppkey % 9 - 4) / 1000 AS m6, (s_suppkey % 5 - 2) / 2000 AS m7, 1.0 AS m8 FROM supplier),
  k AS (SELECT unnest([-0.5, 639.5, -0.5, 639.5]) AS x, unnest([-0.5, -0.5, 479.5, 479.5]) AS y), z AS (SELECT h.*, x, y, m6 * x + m7 * y + m8 AS z FROM h, k)"""


@query(f"""WITH {_H}, b AS (SELECT s_suppkey, min((m0 * x + m1 * y + m2) / z) AS x0, min((m3 * x + m4 * y + m5) / z) AS y0, max((m0 * x + m1 * y + m2) / z) AS x1, max((m3 * x + m4 * y + m5) / z) AS y1, bool_and(z >= 1e-8) OR bool_and(z <= -1e-8) AS ok FROM z GROUP BY s_suppkey)
  SELECT s_suppkey, {', '.join(f"CASE WHEN ok THEN {M(c)} END AS {c}" for c in ('x0', 'y0', 'x1', 'y1'))} FROM b""")
def projected_bounds(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    m = [1 + n / 100, F.lit(0.02), k % 50, F.lit(-0.01), F.lit(1.0), n, (k % 9 - 4) / 1000, (k % 5 - 2) / 2000, F.lit(1.0)]
    s = table(spark, d, "supplier").select("s_suppkey", geo.projected_bounds(m, F.lit(640), F.lit(480)).alias("b"))
    return s.select("s_suppkey", *[micro(F.col(f"b.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1")])


_SKY = """p AS (SELECT c_custkey, (c_custkey * 37 % 4000)::DOUBLE AS x, (c_custkey * 53 % 3000)::DOUBLE AS y, radians(c_nationkey * 14.4) AS r0, radians(c_nationkey * 5 - 60) AS d0 FROM customer),
  q AS (SELECT *, radians(-0.0004 * (x - 2000) + 0.00003 * (y - 1500)) AS xi, radians(0.00003 * (x - 2000) + 0.0004 * (y - 1500)) AS eta FROM p),
  s AS (SELECT *, degrees(r0 + atan2(xi, cos(d0) - eta * sin(d0))) AS ra, degrees(asin((sin(d0) + eta * cos(d0)) / sqrt(1 + xi * xi + eta * eta))) AS dec FROM q)"""


@query(f"WITH {_SKY} SELECT c_custkey, {_FIVE('ra - 360 * floor(ra / 360)')} AS ra, {_FIVE('dec')} AS dec, round(x, 3) AS x, round(y, 3) AS y FROM s")
def sky_round_trip(spark, d):
    """Pixels to the sky, and back to where they came from."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cd = tuple(map(F.lit, (-0.0004, 0.00003, 0.00003, 0.0004)))
    c = table(spark, d, "customer").select("c_custkey", (k * 37 % 4000).cast("double").alias("x"), (k * 53 % 3000).cast("double").alias("y"), (n * 14.4).alias("r0"), (n * 5 - 60).cast("double").alias("d0"))
    sky = geo.Sky(F.lit(2000.0), F.lit(1500.0), F.col("r0"), F.col("d0"), cd)
    ra, dec = sky.to_sky(F.col("x"), F.col("y"))
    c = c.select("c_custkey", "r0", "d0", ra.alias("ra"), dec.alias("dec"))
    x, y = sky.to_pixel(F.col("ra"), F.col("dec"))
    return c.select("c_custkey", _five(F.col("ra")).alias("ra"), _five(F.col("dec")).alias("dec"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_GRID = """w AS (SELECT s_suppkey, 180 + (s_suppkey % 7 - 3) / 10 AS ra, 10 + (s_nationkey % 5 - 2) / 10 AS de, 2000.0 + s_suppkey % 11 AS px FROM supplier),
  g AS (SELECT w.*, 3999 * i / 4 AS x, 2999 * j / 4 AS y FROM w, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)),
  t1 AS (SELECT *, radians(-0.0004 * (x - px)) AS xi, radians(0.0004 * (y - 1500)) AS eta FROM g),
  t2 AS (SELECT *, radians(ra) + atan2(xi, cos(radians(de)) - eta * sin(radians(de))) - radians(180) AS a, asin((sin(radians(de)) + eta * cos(radians(de))) / sqrt(1 + xi * xi + eta * eta)) AS d FROM t1),
  t3 AS (SELECT *, sin(radians(10)) * sin(d) + cos(radians(10)) * cos(d) * cos(a) AS z FROM t2),
  t4 AS (SELECT s_suppkey, x, y, 2000 - degrees(cos(d) * sin(a) / z) / 0.0004 AS rx, 1500 + degrees((cos(radians(10)) * sin(d) - sin(radians(10)) * cos(d) * cos(a)) / z) / 0.0004 AS ry FROM t3 WHERE z > 1e-6),
  fit AS (SELECT s_suppkey, covar_pop(x, rx) / var_pop(x) AS a, covar_pop(y, rx) / var_pop(y) AS b, avg(rx) AS mrx, covar_pop(x, ry) / var_pop(x) AS c, covar_pop(y, ry) / var_pop(y) AS d, avg(ry) AS mry, avg(x) AS mx, avg(y) AS my FROM t4 GROUP BY s_suppkey HAVING count(*) >= 6)"""


@query(f"WITH {_GRID} SELECT s_suppkey, {_FIVE('a')} AS a, {_FIVE('b')} AS b, round(mrx - a * mx - b * my, 3) + 0.0 AS tx, {_FIVE('c')} AS c, {_FIVE('d')} AS d, round(mry - c * mx - d * my, 3) + 0.0 AS ty FROM fit")
def relative_affine(spark, d):
    """The affine map between the pixels of two sky projections, by least squares on 5 by 5 points: both axes of a full grid are
    independent, so each slope is a covariance over a variance."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    cd = tuple(map(F.lit, (-0.0004, 0.0, 0.0, 0.0004)))
    step = F.explode(F.sequence(F.lit(0), F.lit(4)))
    w = table(spark, d, "supplier").select("s_suppkey", (180 + (k % 7 - 3) / 10).alias("ra"), (10 + (n % 5 - 2) / 10).alias("de"), (2000.0 + k % 11).alias("px"))
    g = w.withColumn("i", step).withColumn("j", step).withColumn("x", 3999 * F.col("i") / 4).withColumn("y", 2999 * F.col("j") / 4)
    ra, dec = geo.Sky(F.col("px"), F.lit(1500.0), F.col("ra"), F.col("de"), cd).to_sky(F.col("x"), F.col("y"))
    g = g.select("s_suppkey", "x", "y", ra.alias("ra"), dec.alias("dec"))
    rx, ry = geo.Sky(F.lit(2000.0), F.lit(1500.0), F.lit(180.0), F.lit(10.0), cd).to_pixel(F.col("ra"), F.col("dec"))
    g = g.select("s_suppkey", "x", "y", rx.alias("rx"), ry.alias("ry")).where("rx IS NOT NULL AND ry IS NOT NULL")
    slope = lambda x, y: F.covar_pop(x, y) / F.var_pop(x)
    f = g.groupBy("s_suppkey").agg(slope("x", "rx").alias("a"), slope("y", "rx").alias("b"), slope("x", "ry").alias("c"), slope("y", "ry").alias("d"), *[F.avg(v).alias("m" + v) for v in ("x", "y", "rx", "ry")], F.count(F.lit(1)).alias("n")).where("n >= 6")
    shift = lambda m, p, q: F.round(F.col(m) - F.col(p) * F.col("mx") - F.col(q) * F.col("my"), 3) + 0.0
    return f.select("s_suppkey", *[_five(F.col(c)).alias(c) for c in "abcd"], shift("mrx", "a", "b").alias("tx"), shift("mry", "c", "d").alias("ty"))


# --- phases ---------------------------------------------------------------------------------------------------------------

_PHASE = """ph AS (SELECT l_orderkey AS frame_id, (l_partkey % 97) / 97 AS px, (l_suppkey % 89) / 89 AS py FROM lineitem), mp AS (SELECT frame_id, avg(cos(2 * pi() * px)) AS c, avg(sin(2 * pi() * px)) AS s FROM ph GROUP BY frame_id),
  fp AS (SELECT frame_id, CASE WHEN abs(c) >= 1e-12 OR abs(s) >= 1e-12 THEN atan2(s, c) / (2 * pi()) - floor(atan2(s, c) / (2 * pi())) END AS phase, sqrt(c * c + s * s) AS conc FROM mp)"""


def _phases(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 97 / 97).alias("px"), (F.col("l_suppkey") % 89 / 89).alias("py"))
    return li, coverage.mean_phases(li, ["frame_id"], "px")


@query(f"WITH {_PHASE} SELECT frame_id, floor(phase * 10000 + 0.5)::BIGINT % 10000 AS phase, {_FIVE('conc')} AS concentration FROM fp")
def mean_phase(spark, d):
    return _phases(spark, d)[1].select("frame_id", (F.floor(F.col("phase") * 10000 + 0.5) % 10000).alias("phase"), _five(F.col("concentration")).alias("concentration"))


@query(f"""WITH {_PHASE}, g AS (SELECT frame_id % 40 AS g, phase FROM fp WHERE phase IS NOT NULL), o AS (SELECT g, phase, lead(phase) OVER (PARTITION BY g ORDER BY phase) - phase AS gap FROM g),
  m AS (SELECT g, count(*) AS frames, greatest(coalesce(max(gap), 0), min(phase) + 1 - max(phase)) AS gap FROM o GROUP BY g) SELECT g, frames, {_FIVE('CASE WHEN gap <= 1e-6 THEN frames ELSE least(greatest(1 / gap, 1), frames) END')} AS effective FROM m""")
def effective_phases(spark, d):
    p = _phases(spark, d)[1].select((F.col("frame_id") % 40).alias("g"), "phase")
    return coverage.effective_phases(p, ["g"]).select("g", "frames", _five(F.col("effective")).alias("effective"))


@query(f"""WITH b AS (SELECT (l_partkey % 64) // 16 AS cx, (l_suppkey % 64) // 16 AS cy, (least(floor((l_suppkey % 89) / 89 * 4), 3) * 4 + least(floor((l_partkey % 97) / 97 * 4), 3)) AS bin, count(*) AS n FROM lineitem GROUP BY ALL)
  SELECT cx, cy, sum(n)::BIGINT AS samples, {_FIVE('exp(ln(sum(n)) - sum(n * ln(n)) / sum(n))')} AS phases FROM b GROUP BY cx, cy""")
def phase_coverage(spark, d):
    li = table(spark, d, "lineitem").selectExpr("(l_partkey % 64) div 16 AS cx", "(l_suppkey % 64) div 16 AS cy", "l_partkey % 97 / 97 AS px", "l_suppkey % 89 / 89 AS py")
    return coverage.phase_coverage(li, ["cx", "cy"], "px", "py").select("cx", "cy", "samples", _five(F.col("phases")).alias("phases"))


# --- merges ---------------------------------------------------------------------------------------------------------------

_MOMENTS = ("w", "wx", "wy", "wxx", "wxy", "wyy", "wv", "wvx", "wvy")


@query(f"""WITH {SAMPLES}, s AS (SELECT x // 8 AS cx, y // 8 AS cy, ch, w, q, x % 8 * 2 - 7 AS dx, y % 8 * 2 - 7 AS dy FROM samples)
  SELECT cx, cy, ch, sum(w)::BIGINT AS w, sum(w * dx)::BIGINT AS wx, sum(w * dy)::BIGINT AS wy, sum(w * dx * dx)::BIGINT AS wxx, sum(w * dx * dy)::BIGINT AS wxy, sum(w * dy * dy)::BIGINT AS wyy, sum(w * q)::BIGINT AS wv, sum(w * q * dx)::BIGINT AS wvx, sum(w * q * dy)::BIGINT AS wvy,
    min(q) AS low, max(q) AS high, bool_or(q >= 50) AS clipped FROM s GROUP BY ALL""")
def cell_moments(spark, d):
    """Moments of two splits of the samples, added up: distances are in half pixels, so every sum is a whole number."""
    s = samples(spark, d).selectExpr("x div 8 AS cx", "y div 8 AS cy", "ch", "part", "w", "q", "x % 8 * 2 - 7 AS dx", "y % 8 * 2 - 7 AS dy")
    of = lambda part: merge.moments(s.where(F.col("part") == part), ["cx", "cy", "ch"], F.col("w"), F.col("dx"), F.col("dy"), F.col("q"), F.col("q") >= 50)
    return merge.add_moments(of("F"), of("O"), ["cx", "cy", "ch"]).select("cx", "cy", "ch", *_MOMENTS, "low", "high", "clipped")


_SPREAD = SAMPLES + """, f AS (SELECT frame_id % 16 AS frame, ch, q, w, (x + frame_id % 7 / 7 + 0.5) * 2 - 0.5 AS u, (y + frame_id % 5 / 5 + 0.5) * 2 - 0.5 AS v FROM samples),
  e AS (SELECT f.*, floor(u + 0.5) + i AS ox, floor(v + 0.5) + j AS oy FROM f, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
  k AS (SELECT frame, ch, q, w, ox, oy, floor(exp(-((u - ox) * (u - ox) + (v - oy) * (v - oy)) / (2 * 0.6 * 0.6)) * 1000000 + 0.5)::BIGINT AS kernel FROM e),
  dep AS (SELECT frame, ch, ox::BIGINT AS ox, oy::BIGINT AS oy, sum(floor(kernel * (w / 100) + 0.5)::BIGINT) AS sum_w, sum(floor(kernel * (w / 100) + 0.5)::BIGINT * q) AS sum_wv, count(*) AS n FROM k WHERE kernel > 0 AND floor(kernel * (w / 100) + 0.5) > 0 GROUP BY ALL)"""


def _spread(spark, d):
    f = F.col("frame_id")
    s = samples(spark, d).select((f % 16).alias("frame"), "ch", "q", "w", (F.col("x") + f % 7 / 7).alias("x"), (F.col("y") + f % 5 / 5).alias("y"))
    return merge.deposit(s, F.col("w") / 100, "q", keep=["frame", "ch"])


@query(f"WITH {_SPREAD} SELECT ch, ox, oy, sum(sum_w)::BIGINT AS sum_w, {M('sum(sum_wv) / sum(sum_w) / 50')} AS value, sum(n)::BIGINT AS n FROM dep GROUP BY ch, ox, oy")
def kernel_deposit(spark, d):
    p = raster.combine([_spread(spark, d).drop("frame")], ["ch", "ox", "oy"])
    return p.select("ch", "ox", "oy", "sum_w", micro(F.col("sum_wv") / F.col("sum_w") / 50).alias("value"), "n")


@query(f"""WITH {_SPREAD}, b AS (SELECT frame, floor(ox / 8)::BIGINT AS bx, floor(oy / 8)::BIGINT AS "by", sum(sum_w)::DOUBLE AS d FROM dep GROUP BY ALL) SELECT bx, "by", count(*) AS frames, {_FIVE('sum(d) * sum(d) / sum(d * d)')} AS effective FROM b GROUP BY bx, "by" """)
def effective_frames(spark, d):
    return merge.effective_frames(_spread(spark, d), "frame").select("bx", "by", "frames", _five(F.col("effective")).alias("effective"))


# Sites of 4 by 4 pixels; the line number of an item is its exposure.
_OTHERS = """s AS (SELECT l_linenumber AS frame, (l_partkey % 64) // 4 AS cx, (l_suppkey % 64) // 4 AS cy, l_returnflag AS ch, sum(l_quantity::BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY ALL),
  o AS (SELECT frame, cx, cy, ch, floor(s * 1000000 / n / 50 + 0.5)::BIGINT AS own FROM s), a AS (SELECT cx, cy, ch, sum(own) AS total, count(*) AS seen FROM o GROUP BY ALL),
  c AS (SELECT o.*, seen, CASE WHEN seen > 1 THEN floor((total - own) / (seen - 1) + 0.5)::BIGINT END AS rest FROM o JOIN a USING (cx, cy, ch))"""


def _compared(spark, d):
    li = table(spark, d, "lineitem").selectExpr("l_linenumber AS frame", "(l_partkey % 64) div 4 AS cx", "(l_suppkey % 64) div 4 AS cy", "l_returnflag AS ch", "cast(l_quantity AS long) AS q")
    means = li.groupBy("frame", "cx", "cy", "ch").agg((F.sum("q") / 50).alias("s"), F.count(F.lit(1)).alias("n"))
    return merge.others(means, ["cx", "cy", "ch"])


@query(f"WITH {_OTHERS.replace('s * 1000000 / n / 50', 's / 50 * 1000000 / n')} SELECT frame, ch, count(*) AS sites, {M('median(abs(own - rest)) / 1000000')} AS typical FROM c WHERE rest IS NOT NULL AND cx % 2 = 0 AND cy % 2 = 0 GROUP BY frame, ch")
def typical_disagreement(spark, d):
    from ..operators import rank

    c = _compared(spark, d).where("rest IS NOT NULL AND cx % 2 = 0 AND cy % 2 = 0").select("frame", "ch", F.abs(F.col("own") - F.col("rest")).alias("d"))
    return rank.median(c, ["frame", "ch"], "d").select("frame", "ch", F.col("n").alias("sites"), micro(F.col("med") / 1000000).alias("typical"))


_ALPHA, _BETA = 0.05, 0.02
_EXPECTED = f"(greatest({_ALPHA} * greatest(rest / 1000000, 0) + {_BETA}, 1e-12) / 9 + 0.002 * 0.002)"


@query(f"""WITH {_OTHERS.replace('s * 1000000 / n / 50', 's / 50 * 1000000 / n')}, ty AS (SELECT frame, ch, median(abs(own - rest)) AS ty FROM c WHERE rest IS NOT NULL AND cx % 2 = 0 AND cy % 2 = 0 GROUP BY frame, ch),
  g AS (SELECT c.*, {_EXPECTED} AS ex, least(1.4826 * coalesce(ty, 0) / 1000000, 3.0 * sqrt({_EXPECTED})) AS wide, (own - rest) / 1000000 AS d FROM c LEFT JOIN ty USING (frame, ch)),
  r AS (SELECT frame, cx, cy, min(least(greatest(12.0 * exp(-(d * d) / greatest(ex, wide * wide)) - 0.12, 0), 1)) AS r, min(seen) AS seen FROM g GROUP BY ALL)
  SELECT frame, cx, cy, CASE WHEN seen < 2 THEN 255 ELSE floor(CASE WHEN r <= 0.25 THEN 0 WHEN r >= 0.5 THEN 1 ELSE ((r - 0.25) / 0.25) * ((r - 0.25) / 0.25) * (3 - 2 * ((r - 0.25) / 0.25)) END * 255 + 0.5) END::INTEGER AS weight FROM r""")
def robustness_map(spark, d):
    stride = (F.col("cx") % 2 == 0) & (F.col("cy") % 2 == 0)
    return merge.robustness(_compared(spark, d), "frame", ["cx", "cy"], "ch", stride, _ALPHA, _BETA)


@query(f"""WITH {SAMPLES}, p AS (SELECT CASE WHEN ch = 'N' THEN 'grid-b' ELSE 'grid-a' END AS grid, x, y, sum(w) AS sum_w, sum(w * q) AS sum_wv, count(*) AS n FROM samples WHERE w > 0 GROUP BY ALL), z AS (SELECT grid, count(*) AS c FROM p GROUP BY grid),
  b AS (SELECT grid FROM z ORDER BY c DESC, grid LIMIT 1) SELECT grid, x, y, sum_w::BIGINT AS sum_w, {M('sum_wv / sum_w / 50')} AS value, n FROM p WHERE grid = (SELECT grid FROM b)""")
def accumulator_grids(spark, d):
    """Partial sums of one grid are added up; those of another grid are refused."""
    s = samples(spark, d).withColumn("grid", F.when(F.col("ch") == "N", "grid-b").otherwise("grid-a"))
    parts = [raster.deposit(s.where(F.col("part") == p), ["grid", "x", "y"], "q", "w").select("grid", "x", "y", "sum_w", "sum_wv", "n") for p in ("F", "O")]
    sums, _ = merge.combine_grids(parts[0].unionByName(parts[1]), "grid", ["x", "y"])
    return sums.select("grid", "x", "y", "sum_w", micro(F.col("sum_wv") / F.col("sum_w") / 50).alias("value"), "n")


@query("""WITH f AS (SELECT c_custkey AS frame, c_custkey * 37 % 900 AS x0, c_custkey * 53 % 700 AS y0, 40 + c_nationkey * 8 AS w, 30 + c_nationkey * 6 AS h FROM customer),
  t AS (SELECT i * 128 AS tx, j * 128 AS ty FROM (SELECT unnest(range(0, 9)) AS i), (SELECT unnest(range(0, 8)) AS j))
  SELECT tx, ty, count(*) AS frames, sum((least(x0 + w, tx + 128) - greatest(x0, tx)) * (least(y0 + h, ty + 128) - greatest(y0, ty)))::BIGINT AS area FROM t JOIN f ON x0 < tx + 128 AND x0 + w > tx AND y0 < ty + 128 AND y0 + h > ty GROUP BY tx, ty""")
def tile_sources(spark, d):
    """The frames that each output tile reads, and how much of the tile they cover: each frame goes to the tiles that it touches."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    f = table(spark, d, "customer").select((k * 37 % 900).alias("x0"), (k * 53 % 700).alias("y0"), (40 + n * 8).alias("w"), (30 + n * 6).alias("h"))
    f = f.selectExpr("*", "explode(sequence(x0 div 128, least((x0 + w - 1) div 128, 8L))) AS i").selectExpr("*", "explode(sequence(y0 div 128, least((y0 + h - 1) div 128, 7L))) AS j").selectExpr("*", "i * 128 AS tx", "j * 128 AS ty")
    area = F.expr("(least(x0 + w, tx + 128) - greatest(x0, tx)) * (least(y0 + h, ty + 128) - greatest(y0, ty))")
    return f.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("frames"), F.sum(area).alias("area"))


# --- colour pattern and headers -------------------------------------------------------------------------------------------

_PATTERN = ("R", "G", "G", "B")


@query(f"WITH {SAMPLES}, c AS (SELECT q, ['R', 'G', 'G', 'B'][(y % 2) * 2 + x % 2 + 1] AS colour, ['R', 'G', 'G', 'B'][((y + 1) % 2) * 2 + (x + 1) % 2 + 1] AS shifted FROM samples) SELECT colour, shifted, count(*) AS n, sum(q)::BIGINT AS q FROM c GROUP BY colour, shifted")
def pattern_colours(spark, d):
    """The colour of a site by a repeating 2 by 2 pattern, and by the same pattern with its origin moved by one pixel either way."""
    at = lambda x, y: F.element_at(F.array(*map(F.lit, _PATTERN)), (y % 2 * 2 + x % 2 + 1).cast("int"))
    x, y = F.col("x"), F.col("y")
    c = samples(spark, d).select("q", at(x, y).alias("colour"), at(x + 1, y + 1).alias("shifted"))
    return c.groupBy("colour", "shifted").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query(f"WITH {SEQ} SELECT event_id, coalesce(nullif(trim(props->>'$.filter'), ''), nullif(trim(props->>'$.filter1'), ''), nullif(trim(props->>'$.k'), '')) AS filter FROM seq")
def header_synonyms(spark, d):
    """The first synonym of a header key that has a value other than blanks."""
    value = lambda key: F.get_json_object("props", f"$.{key}")
    return seq(spark, d).select("event_id", F.coalesce(*[F.when(F.trim(value(k)) != "", F.trim(value(k))) for k in ("filter", "filter1", "k")]).alias("filter"))


@query("""WITH e AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages)
  SELECT page_id, CASE WHEN ext IN ('fits', 'fit', 'fts') THEN 'fits' WHEN ext IN ('xisf') THEN 'xisf' WHEN ext IN ('html', 'htm', 'php', 'com', 'org', 'net') THEN 'page' END AS format FROM e""")
def format_by_ending(spark, d):
    path = F.regexp_replace("url", "[?#].*$", "")
    page = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin("html", "htm", "php", "com", "org", "net")
    kind = F.coalesce(lists.format_of(path), F.when(page, "page"))
    return table(spark, d, "pages").select("page_id", kind.alias("format"))


# --- matching -------------------------------------------------------------------------------------------------------------


@query("SELECT label AS frame, label * 37 % 360 AS degrees, round(1 + label / 100, 2) AS scale FROM embeddings WHERE label > 0 GROUP BY label")
def triangle_match(spark, d):
    """Frame 0's stars, turned, scaled and moved anew for each other frame, with a star in seven lost and a stray one for it: the match
    finds the way back to frame 0."""
    s = stars(spark, d).where("frame = 0").select("id", (F.col("x") * 40 + F.pmod(F.col("id") * 7919, F.lit(997))).alias("x"), (F.col("y") * 40 + F.pmod(F.col("id") * 6101, F.lit(991))).alias("y"), "flux")
    t = geo.inverse(geo.similarity(F.radians(F.col("frame") * 37 % 360), 1 + F.col("frame") / 100, F.col("frame") * 11.0, F.col("frame") * -5.0))
    moved = s.withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("t", t)
    x, y = geo.apply(F.col("t"), F.col("x"), F.col("y"))
    stray = F.pmod(F.col("id") + F.col("frame"), F.lit(7)) == 0
    moved = moved.select("frame", "id", F.when(stray, y * 0.7).otherwise(x).alias("x"), F.when(stray, x * 1.3).otherwise(y).alias("y"), "flux")
    m = asterism.match(s.withColumn("frame", F.lit(0)), moved)
    turn = F.floor(F.degrees(geo.rotation(F.col("transform"))) + 0.5)
    return m.select("frame", F.pmod(turn, F.lit(360)).cast("int").alias("degrees"), F.round(geo.scale(F.col("transform")), 2).alias("scale"))


@query("""WITH t AS (SELECT c_custkey AS id, c_custkey % 25 AS k, c_nationkey % 5 AS r FROM customer)
  SELECT id, CASE k % 4 WHEN 0 THEN 'translation' WHEN 1 THEN 'euclidean' WHEN 2 THEN CASE WHEN r = 0 THEN 'euclidean' ELSE 'similarity' END ELSE 'affine' END AS model FROM t""")
def fitted_model(spark, d):
    """Points moved by each customer's transform, up to a hundredth of a pixel off: the fit finds the kind of transform."""
    p = _transforms(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    p = p.select("id", "t", ((F.col("id") * 37 + F.col("k") * 211) % 640).cast("double").alias("x"), ((F.col("id") * 53 + F.col("k") * 307) % 480).cast("double").alias("y"), ((F.col("k") % 3 - 1) / 100).alias("off"))
    u, v = geo.apply(F.col("t"), F.col("x"), F.col("y"))
    pairs = p.select("id", "x", "y", (u + F.col("off")).alias("u"), (v - F.col("off")).alias("v"))
    return asterism.simplest_fit(pairs, ["id"], 0.02).select("id", "model")
