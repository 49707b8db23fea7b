"""Queries of survey flags, confidences, noise models and tile quality; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE, clamp, micro
from ..operators import noise, rank, survey
from ..sources.tables import samples, table, tiles
from .catalogue import SAMPLES, TILES, M, query

_five = lambda c: F.floor(c * 100000 + 0.5) / 100000
_FIVE = lambda x: f"floor(({x}) * 100000 + 0.5) / 100000"

# A frame is an order: its items are its stars. One item is too few to measure, some orders can't be read.
_SURVEYED = f"""l AS (SELECT l_orderkey, count(*) AS c, sum(floor(l_discount * 100 + 0.5)::BIGINT) AS e FROM lineitem GROUP BY l_orderkey),
  frame AS (SELECT o_orderkey AS frame_id, o_orderpriority AS grp, CASE WHEN o_orderkey % 97 <> 0 THEN {M('o_totalprice')} END AS sharpness, CASE WHEN c > 1 THEN c * 5 END AS stars, CASE WHEN c > 1 THEN {M('e / c / 10')} END AS eccentricity,
    CASE WHEN o_orderkey % 97 = 0 THEN 'truncated' END AS error FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)"""


def _surveyed(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("l_discount") * 100 + 0.5)).alias("e"))
    o = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    bad, many = F.col("o_orderkey") % 97 == 0, F.col("c") > 1
    return o.select(
        F.col("o_orderkey").alias("frame_id"), F.col("o_orderpriority").alias("grp"), F.when(~bad, micro(F.col("o_totalprice"))).alias("sharpness"), F.when(many, F.col("c") * 5).alias("stars"),
        F.when(many, micro(F.col("e") / F.col("c") / 10)).alias("eccentricity"), F.when(bad, "truncated").alias("error"),
    )


@query(f"""WITH {_SURVEYED}, z AS (SELECT grp, count(*) AS n, count(stars) AS st, count(stars) * 4 >= count(*) * 3 AS by_stars FROM frame WHERE error IS NULL GROUP BY grp),
  m AS (SELECT grp, median(sharpness) AS med, count(sharpness) AS k FROM frame JOIN z USING (grp) WHERE error IS NULL AND (stars IS NOT NULL) = by_stars GROUP BY grp),
  t AS (SELECT grp, median(eccentricity) AS ecc, median(stars) AS cnt FROM frame WHERE error IS NULL AND stars IS NOT NULL GROUP BY grp),
  j AS (SELECT f.*, z.n, by_stars, ecc, cnt, CASE WHEN error IS NULL AND (stars IS NOT NULL) = by_stars AND med > 0 THEN sharpness / med END AS rel, error IS NULL AND z.n >= 5 AND coalesce(k, 0) > 0 AS judged,
    eccentricity IS NOT NULL AND stars IS NOT NULL AS seen FROM frame f LEFT JOIN z USING (grp) LEFT JOIN m USING (grp) LEFT JOIN t USING (grp))
  SELECT frame_id, {M('rel')} AS relative, array_to_string(list_filter([CASE WHEN judged AND by_stars AND seen AND eccentricity > greatest(ecc + 0.15, 0.35) THEN 'elongated' END,
    CASE WHEN judged AND by_stars AND seen AND cnt >= 10 AND stars < 0.5 * cnt THEN 'few-stars' END, CASE WHEN judged AND by_stars AND NOT seen THEN 'no-stars' END, CASE WHEN judged AND rel < 0.75 THEN 'soft' END,
    CASE WHEN error IS NOT NULL THEN 'unreadable' END], lambda x: x IS NOT NULL), ',') AS flags FROM j""")
def survey_flags(spark, d):
    return survey.flag_frames(_surveyed(spark, d), "grp").select("frame_id", micro(F.col("relative")).alias("relative"), F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {_SURVEYED}, z AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE eccentricity > 0) AS m, max(eccentricity) FILTER (WHERE eccentricity > 0) AS worst, median(eccentricity) FILTER (WHERE eccentricity > 0) AS med FROM frame GROUP BY grp)
  SELECT frame_id, m * 4 >= n * 3 AND m >= 3 AS by_stars, {M('CASE WHEN NOT (m * 4 >= n * 3 AND m >= 3) THEN sharpness WHEN eccentricity > 0 THEN greatest(med, 1e-6) / eccentricity ELSE 0.9 * greatest(med, 1e-6) / greatest(worst, 1e-6) END')} AS sharpness FROM frame JOIN z USING (grp)""")
def star_sharpness(spark, d):
    f = _surveyed(spark, d).withColumnRenamed("eccentricity", "hfd")
    return survey.star_sharpness(f, "grp").select("frame_id", "by_stars", micro(F.col("sharpness")).alias("sharpness"))


@query(f"""WITH r AS (SELECT l_orderkey AS frame_id, count(*) AS probes, count(*) FILTER (WHERE l_quantity > 5) AS measured, count(*) FILTER (WHERE l_quantity > 12) AS inliers, {M('sum(floor(l_discount * 100 + 0.5)::BIGINT) / count(*)')} AS residual, {M('1 - sum(floor(l_tax * 100 + 0.5)::BIGINT) / count(*) / 100')} AS overlap FROM lineitem GROUP BY l_orderkey),
  q AS (SELECT r.*, o_orderpriority AS grp FROM r JOIN orders ON o_orderkey = frame_id), m AS (SELECT grp, median(residual) AS med, count(*) AS n FROM q GROUP BY grp HAVING count(*) >= 4),
  s AS (SELECT grp, any_value(med) AS med, greatest(median(abs(residual - med)) * {MAD_SCALE}, 0.15 * any_value(med), 1e-4) AS spread FROM q JOIN m USING (grp) GROUP BY grp)
  SELECT frame_id, {M('CASE WHEN spread IS NOT NULL THEN least(greatest(CASE WHEN measured > 0 THEN least(inliers / measured, 1.0) * least(measured / 20, 1.0) ELSE 0 END / (1 + greatest((residual - med) / (3 * spread), 0.0)) * overlap, 0.0), 1.0) END')} AS confidence FROM q LEFT JOIN s USING (grp)""")
def normalised_confidence(spark, d):
    over = lambda n: F.count_if(F.col("l_quantity") > n)
    cents = lambda c: F.sum(F.floor(F.col(c) * 100 + 0.5))
    n = F.count(F.lit(1))
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id")).agg(n.alias("probes"), over(5).alias("measured"), over(12).alias("inliers"), micro(cents("l_discount") / n).alias("residual"), micro(1 - cents("l_tax") / n / 100).alias("overlap"))
    q = r.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderpriority").alias("grp")), "frame_id")
    return survey.normalised_confidence(q, "grp").select("frame_id", micro(F.col("confidence")).alias("confidence"))


# --- noise models: a block is a tile -----------------------------------------------------------------------------------


def _envelope(blocks: str, group: str, percentile: float, name: str) -> str:
    """CTEs from a table (group, m, v) to one of the given name (group, alpha, beta, blocks)."""
    fit = lambda i, w: f"""{name}f{i} AS (SELECT {group}, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS alpha, (sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s AS beta FROM (
      SELECT {group}, sum({w}) AS s, sum({w} * x) AS sx, sum({w} * y) AS sy, sum({w} * x * x) AS sxx, sum({w} * x * y) AS sxy FROM {name}w{i} GROUP BY {group}) WHERE abs(s * sxx - sx * sx) >= 1e-18)"""  # noqa: E731
    weigh = lambda i: f"""{name}w{i} AS (SELECT p.{group}, x, y, w, CASE WHEN y - (alpha * x + beta) > 0 THEN w / (1 + 4 * ((y - (alpha * x + beta)) / greatest(abs(alpha * x + beta), 1e-9))) ELSE w END AS own FROM {name}p p JOIN {name}f{i - 1} USING ({group}))"""
    return f"""{name}r AS (SELECT {group}, min(m) AS lo, max(m) AS hi, count(*) AS blocks FROM {blocks} GROUP BY {group} HAVING count(*) >= 32 AND max(m) > min(m)),
      {name}b AS (SELECT {group}, floor((m - lo) / (hi - lo) * 23 + 0.5) AS bin, list_sort(list(v)) AS v, count(*)::DOUBLE AS w, any_value(lo) AS lo, any_value(hi) AS hi FROM {blocks} JOIN {name}r USING ({group}) GROUP BY 1, 2 HAVING count(*) >= 8),
      {name}p AS (SELECT {group}, lo + (hi - lo) * (bin / 23) AS x, v[floor((w - 1) * {percentile} + 0.5)::INT + 1] AS y, w FROM {name}b WHERE {group} IN (SELECT {group} FROM {name}b GROUP BY {group} HAVING count(*) >= 3)),
      {name}w1 AS (SELECT *, w AS own FROM {name}p), {fit(1, 'w')}, {weigh(2)}, {fit(2, 'own')}, {weigh(3)}, {fit(3, 'own')},
      {name} AS (SELECT {group}, greatest(alpha, 0.0) AS alpha, greatest(beta, 1e-10) AS beta, blocks FROM {name}f3 JOIN {name}r USING ({group}))"""


_SPATIAL_TAIL = f"""u AS (SELECT vec_id, label, x - 3.5 AS u, y - 3.5 AS w, v + 0.5 AS v FROM sites), mo AS (SELECT vec_id, label, sum(v) AS sv, sum(u * v) AS su, sum(w * v) AS sw, sum(v * v) AS svv FROM u GROUP BY vec_id, label),
  blk AS (SELECT label % 2 AS g, {M('sv / 64')} AS m, {M('greatest(svv - sv * sv / 64 - (su * su + sw * sw) / 336, 0) / 61')} AS v FROM mo), sb AS (SELECT * FROM blk WHERE m > 0 AND m < 0.95), {_envelope('sb', 'g', 0.15, 'sp')}"""
_SPATIAL = TILES + ", " + _SPATIAL_TAIL
_GATE = 0.13  # of the mean gradient within a tile; these tiles are rough
_TEMPORAL = TILES + f""", nx AS (SELECT vec_id, label, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nid FROM (SELECT DISTINCT vec_id, label FROM embeddings)),
  pr AS (SELECT a.vec_id, a.label % 2 AS g, a.v AS va, b.v AS vb, CASE WHEN a.x > 0 THEN abs(a.v - lag(a.v) OVER (PARTITION BY a.vec_id ORDER BY a.pos)) END AS gr FROM sites a JOIN nx ON nx.vec_id = a.vec_id JOIN sites b ON b.vec_id = nid AND b.pos = a.pos),
  md AS (SELECT vec_id, any_value(g) AS g, median(va - vb) AS med, {M('avg((va + vb) / 2) + 0.5')} AS m, {M('sum(gr) / 64')} AS gr FROM pr GROUP BY vec_id), ma AS (SELECT pr.vec_id, median(abs(va - vb - med)) AS mad FROM pr JOIN md USING (vec_id) GROUP BY pr.vec_id),
  tb AS (SELECT g, m, {M(f'0.5 * {MAD_SCALE} * mad * {MAD_SCALE} * mad')} AS v FROM md JOIN ma USING (vec_id) WHERE gr <= {_GATE} AND m > 0 AND m < 0.95), {_envelope('tb', 'g', 0.5, 'te')}"""


def _spatial_blocks(spark, d):
    t = tiles(spark, d).select("label", F.transform("embedding", lambda x: x.cast("double") + 0.5).alias("e")).select("label", plane.detrended(F.col("e"), 8).alias("s"))
    return t.select((F.col("label") % 2).alias("g"), micro(F.col("s.mean")).alias("m"), micro(F.col("s.var")).alias("v")).where("m > 0 AND m < 0.95")


def _temporal_blocks(spark, d):
    t = tiles(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    t = t.withColumn("b", F.lead("a").over(Window.partitionBy("label").orderBy("vec_id"))).where("b IS NOT NULL")
    inner = F.transform("a", lambda v, i: F.when(i % 8 > 0, F.abs(v - F.element_at("a", i))).otherwise(0.0))
    both = F.zip_with("a", "b", lambda x, y: (x + y) / 2)
    s = t.select((F.col("label") % 2).alias("g"), micro(plane.mean(both) + 0.5).alias("m"), micro(plane.total(inner) / 64).alias("gr"), plane.mad_sigma(plane.minus(F.col("a"), F.col("b")), MAD_SCALE).alias("sd"))
    return s.where(f"gr <= {_GATE} AND m > 0 AND m < 0.95").select("g", "m", micro(0.5 * F.col("sd") * F.col("sd")).alias("v"))


@query(f"WITH {_SPATIAL} SELECT g, {_FIVE('alpha')} AS alpha, {_FIVE('beta')} AS beta, blocks FROM sp")
def noise_from_blocks(spark, d):
    return noise.lower_envelope(_spatial_blocks(spark, d), ["g"], "m", "v", 0.15).select("g", _five(F.col("alpha")).alias("alpha"), _five(F.col("beta")).alias("beta"), "blocks")


@query(f"WITH {_TEMPORAL} SELECT g, {_FIVE('alpha')} AS alpha, {_FIVE('beta')} AS beta, blocks FROM te")
def noise_from_differences(spark, d):
    return noise.lower_envelope(_temporal_blocks(spark, d), ["g"], "m", "v", 0.5).select("g", _five(F.col("alpha")).alias("alpha"), _five(F.col("beta")).alias("beta"), "blocks")


@query(f"""WITH {_TEMPORAL}, {_SPATIAL_TAIL}, gs AS (SELECT DISTINCT label % 4 AS g FROM embeddings)
  SELECT gs.g, CASE WHEN te.g IS NOT NULL THEN 'temporal' WHEN sp.g IS NOT NULL THEN 'spatial' ELSE 'nominal' END AS source,
    {_FIVE('CASE WHEN te.g IS NOT NULL THEN te.alpha WHEN sp.g IS NOT NULL THEN sp.alpha ELSE 1 / (50 * greatest(1 / 4.0, 1e-3)) END')} AS alpha, {_FIVE('CASE WHEN te.g IS NOT NULL THEN te.beta WHEN sp.g IS NOT NULL THEN sp.beta ELSE (2 * sqrt(4.0) / 50) * (2 * sqrt(4.0) / 50) END')} AS beta
  FROM gs LEFT JOIN te ON te.g = gs.g AND gs.g <> 1 LEFT JOIN sp ON sp.g = gs.g""")
def noise_model(spark, d):
    groups = tiles(spark, d).select((F.col("label") % 4).alias("g"))
    by_time = noise.lower_envelope(_temporal_blocks(spark, d).where("g <> 1"), ["g"], "m", "v", 0.5)  # group 1 has single frames
    by_place = noise.lower_envelope(_spatial_blocks(spark, d), ["g"], "m", "v", 0.15)
    m = noise.first_model(groups, ["g"], [("temporal", by_time), ("spatial", by_place)], noise.nominal(F.lit(400.0), F.lit(50.0)))
    return m.select("g", "source", _five(F.col("alpha")).alias("alpha"), _five(F.col("beta")).alias("beta"))


@query(f"""WITH {SAMPLES}, v AS (SELECT ch, q, floor(1 / greatest(1 / (50 * greatest(1 / greatest((100 + 4 * w) / 100, 1.0), 1e-3)) * (q / 50) + (2 * sqrt(greatest((100 + 4 * w) / 100, 1.0)) / 50) * (2 * sqrt(greatest((100 + 4 * w) / 100, 1.0)) / 50), 1e-12) * 1000 + 0.5)::BIGINT AS k FROM samples)
  SELECT ch, sum(k)::BIGINT AS weight, {M('sum(k * q) / sum(k) / 50')} AS mean FROM v GROUP BY ch""")
def noise_weighted_mean(spark, d):
    """Inverse variances by the nominal model, an ISO for each sample, in whole thousandths."""
    alpha, beta = noise.nominal((100 + 4 * F.col("w")).cast("double"), F.lit(50.0))
    s = samples(spark, d).select("ch", "q", F.floor(1 / noise.variance(F.col("q") / 50, alpha, beta) * 1000 + 0.5).alias("k"))
    return s.groupBy("ch").agg(F.sum("k").alias("weight"), micro(F.sum(F.col("k") * F.col("q")) / F.sum("k") / 50).alias("mean"))


# --- tile quality -------------------------------------------------------------------------------------------------------

_BLUR = lambda src, dst: f"""{dst}h AS (SELECT vec_id, pos, x, y, (coalesce(lag(v) OVER r, v) + 2 * v + coalesce(lead(v) OVER r, v)) / 4 AS v FROM {src} WINDOW r AS (PARTITION BY vec_id, y ORDER BY x)),
  {dst} AS (SELECT vec_id, pos, x, y, (coalesce(lag(v) OVER c, v) + 2 * v + coalesce(lead(v) OVER c, v)) / 4 AS v FROM {dst}h WINDOW c AS (PARTITION BY vec_id, x ORDER BY y))"""  # noqa: E731
_ENERGY = lambda src, dst: f"""{dst}g AS (SELECT vec_id, lead(v) OVER r - lag(v) OVER r AS gx, lead(v) OVER c - lag(v) OVER c AS gy FROM {src} WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y)),
  {dst} AS (SELECT vec_id, sum(gx * gx + gy * gy) / 36 AS e FROM {dst}g WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY vec_id)"""  # noqa: E731
_QUALITY = TILES + f", {_BLUR('sites', 'b1')}, {_BLUR('b1', 'b2')}, {_ENERGY('sites', 'e0')}, {_ENERGY('b2', 'e1')}"


@query(f"""WITH {_QUALITY}, k AS (SELECT s.vec_id, avg((s.v - b1.v) * (s.v - b1.v)) AS lap, sqrt(avg((s.v - b2.v) * (s.v - b2.v))) AS contrast, avg(s.v) AS level, avg(CASE WHEN s.v >= 0.2 THEN 1 ELSE 0 END) AS sat FROM sites s JOIN b1 USING (vec_id, pos) JOIN b2 USING (vec_id, pos) GROUP BY s.vec_id),
  f AS (SELECT k.*, e0.e AS e0, least(greatest(e1.e / e0.e, 1e-6), 0.999999) AS r FROM k JOIN e0 USING (vec_id) JOIN e1 USING (vec_id))
  SELECT vec_id, {M('e0')} AS sharpness, {M('lap')} AS laplacian, {M('contrast')} AS contrast, {M('sat')} AS saturation, {_FIVE('CASE WHEN e0 <= 1e-20 THEN 10 ELSE sqrt(r / (1 - r)) END')} AS blur, {M('level')} AS level, {M('e0 * (1 - least(sat, 1)) * 0.8')} AS composite FROM f""")
def tile_quality(spark, d):
    """Every measure of a tile in one pass over its array."""
    t = tiles(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    e = F.col("e")
    q = t.select(
        "vec_id", plane.tenengrad(e, 8).alias("s"), plane.multiscale_laplacian(e, 8, 8).alias("l"), plane.local_contrast(e, 8).alias("c"), (F.size(F.filter(e, lambda v: v >= 0.2)) / 64).alias("sat"),
        plane.estimated_blur(e, 8).alias("b"), plane.mean(e).alias("m"),
    )
    composite = F.col("s") * (1 - F.least("sat", F.lit(1.0))) * F.greatest(F.lit(0.8), F.lit(0.05))
    return q.select("vec_id", micro(F.col("s")).alias("sharpness"), micro(F.col("l")).alias("laplacian"), micro(F.col("c")).alias("contrast"), micro(F.col("sat")).alias("saturation"), _five(F.col("b")).alias("blur"), micro(F.col("m")).alias("level"), micro(composite).alias("composite"))


# --- stretches ----------------------------------------------------------------------------------------------------------

# Where the background and the highlights go, and how many deviations below the background black begins.
TARGET, HIGHLIGHT, CLIP = 0.25, 0.65, 2.8


def _midtone_for(x):
    """The midtone that sends x to TARGET."""
    den = 2 * TARGET * x - TARGET - x
    return F.when(F.abs(den) < 1e-9, 0.5).otherwise(clamp((x * (TARGET - 1)) / den, 1e-4, 0.9999))


def _stretched(x, m):
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def _balance(median, shadows):
    return _midtone_for(clamp((median - shadows) / F.greatest(1 - shadows, F.lit(1e-6)), 1e-6, 1 - 1e-6))


_X0 = "least(greatest((med - sh) / greatest(1 - sh, 1e-6), 1e-6), 1 - 1e-6)"
_MID = f"CASE WHEN abs(2 * {TARGET} * {_X0} - {TARGET} - {_X0}) < 1e-9 THEN 0.5 ELSE least(greatest({_X0} * ({TARGET} - 1) / (2 * {TARGET} * {_X0} - {TARGET} - {_X0}), 1e-4), 0.9999) END"
_LEVELS = TILES + f", w AS (SELECT vec_id, least(greatest(v + 0.5, 0), 1) AS v FROM sites), md AS (SELECT vec_id, {M('median(v)')} AS med, {M('max(v)')} AS hi FROM w GROUP BY vec_id), lv AS (SELECT vec_id, any_value(med) AS med, greatest(any_value(hi), any_value(med) + 1e-4) AS hi, {M('median(abs(v - med))')} AS mad FROM w JOIN md USING (vec_id) GROUP BY vec_id)"


def _levels(spark, d):
    t = tiles(spark, d).select("vec_id", F.transform("embedding", lambda x: clamp(x.cast("double") + 0.5, 0.0, 1.0)).alias("e"))
    t = t.select("vec_id", "e", micro(plane.median(F.col("e"))).alias("med"), micro(F.array_max("e")).alias("top"))
    return t.select("vec_id", "med", F.greatest("top", F.col("med") + 1e-4).alias("hi"), micro(plane.median(F.transform("e", lambda v: F.abs(v - F.col("med"))))).alias("mad"))


@query(f"WITH {_LEVELS}, s AS (SELECT vec_id, med, least(greatest(med - {CLIP} * mad, 0), 0.999) AS sh FROM lv) SELECT vec_id, {M('sh')} AS shadows, {_FIVE(_MID)} AS midtone FROM s")
def stretch_for_background(spark, d):
    s = _levels(spark, d).withColumn("sh", clamp(F.col("med") - CLIP * F.col("mad"), 0.0, 0.999))
    return s.select("vec_id", micro(F.col("sh")).alias("shadows"), _five(_balance(F.col("med"), F.col("sh"))).alias("midtone"))


_AT_HIGH = f"""CASE WHEN (hi - sh) / greatest(1 - sh, 1e-6) >= 1 THEN 1.0 ELSE (mid - 1) * ((hi - sh) / greatest(1 - sh, 1e-6)) / ((2 * mid - 1) * ((hi - sh) / greatest(1 - sh, 1e-6)) - mid) END"""


@query(f"""WITH RECURSIVE {_LEVELS}, go AS (SELECT vec_id, med, hi, 0 AS step, 0.0::DOUBLE AS a, greatest(med * 0.999, 0.0)::DOUBLE AS b FROM lv
  UNION ALL SELECT vec_id, med, hi, step + 1, CASE WHEN got > {HIGHLIGHT} THEN a ELSE sh END, CASE WHEN got > {HIGHLIGHT} THEN sh ELSE b END FROM (SELECT *, {_AT_HIGH} AS got FROM (SELECT *, {_MID} AS mid FROM (SELECT *, (a + b) / 2 AS sh FROM go WHERE step < 48)))),
  e AS (SELECT vec_id, med, (a + b) / 2 AS sh FROM go WHERE step = 48) SELECT vec_id, {_FIVE('sh')} AS shadows, {_FIVE(_MID)} AS midtone FROM e""")
def stretch_for_anchors(spark, d):
    """48 halvings of the interval of the shadows, so that the highlight lands at its target."""
    def halve(s, _):
        sh = (s["a"] + s["b"]) / 2
        mid = _balance(F.col("med"), sh)
        high = _stretched((F.col("hi") - sh) / F.greatest(1 - sh, F.lit(1e-6)), mid) > HIGHLIGHT
        return F.struct(F.when(high, s["a"]).otherwise(sh).alias("a"), F.when(high, sh).otherwise(s["b"]).alias("b"))

    start = F.struct(F.lit(0.0).alias("a"), F.greatest(F.col("med") * 0.999, F.lit(0.0)).alias("b"))
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, halve)
    s = _levels(spark, d).select("vec_id", "med", ends.alias("s")).select("vec_id", "med", ((F.col("s.a") + F.col("s.b")) / 2).alias("sh"))
    return s.select("vec_id", _five(F.col("sh")).alias("shadows"), _five(_balance(F.col("med"), F.col("sh"))).alias("midtone"))


@query("""WITH f AS (SELECT p_partkey, p_size * 90 + 200 AS w, p_size * 60 + 160 AS h FROM part), g AS (SELECT *, w // 10 AS mx, h // 10 AS my, (w - 2 * (w // 10)) // 32 AS nx, (h - 2 * (h // 10)) // 32 AS ny FROM f),
  k AS (SELECT *, nx * ny AS av, least(40, nx * ny) AS c FROM g WHERE nx * ny > 0), c AS (SELECT *, unnest(range(0, c)) AS i FROM k), t AS (SELECT *, least((2 * i + 1) * av // (2 * c), av - 1) AS cell FROM c)
  SELECT p_partkey, i, mx + (cell % nx) * 32 AS x, my + (cell // nx) * 32 AS y FROM t""")
def tile_positions(spark, d):
    """Up to 40 whole tiles spread over the central four fifths of a frame, wherever its content is."""
    size = F.col("p_size").cast("long")
    f = table(spark, d, "part").select("p_partkey", (size * 90 + 200).alias("w"), (size * 60 + 160).alias("h"))
    f = f.selectExpr("*", "w div 10 AS mx", "h div 10 AS my", "(w - 2 * (w div 10)) div 32 AS nx", "(h - 2 * (h div 10)) div 32 AS ny").where("nx * ny > 0")
    f = f.selectExpr("*", "nx * ny AS av", "least(40L, nx * ny) AS c").selectExpr("*", "explode(sequence(0L, c - 1)) AS i")
    f = f.selectExpr("*", "least((2 * i + 1) * av div (2 * c), av - 1) AS cell")
    return f.selectExpr("p_partkey", "i", "mx + (cell % nx) * 32 AS x", "my + (cell div nx) * 32 AS y")


@query(f"""WITH {_LEVELS}, s AS (SELECT vec_id, med, mad, least(greatest(med - {CLIP} * mad, 0), 0.999) AS sh FROM lv WHERE mad > 0), t AS (SELECT *, {_MID} AS mid FROM s),
  a AS (SELECT *, least(greatest((med - mad - sh) / greatest(1 - sh, 1e-6), 0), 1) AS lo, least(greatest((med + mad - sh) / greatest(1 - sh, 1e-6), 0), 1) AS hi FROM t),
  g AS (SELECT vec_id, sh, mid, (CASE WHEN hi <= 0 THEN 0 WHEN hi >= 1 THEN 1 ELSE (mid - 1) * hi / ((2 * mid - 1) * hi - mid) END - CASE WHEN lo <= 0 THEN 0 WHEN lo >= 1 THEN 1 ELSE (mid - 1) * lo / ((2 * mid - 1) * lo - mid) END) / greatest(2 * mad, 1e-9) AS gain FROM a)
  SELECT vec_id, {_FIVE('gain')} AS gain, floor(gain * 100000 + 0.5) / 100000 >= 1.2 AS chosen FROM g""")
def stretch_choice(spark, d):
    """Whether a stretch would widen the spread about the background enough to be worth applying; these tiles are bright, so 1.2 is."""
    s = _levels(spark, d).where("mad > 0").withColumn("sh", clamp(F.col("med") - CLIP * F.col("mad"), 0.0, 0.999))
    s = s.withColumn("mid", _balance(F.col("med"), F.col("sh")))
    at = lambda v: _stretched(clamp((v - F.col("sh")) / F.greatest(1 - F.col("sh"), F.lit(1e-6)), 0.0, 1.0), F.col("mid"))
    gain = _five((at(F.col("med") + F.col("mad")) - at(F.col("med") - F.col("mad"))) / F.greatest(2 * F.col("mad"), F.lit(1e-9)))
    return s.select("vec_id", gain.alias("gain"), (gain >= 1.2).alias("chosen"))


@query("""WITH RECURSIVE v AS (SELECT vec_id, label, floor((abs(embedding[4]::DOUBLE) * 8 + 1) * 1000 + 0.5)::BIGINT AS w FROM embeddings), c AS (SELECT label, min(w) AS rep FROM v GROUP BY label
  UNION ALL SELECT c.label, (SELECT min(w) FROM v WHERE v.label = c.label AND v.w * 10 > c.rep * 11) FROM c WHERE (SELECT min(w) FROM v WHERE v.label = c.label AND v.w * 10 > c.rep * 11) IS NOT NULL)
  SELECT vec_id, v.label, (SELECT max(rep) FROM c WHERE c.label = v.label AND rep <= w) / 1000 AS cohort FROM v""")
def width_cohorts(spark, d):
    """Frames of like width: a cohort begins where a width is over 1.1 times the least of the cohort before. Widths are whole thousandths,
    so a group has as many distinct ones as their range allows, however many frames it has."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.floor((F.abs(F.element_at("embedding", 4).cast("double")) * 8 + 1) * 1000 + 0.5).alias("w"))
    sets = v.groupBy("label").agg(F.sort_array(F.collect_set("w")).alias("all"))
    first = lambda reps, w: F.size(reps) == 0
    begins = lambda reps, w: first(reps, w) | (w * 10 > F.element_at(reps, -1) * 11)
    reps = F.aggregate("all", F.array().cast("array<bigint>"), lambda reps, w: F.when(begins(reps, w), F.concat(reps, F.array(w))).otherwise(reps))
    kept = sets.select("label", reps.alias("reps"))
    return v.join(kept, "label").select("vec_id", "label", (F.array_max(F.filter("reps", lambda r: r <= F.col("w"))) / 1000).alias("cohort"))
