"""Queries of robust fits, noise bins, quotas and blends; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE, micro
from ..operators import robust_fit, selection, sequence
from ..sources.tables import frames, samples, seq, stars, table
from .catalogue import _NEAR, FRAMES, NUM, SAMPLES, SEQ, STARS, TILES, M, _near, _planes, query

_FOUR = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"
_four = lambda c: F.floor(c * 10000 + 0.5) / 10000


def _irls(source: str, group: str, cut: float) -> str:
    """CTEs p (group, x, y) -> f3 (group, gain, shift, n): three passes of a reweighted line."""
    fit = lambda i, rows: f"""f{i} AS (SELECT {group}, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS gain, (sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s AS shift, n FROM (
      SELECT {group}, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, count(*) AS n FROM {rows} GROUP BY {group}) WHERE n >= 8 AND abs(s * sxx - sx * sx) > 1e-18)"""  # noqa: E731
    step = lambda i: f"""r{i} AS (SELECT p.{group}, x, y, y - gain * x - shift AS r FROM p JOIN f{i} USING ({group})), k{i} AS (SELECT {group}, greatest({cut} * {MAD_SCALE} * median(abs(r)), 1e-9) AS k FROM r{i} GROUP BY {group}),
      w{i} AS (SELECT r{i}.{group}, x, y, CASE WHEN abs(r) < k THEN (1 - r / k * r / k) * (1 - r / k * r / k) ELSE 0 END AS w FROM r{i} JOIN k{i} USING ({group}))"""  # noqa: E731
    return f"p AS ({source}), w0 AS (SELECT *, 1.0::DOUBLE AS w FROM p), {fit(1, 'w0')}, {step(1)}, {fit(2, 'w1')}, {step(2)}, {fit(3, 'w2')}"


_LINE = _irls("SELECT l_returnflag AS ch, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem", "ch", 4.0)


@query(f"WITH {_LINE} SELECT ch, {_FOUR('gain')} AS gain, {_FOUR('shift')} AS shift, n FROM f3")
def robust_line(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("ch"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return robust_fit.robust_line(li, ["ch"], "x", "y").select("ch", _four(F.col("gain")).alias("gain"), _four(F.col("shift")).alias("shift"), "n")


_CELLS = SAMPLES + ", c AS (SELECT x, y, ch, sum(q) / count(*) AS v FROM samples GROUP BY x, y, ch)"
_CHANNEL = _CELLS + ", " + _irls("SELECT c.ch, c.v AS x, r.v AS y FROM c JOIN c r ON r.ch = 'R' AND c.x = r.x AND c.y = r.y", "ch", 3.0)


@query(f"WITH {_CHANNEL} SELECT ch, CASE WHEN gain BETWEEN 0.02 AND 50 THEN {_FOUR('gain')} ELSE 1 END AS gain, CASE WHEN gain BETWEEN 0.02 AND 50 THEN {_FOUR('shift')} ELSE 0 END AS shift, n AS pairs FROM f3")
def channel_fit(spark, d):
    c = samples(spark, d).groupBy("x", "y", "ch").agg((F.sum("q") / F.count(F.lit(1))).alias("v"))
    pairs = c.join(c.where("ch = 'R'").select("x", "y", F.col("v").alias("r")), ["x", "y"])
    fit = robust_fit.robust_line(pairs, ["ch"], "v", "r", cut=3.0)
    ok = F.col("gain").between(0.02, 50)
    return fit.select("ch", F.when(ok, _four(F.col("gain"))).otherwise(1.0).alias("gain"), F.when(ok, _four(F.col("shift"))).otherwise(0.0).alias("shift"), F.col("n").alias("pairs"))


_MOM = """mom AS (SELECT x // 4 AS cx, y // 4 AS cy, ch, sum(w) AS sw, sum(w * u) AS sx, sum(w * v) AS sy, sum(w * u * u) AS sxx, sum(w * u * v) AS sxy, sum(w * v * v) AS syy, sum(w * q) AS sv, sum(w * u * q) AS sxv, sum(w * v * q) AS syv
  FROM (SELECT *, (x % 4 - 1.5::DOUBLE) / 2 AS u, (y % 4 - 1.5::DOUBLE) / 2 AS v FROM samples) GROUP BY ALL),
n1 AS (SELECT cx, cy, ch, sw, sx / sw AS mx, sy / sw AS my, sv / sw AS mv, sxx / sw - (sx / sw) * (sx / sw) AS xx, syy / sw - (sy / sw) * (sy / sw) AS yy, sxy / sw - (sx / sw) * (sy / sw) AS xy, sxv / sw - (sx / sw) * (sv / sw) AS xv, syv / sw - (sy / sw) * (sv / sw) AS yv FROM mom),
n2 AS (SELECT *, xx * yy - xy * xy AS det, CASE WHEN sw <= 0 THEN 'empty' WHEN sqrt(mx * mx + my * my) > 0.6 THEN 'far' WHEN xx * yy - xy * xy < 0.05 * (xx + yy) * (xx + yy) / 4 THEN 'line' ELSE 'plane' END AS how FROM n1)"""


@query(f"WITH {SAMPLES}, {_MOM} SELECT cx, cy, ch, how, {_FOUR('CASE WHEN how = ' + chr(39) + 'plane' + chr(39) + ' THEN mv - ((yy * xv - xy * yv) / det) * mx - ((xx * yv - xy * xv) / det) * my ELSE mv END')} AS value FROM n2")
def plane_fit_pixel(spark, d):
    s = samples(spark, d).withColumn("u", (F.col("x") % 4 - 1.5) / 2).withColumn("v", (F.col("y") % 4 - 1.5) / 2)
    w, u, v, q = F.col("w"), F.col("u"), F.col("v"), F.col("q")
    cell = lambda c: F.floor(F.col(c) / 4).cast("int").alias("c" + c)
    sums = {"sw": w, "sx": w * u, "sy": w * v, "sxx": w * u * u, "sxy": w * u * v, "syy": w * v * v, "sv": w * q, "sxv": w * u * q, "syv": w * v * q}
    m = s.groupBy(cell("x"), cell("y"), "ch").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    return robust_fit.plane_at_centre(m, ["cx", "cy", "ch"]).select("cx", "cy", "ch", "how", _four(F.col("value")).alias("value"))


@query(f"""WITH {NUM}, f AS (SELECT grp, n, cents, cents - lag(cents) OVER (PARTITION BY grp ORDER BY n) AS d FROM num), b AS (SELECT grp, (n - 1) // 64 AS bin, d FROM f WHERE d IS NOT NULL),
  m AS (SELECT grp, bin, median(d) AS m, count(*) AS c FROM b GROUP BY grp, bin), s AS (SELECT b.grp, b.bin, median(abs(d - m)) AS mad, any_value(c) AS c FROM b JOIN m USING (grp, bin) GROUP BY b.grp, b.bin)
  SELECT grp, bin, {M(f'mad / 100 * {MAD_SCALE} * (mad / 100 * {MAD_SCALE}) / 2')} AS half_var FROM s WHERE c >= 8""")
def temporal_difference(spark, d):
    n = sequence.numbered(seq(spark, d), ["grp"], "day", ["ts", "event_id"])
    before = n.select("grp", (F.col("n") + 1).alias("n"), F.col("cents").alias("p"))
    b = n.join(before, ["grp", "n"]).select("grp", F.floor((F.col("n") - 1) / 64).alias("bin"), (F.col("cents") - F.col("p")).alias("d"))
    m = b.groupBy("grp", "bin").agg(F.median("d").alias("m"), F.count(F.lit(1)).alias("c")).where("c >= 8")
    s = b.join(m, ["grp", "bin"]).groupBy("grp", "bin").agg(F.median(F.abs(F.col("d") - F.col("m"))).alias("mad"))
    sigma = F.col("mad") / 100 * MAD_SCALE
    return s.select("grp", "bin", micro(sigma * sigma / 2).alias("half_var"))


@query(f"""WITH {SEQ}, h AS (SELECT user_id, hour(ts) AS h, sum(cents) AS s, sum(cents * cents) AS ss, count(*) AS n FROM seq GROUP BY ALL HAVING count(*) >= 2), v AS (SELECT s / n / 100 AS m, (ss / n - (s / n) * (s / n)) / 10000 AS var FROM h),
  r AS (SELECT min(m) AS lo, max(m) AS hi FROM v), b AS (SELECT floor((m - lo) / (hi - lo) * 23 + 0.5)::BIGINT AS bin, {_FOUR('var')} AS var FROM v, r), l AS (SELECT bin, list_sort(list(var)) AS v, count(*) AS n FROM b GROUP BY bin HAVING count(*) >= 8)
  SELECT bin, n, v[floor((n - 1) * 0.1 + 0.5)::INT + 1] AS low FROM l""")
def lower_envelope_bins(spark, d):
    from ..operators import rank

    h = seq(spark, d).groupBy("user_id", F.hour("ts").alias("h")).agg(F.sum("cents").alias("s"), F.sum(F.col("cents") * F.col("cents")).alias("ss"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    mean = F.col("s") / F.col("n")
    v = h.select((mean / 100).alias("m"), ((F.col("ss") / F.col("n") - mean * mean) / 10000).alias("var"))
    r = v.agg(F.min("m").alias("lo"), F.max("m").alias("hi"))  # one row
    b = v.join(F.broadcast(r)).select(F.floor((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 23 + 0.5).alias("bin"), _four(F.col("var")).alias("var"))
    picked = rank.rank_select(b, ["bin"], "var", {"low": rank.round_rank(0.1), "n": F.lit(0)}).drop("n")
    return picked.join(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where("n >= 8"), "bin").select("bin", "n", "low")


_GRID = TILES + ", g AS (SELECT vec_id, label, x, y, (lead(v) OVER r - lag(v) OVER r) / 2 AS gx, (lead(v) OVER c - lag(v) OVER c) / 2 AS gy FROM sites WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))"


@query(f"WITH {_GRID} SELECT vec_id, (x // 4)::INTEGER AS cx, (y // 4)::INTEGER AS cy, {M('avg(gx * gx + gy * gy)')} AS s FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY vec_id, x // 4, y // 4")
def regional_quality(spark, d):
    g = _planes(spark, d).select("vec_id", F.posexplode(plane.energy(F.col("e"), 8)).alias("i", "g")).where("g IS NOT NULL")
    cell = [F.floor(F.col("i") % 8 / 4).cast("int").alias("cx"), F.floor(F.col("i") / 32).cast("int").alias("cy")]
    return g.groupBy("vec_id", *cell).agg(micro(F.avg("g") / 4).alias("s"))


_SIGMA = TILES + f", u AS (SELECT vec_id, label, x - 3.5 AS u, y - 3.5 AS w, v FROM sites), m AS (SELECT vec_id, label, sum(v) AS sv, sum(u * v) AS su, sum(w * v) AS sw, sum(v * v) AS svv FROM u GROUP BY vec_id, label), s AS (SELECT label, floor(sqrt(greatest(svv - sv * sv / 64 - (su * su + sw * sw) / 336, 0) / 61) * 1000000 + 0.5)::BIGINT AS k FROM m)"


@query(f"WITH {_SIGMA}, r AS (SELECT label, k, row_number() OVER (PARTITION BY label ORDER BY k) AS i, count(*) OVER (PARTITION BY label) AS n FROM s) SELECT label, {M('sum(k) / count(*) / 1000000')} AS noise FROM r WHERE i <= greatest(1, n // 10) GROUP BY label")
def flat_field_noise(spark, d):
    from ..operators import rank

    s = _planes(spark, d).select("label", F.floor(F.sqrt(plane.detrended(F.col("e"), 8)["var"]) * 1000000 + 0.5).alias("sigma"))
    return rank.lowest_share_mean(s, ["label"], "sigma").select("label", micro(F.col("total") / F.col("k") / 1000000).alias("noise"))


@query(f"""WITH {SAMPLES}, f AS (SELECT x // 16 AS cx, y // 16 AS cy, frame_id, x % 2 AS b, {M('sum(q) / count(*)')} AS s FROM samples GROUP BY ALL), k AS (SELECT cx, cy, greatest(1, count(*) // 50) AS keep FROM f GROUP BY cx, cy),
  r AS (SELECT f.*, keep, row_number() OVER (PARTITION BY f.cx, f.cy, b ORDER BY s DESC, frame_id) AS i FROM f JOIN k USING (cx, cy)), t AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY i > (keep + 1) // 2, s DESC, frame_id, b) AS j FROM r)
  SELECT cx, cy, frame_id, b FROM t WHERE j <= keep""")
def lucky_quota(spark, d):
    cell = lambda c: F.floor(F.col(c) / 16).cast("int").alias("c" + c)
    f = samples(spark, d).groupBy(cell("x"), cell("y"), "frame_id", (F.col("x") % 2).alias("b")).agg(micro(F.sum("q") / F.count(F.lit(1))).alias("s"))
    k = f.groupBy("cx", "cy").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 50)).alias("keep"))
    r = f.join(k, ["cx", "cy"]).withColumn("i", F.row_number().over(Window.partitionBy("cx", "cy", "b").orderBy(F.desc("s"), "frame_id")))
    j = F.row_number().over(Window.partitionBy("cx", "cy").orderBy(F.col("i") > F.floor((F.col("keep") + 1) / 2), F.desc("s"), "frame_id", "b"))
    return r.withColumn("j", j).where("j <= keep").select("cx", "cy", "frame_id", "b")


_RGB = SAMPLES + ", p AS (SELECT x, y, sum(q) FILTER (WHERE ch = 'R') / nullif(count(*) FILTER (WHERE ch = 'R'), 0) AS r, sum(q) FILTER (WHERE ch = 'A') / nullif(count(*) FILTER (WHERE ch = 'A'), 0) AS g, sum(q) FILTER (WHERE ch = 'N') / nullif(count(*) FILTER (WHERE ch = 'N'), 0) AS b FROM samples GROUP BY x, y)"


@query(f"WITH {_RGB}, l AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS lum FROM p WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL) SELECT x, y, {M('r * g / lum')} AS r, {M('g * g / lum')} AS g, {M('b * g / lum')} AS b FROM l WHERE lum > 0")
def luminance_replace(spark, d):
    p = samples(spark, d).where("ch IN ('R', 'A', 'N')").groupBy("x", "y").pivot("ch", ["R", "A", "N"]).agg(F.sum("q").alias("s"), F.count("q").alias("n"))
    p = p.where("R_n > 0 AND A_n > 0 AND N_n > 0").select("x", "y", *[(F.col(f"{c}_s") / F.col(f"{c}_n")).alias(n) for c, n in zip("RAN", "rgb")])
    lum = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    p = p.withColumn("lum", lum).where("lum > 0")
    return p.select("x", "y", *[micro(F.col(c) * F.col("g") / F.col("lum")).alias(c) for c in "rgb"])


@query(f"""WITH {_NEAR}, p AS (SELECT frame, a, b, row_number() OVER (PARTITION BY frame ORDER BY a, b) - 1 AS i, count(*) OVER (PARTITION BY frame) AS n FROM near),
  t AS (SELECT frame, k * (n - 1) // (least(n, 16) - 1) AS i FROM (SELECT frame, max(n) AS n FROM p GROUP BY frame), (SELECT unnest(range(0, 16)) AS k) WHERE n > 1 UNION SELECT frame, 0 FROM p)
  SELECT frame, a, b FROM p JOIN t USING (frame, i)""")
def pair_subsample(spark, d):
    near = _near(spark, d).select("frame", "a", "b", F.floor(F.col("a") / 64).alias("step"))
    placed = sequence.numbered(near, ["frame"], "step", ["a", "b"], "i").join(near.groupBy("frame").agg(F.count(F.lit(1)).alias("n")), "frame")
    return selection.spread_of_groups(placed, "i", "n", 16).select("frame", "a", "b")


@query("SELECT p_partkey, coalesce(p_size, 0) > 5 AND p_retailprice > 905 AND NOT isnan(p_retailprice) AS keep FROM part")
def registration_gate(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", ((F.coalesce("p_size", F.lit(0)) > 5) & (F.col("p_retailprice") > 905) & ~F.isnan("p_retailprice")).alias("keep"))


@query("""WITH v AS (SELECT 'p_brand' AS field, p_brand AS name FROM part UNION ALL SELECT 'p_type', p_type FROM part) SELECT field, upper(name) AS folded, count(DISTINCT name) AS spellings, bool_and(regexp_full_match(name, '[A-Za-z0-9_# -]+')) AS valid FROM v GROUP BY ALL""")
def filter_names(spark, d):
    p = table(spark, d, "part")
    v = p.select(F.explode(F.array(F.struct(F.lit("p_brand").alias("field"), F.col("p_brand").alias("name")), F.struct(F.lit("p_type").alias("field"), F.col("p_type").alias("name")))).alias("v")).select("v.*")
    return v.groupBy("field", F.upper("name").alias("folded")).agg(F.countDistinct("name").alias("spellings"), F.bool_and(F.rlike("name", F.lit("^[A-Za-z0-9_# -]+$"))).alias("valid"))


@query("WITH h AS (SELECT md5(text) AS g, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY g HAVING count(*) > 1) SELECT g AS digest, n, first FROM h")
def duplicate_content(spark, d):
    h = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return h.where("n > 1")


@query(f"""WITH {FRAMES}, g AS (SELECT grp, count(*) AS members, row_number() OVER (ORDER BY count(*) DESC, grp) AS place FROM frames GROUP BY grp)
  SELECT grp, members, place, frame_id, row_number() OVER (PARTITION BY grp ORDER BY ts, frame_id) AS pos FROM frames JOIN g USING (grp)""")
def frames_by_filter(spark, d):
    f = frames(spark, d)
    g = f.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    g = g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("members"), "grp")))  # one row for each group
    return sequence.numbered(f, ["grp"], "day", ["ts", "frame_id"], "pos").join(g, "grp").select("grp", "members", "place", "frame_id", "pos")


@query(f"WITH {STARS} SELECT frame, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM stars GROUP BY frame")
def canvas(spark, d):
    return stars(spark, d).groupBy("frame").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {TILES} SELECT vec_id, {M('avg(v)')} AS mean, {M('greatest(avg(v * v) - avg(v) * avg(v), 0)')} AS var, min(v) AS low, max(v) AS high FROM sites GROUP BY vec_id")
def tile_statistics(spark, d):
    t = _planes(spark, d).select("vec_id", "e", plane.mean(F.col("e")).alias("m"), plane.mean_square(F.col("e")).alias("q"))
    return t.select("vec_id", micro(F.col("m")).alias("mean"), micro(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("var"), F.array_min("e").alias("low"), F.array_max("e").alias("high"))
