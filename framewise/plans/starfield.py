"""Queries of stars in frames made of tiles: detection, measurement, frame metrics; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE
from ..operators import correlate, detect
from ..sources.shared import materialize
from ..sources.tables import mosaics
from .catalogue import query

#: The tables' tiles hold noise of eight sites a side, so the query asks for less than the defaults do.
RULES = detect.Rules(detect=2.0, companion=0.5, companions=3, ring=3, ring_sigma=1.0, ring_share=0.1, reach=2, region=8, keep=3, window=5, sky=(3.0, 4.0, 5.0), flatness=0.03, core=2.5, least_stars=3, background=0.75)
_R = RULES
_five = lambda c: (F.floor(F.col(c) * 100000 + 0.5) / 100000).alias(c)
_FIVE = lambda x: f"floor(({x}) * 100000 + 0.5) / 100000"

_SKY = f"""site AS (
  SELECT vec_id // 64 AS frame, (vec_id % 8) * 8 + (pos - 1) % 8 AS x, (vec_id % 64 // 8) * 8 + (pos - 1) // 8 AS y, floor(embedding[pos]::DOUBLE * 10000 + 0.5) / 10000 AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)),
med AS (SELECT frame, y % 2 * 2 + x % 2 AS cell, median(v) AS level FROM site GROUP BY ALL),
sky AS (
  SELECT frame, cell, any_value(level) AS level, greatest({MAD_SCALE} * median(abs(v - level)), 1e-9) AS sigma FROM site JOIN med USING (frame) WHERE y % 2 * 2 + x % 2 = cell GROUP BY frame, cell)"""
_CELLS = _SKY + """, signal AS (SELECT s.*, cell, (v - level) / sigma AS w FROM site s JOIN sky k ON k.frame = s.frame AND k.cell = y % 2 * 2 + x % 2),
snr AS (
  SELECT frame, x // 2 AS cx, y // 2 AS cy, (max(w) FILTER (cell = 0) + max(w) FILTER (cell = 1) + max(w) FILTER (cell = 2) + max(w) FILTER (cell = 3)) * 0.5 AS s
  FROM signal GROUP BY ALL HAVING max(v) < 1)"""
_RING = "[" + ", ".join(f"[{x}, {y}]" for x, y in detect._ring(_R.ring)) + "]"
_FOUND = _CELLS + f""", around AS (
  SELECT c.frame, c.cx, c.cy, c.s, count(*) AS n, max(o.s) AS most, count(*) FILTER (greatest(abs(o.cx - c.cx), abs(o.cy - c.cy)) = 1 AND o.s > {_R.companion}) AS near
  FROM snr c JOIN snr o ON o.frame = c.frame AND o.cx BETWEEN c.cx - 2 AND c.cx + 2 AND o.cy BETWEEN c.cy - 2 AND c.cy + 2 AND (o.cx <> c.cx OR o.cy <> c.cy)
  WHERE c.s >= {_R.detect} GROUP BY ALL),
ring AS (
  SELECT c.frame, c.cx, c.cy, count(*) AS n, median(o.s) AS mid FROM (SELECT *, unnest({_RING}) AS d FROM around) c JOIN snr o ON o.frame = c.frame AND o.cx = c.cx + d[1] AND o.cy = c.cy + d[2] GROUP BY ALL),
cand AS (
  SELECT a.frame, a.cx, a.cy, a.s, a.cx // {_R.region} AS rx, a.cy // {_R.region} AS ry FROM around a JOIN ring r USING (frame, cx, cy)
  WHERE a.n = 24 AND a.most <= a.s AND near >= {_R.companions} AND r.n = 12 AND mid < greatest({_R.ring_sigma}, {_R.ring_share} * a.s)),
free AS (
  SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.frame = c.frame AND o.rx = c.rx AND o.ry = c.ry AND (o.cx <> c.cx OR o.cy <> c.cy) AND abs(o.cx - c.cx) <= {_R.reach} AND abs(o.cy - c.cy) <= {_R.reach}))"""
_STRONGEST = _FOUND + f", star AS (SELECT frame, cx * 2 AS x, cy * 2 AS y, s FROM free QUALIFY row_number() OVER (PARTITION BY frame, rx, ry ORDER BY s DESC, cy, cx) <= {_R.keep})"


def _measures(aperture: str) -> str:
    return f""", px AS (
  SELECT t.frame, t.x, t.y, g.y - t.y AS dy, g.x - t.x AS dx, g.cell, g.w FROM star t JOIN signal g ON g.frame = t.frame AND g.x BETWEEN t.x - {_R.window} AND t.x + {_R.window} AND g.y BETWEEN t.y - {_R.window} AND t.y + {_R.window}),
whole AS (SELECT px.* FROM px JOIN (SELECT frame, x, y FROM px GROUP BY ALL HAVING count(*) = {(2 * _R.window + 1) ** 2}) USING (frame, x, y)),
core AS (SELECT frame, cell, median(greatest(w, 0)) AS med FROM whole WHERE abs(dx) <= 1 AND abs(dy) <= 1 GROUP BY ALL),
reply AS (SELECT c.frame, cell, CASE WHEN med > 1e-3 THEN med / greatest(mid, 1e-6) ELSE 1 END AS reply FROM core c JOIN (SELECT frame, median(med) AS mid FROM core GROUP BY frame) USING (frame)),
even AS (SELECT frame, x, y, dy, dx, sqrt(dx * dx + dy * dy) AS r, w / greatest(reply, 1e-6) AS w FROM whole JOIN reply USING (frame, cell)),
local AS (
  SELECT frame, x, y, median(w) FILTER (r BETWEEN {_R.sky[0]} AND {_R.sky[1]}) AS a, median(w) FILTER (r BETWEEN {_R.sky[1]} AND {_R.sky[2]}) AS b, greatest(max(w), 0) AS peak,
    sum(w) FILTER (w > 0 AND r <= {_R.core}) AS flux, sum(w * dx) FILTER (w > 0 AND r <= {_R.core}) AS fx, sum(w * dy) FILTER (w > 0 AND r <= {_R.core}) AS fy FROM even GROUP BY ALL),
net AS (SELECT e.frame, e.x, e.y, dy, dx, r, w - CASE WHEN a - b <= {_R.flatness} * greatest(peak, 1e-6) THEN b ELSE 0 END AS w FROM even e JOIN local USING (frame, x, y)),
centre AS (SELECT frame, x, y, sum(w * dx) / sum(w) AS cx, sum(w * dy) / sum(w) AS cy FROM net WHERE w > 0 AND r <= {_R.core} GROUP BY ALL),
radial AS (SELECT n.frame, n.x, n.y, cx, cy, dy, dx, w, sqrt((dx - cx) * (dx - cx) + (dy - cy) * (dy - cy)) AS r FROM net n JOIN centre USING (frame, x, y)),
half AS (SELECT frame, x, y, sum(w) / 2 AS half FROM radial GROUP BY ALL HAVING sum(w) > 0),
curve AS (
  SELECT r.*, half, sum(w) OVER o AS upto, coalesce(lag(r) OVER o, 0) AS before FROM radial r JOIN half USING (frame, x, y) WINDOW o AS (PARTITION BY frame, x, y ORDER BY r, dy, dx ROWS UNBOUNDED PRECEDING)),
size AS (
  SELECT frame, x, y, before + (r - before) * least(greatest((half - (upto - w)) / greatest(w, 1e-9), 0), 1) AS hfr FROM curve WHERE upto >= half
  QUALIFY row_number() OVER (PARTITION BY frame, x, y ORDER BY r, dy, dx) = 1),
moment AS (
  SELECT r.frame, r.x, r.y, any_value(hfr) AS hfr, sum(w * (dx - cx) * (dx - cx)) / sum(w) AS xx, sum(w * (dy - cy) * (dy - cy)) / sum(w) AS yy, sum(w * (dx - cx) * (dy - cy)) / sum(w) AS xy
  FROM radial r JOIN size USING (frame, x, y) {'' if aperture == 'hfr' else 'CROSS JOIN burst'} WHERE w > 0 AND r <= least(greatest({'2.5 * hfr' if aperture == 'hfr' else aperture}, 2), {_R.window}) GROUP BY r.frame, r.x, r.y),
shape AS (
  SELECT frame, x, y, 2 * hfr AS hfd, sqrt(least(greatest(1 - greatest((xx + yy - sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2, 0) / greatest((xx + yy + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2, 1e-12), 0), 1)) AS ecc,
    degrees(atan2(2 * xy, xx - yy)) / 2 AS angle FROM moment)"""


def _sky_and_tiles(spark, d):
    tiles = mosaics(spark, d)
    return tiles, detect.sky(tiles, 8)


def _stars(spark, d):
    tiles, sky = _sky_and_tiles(spark, d)
    sky = materialize(sky, "sky")
    cut = materialize(detect.signals(detect.windows(detect.detect(tiles, sky, 8, RULES), tiles, 8, RULES.window), sky), "windows")
    return cut.join(detect.response(cut), "frame")


@query(f"WITH {_STRONGEST} SELECT frame, x, y, {_FIVE('s')} AS s FROM star")
def stars_detected(spark, d):
    """The strongest stars of each region of every frame: bright cells, higher than all within two cells, on a sky that comes back, neither alone nor crowded."""
    tiles, sky = _sky_and_tiles(spark, d)
    return detect.detect(tiles, sky, 8, RULES).select("frame", "x", "y", _five("s"))


@query(f"WITH {_FOUND}, n AS (SELECT *, row_number() OVER (PARTITION BY frame, rx, ry ORDER BY cy, cx) - 1 AS i, count(*) OVER (PARTITION BY frame, rx, ry) AS c FROM free) SELECT frame, cx * 2 AS x, cy * 2 AS y FROM n WHERE i % greatest(c // 2, 1) = 0 AND i // greatest(c // 2, 1) < 2")
def stars_spread(spark, d):
    """Two stars of each region, evenly through those that it has."""
    tiles, sky = _sky_and_tiles(spark, d)
    return detect.detect(tiles, sky, 8, detect.Rules(**{**vars(RULES), "keep": 2}), strongest=False).select("frame", "x", "y")


@query(f"WITH {_STRONGEST}{_measures('hfr')} SELECT frame, x, y, {_FIVE('x + fx / flux')} AS cx, {_FIVE('y + fy / flux')} AS cy, {_FIVE('flux')} AS flux, {_FIVE('hfd')} AS hfd, {_FIVE('ecc')} AS eccentricity, {_FIVE('angle')} AS angle FROM shape JOIN local USING (frame, x, y)")
def stars_measured(spark, d):
    """Each star's sub-pixel place, core flux, half-flux diameter above its local sky, eccentricity and direction."""
    return detect.measured(_stars(spark, d), RULES).select("frame", "x", "y", *[_five(c) for c in ("cx", "cy", "flux", "hfd", "eccentricity", "angle")])


_METRICS = """SELECT frame, count(*) AS n, median(hfd) AS hfd, median(ecc) AS ecc, degrees(atan2(sum(ecc * sin(radians(2 * angle))), sum(ecc * cos(radians(2 * angle))))) / 2 AS angle FROM shape GROUP BY frame HAVING count(*) >= """


@query(f"""WITH {_STRONGEST}{_measures('hfr')}, first AS ({_METRICS}{_R.least_stars}),
  burst AS (SELECT CASE WHEN count(*) * 4 >= 3 * (SELECT count(DISTINCT frame) FROM site) AND count(*) >= 3 THEN least(greatest(1.25 * median(hfd), 2), {_R.window}) END AS aperture FROM first)
  SELECT aperture IS NOT NULL AS one_window, {_FIVE('aperture')} AS aperture FROM burst""")
def burst_window(spark, d):
    """The one aperture through which all frames' stars are measured."""
    first = detect.frame_metrics(detect.measured(_stars(spark, d), RULES), RULES.least_stars)
    return detect.burst_aperture(first, mosaics(spark, d), RULES).select(F.col("aperture").isNotNull().alias("one_window"), _five("aperture"))


_SECOND = _measures(f"coalesce(aperture, {2.5} * hfr)").split(",\nmoment AS", 1)[1]


@query(f"""WITH {_STRONGEST}{_measures('hfr')}, first AS ({_METRICS}{_R.least_stars}),
  burst AS (SELECT CASE WHEN count(*) * 4 >= 3 * (SELECT count(DISTINCT frame) FROM site) AND count(*) >= 3 THEN least(greatest(1.25 * median(hfd), 2), {_R.window}) END AS aperture FROM first),
  moment2 AS{_SECOND.replace('FROM moment)', 'FROM moment2)').replace('shape AS', 'shape2 AS')}
  SELECT frame, count(*) AS n, {_FIVE('median(hfd)')} AS hfd, {_FIVE('median(ecc)')} AS eccentricity, {_FIVE('((degrees(atan2(sum(ecc * sin(radians(2 * angle))), sum(ecc * cos(radians(2 * angle))))) / 2) + 180) % 180')} AS angle FROM shape2 GROUP BY frame HAVING count(*) >= {_R.least_stars}""")
def frame_star_metrics(spark, d):
    """Every frame on equal terms: measured once for the burst's aperture, then again through it."""
    cut = _stars(spark, d)
    window = detect.burst_aperture(detect.frame_metrics(detect.measured(cut, RULES), RULES.least_stars), mosaics(spark, d), RULES)
    equal = cut.join(F.broadcast(window))  # one row
    again = detect.measured(equal, RULES, F.coalesce("aperture", 2.5 * F.col("hfr")))
    return detect.frame_metrics(again, RULES.least_stars).select("frame", "n", _five("hfd"), _five("eccentricity"), _five("angle"))


@query(f"""WITH {_SKY}, part AS (SELECT frame, y % 2 * 2 + x % 2 AS cell, x // {2 * _R.region} AS rx, y // {2 * _R.region} AS ry, v FROM site),
  mid AS (SELECT frame, cell, rx, ry, median(v) AS mid FROM part GROUP BY ALL)
  SELECT frame, {_FIVE('avg(CASE WHEN abs(v - mid) < 3 * sigma THEN 1 ELSE 0 END)')} AS share, avg(CASE WHEN abs(v - mid) < 3 * sigma THEN 1 ELSE 0 END) >= {_R.background} AS star_field
  FROM part JOIN mid USING (frame, cell, rx, ry) JOIN sky USING (frame, cell) GROUP BY frame""")
def background_share(spark, d):
    """How much of each frame is sky, asked region by region: what tells a star field from a photograph."""
    tiles, sky = _sky_and_tiles(spark, d)
    return detect.background_share(tiles, sky, 8, RULES.region).select("frame", _five("share"), (F.col("share") >= RULES.background).alias("star_field"))


SPAN, STEP = 0.6, 0.1
_SHIFT = f"""flat AS (
  SELECT vec_id, pos - 1 AS i, floor(embedding[pos]::DOUBLE * 10000 + 0.5) / 10000 AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)),
mean AS (SELECT vec_id, avg(v) AS m FROM flat GROUP BY vec_id),
seen AS (SELECT f.vec_id, i % 8 AS x, i // 8 AS y, (v - m) * (0.5 - 0.5 * cos(2 * pi() * (i % 8) / 7)) * (0.5 - 0.5 * cos(2 * pi() * (i // 8) / 7)) AS v FROM flat f JOIN mean USING (vec_id)),
place AS (SELECT i % 8 AS u, i // 8 AS w FROM (SELECT unnest(range(64)) AS i)),
spectrum AS (
  SELECT vec_id, u, w, sum(v * cos(2 * pi() * (u * x + w * y) / 8)) AS re, -sum(v * sin(2 * pi() * (u * x + w * y) / 8)) AS im FROM seen, place GROUP BY vec_id, u, w),
both_of AS (
  SELECT a.vec_id AS id, u, w, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im, sqrt(a.re * a.re + a.im * a.im) * sqrt(b.re * b.re + b.im * b.im) AS size
  FROM spectrum a JOIN spectrum b USING (u, w) WHERE b.vec_id = a.vec_id + 64),
gate AS (SELECT id, max(size) AS most FROM both_of GROUP BY id),
faded AS (
  SELECT id, u, w, CASE WHEN u > 4 THEN u - 8 ELSE u END AS fu, CASE WHEN w > 4 THEN w - 8 ELSE w END AS fw, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im
  FROM both_of JOIN gate USING (id) WHERE size > most * 1e-4),
power AS (
  SELECT id, CASE WHEN u >= 4 THEN u - 8 ELSE u END AS u, CASE WHEN w >= 4 THEN w - 8 ELSE w END AS w, re * exp(-(fu * fu + fw * fw) / 12.96) AS re, im * exp(-(fu * fu + fw * fw) / 12.96) AS im FROM faded),
surface AS (SELECT id, p.u AS x, p.w AS y, sum(re * cos(2 * pi() * (f.u * p.u + f.w * p.w) / 8) - im * sin(2 * pi() * (f.u * p.u + f.w * p.w) / 8)) / 64 AS s FROM power f, place p GROUP BY id, p.u, p.w),
peak AS (SELECT id, x, y, s FROM surface QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1),
step_of AS (SELECT -{SPAN} + i * {STEP} AS o FROM (SELECT unnest(range({round(2 * SPAN / STEP) + 1})) AS i)),
fine AS (
  SELECT id, ox.o AS ox, oy.o AS oy, sum(re * cos(2 * pi() * (u * (x + ox.o) + w * (y + oy.o)) / 8) - im * sin(2 * pi() * (u * (x + ox.o) + w * (y + oy.o)) / 8)) AS s FROM power JOIN peak USING (id), step_of ox, step_of oy GROUP BY id, ox.o, oy.o),
best AS (SELECT id, ox, oy FROM fine QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC) = 1)"""


@query(f"WITH {_SHIFT} SELECT id // 64 AS frame, id % 8 AS tx, id % 64 // 8 AS ty, {_FIVE('CASE WHEN x > 4 THEN x - 8 ELSE x END + ox')} AS dx, {_FIVE('CASE WHEN y > 4 THEN y - 8 ELSE y END + oy')} AS dy, {_FIVE('p.s')} AS peak FROM peak p JOIN best USING (id)")
def tile_shift(spark, d):
    """How far each tile has moved from one frame to the next, by phase correlation to a tenth of a pixel."""
    t = mosaics(spark, d)
    after = t.select((F.col("frame") - 1).alias("frame"), "tx", "ty", F.col("plane").alias("b"))
    pairs = t.withColumnRenamed("plane", "a").join(after, ["frame", "tx", "ty"])
    return correlate.shifts(pairs, 8, SPAN, STEP).select("frame", "tx", "ty", _five("dx"), _five("dy"), _five("peak"))
