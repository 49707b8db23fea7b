"""Queries of smooth fields: the sky's background, spatial gains from stars, curvature of local samples; part of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection as pr
from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE
from ..operators import basis_fit, spatial
from ..sources.tables import mosaics, samples, stars
from .catalogue import _RANKED, RADIUS, SAMPLES, STARS, query

_four = lambda c: F.floor(c * 10000 + 0.5) / 10000
_FOUR = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"


def _gauss(name: str, source: str, key: str, n: int) -> str:
    """SQL: name (key, m, low) with source's augmented matrices m of n rows reduced, and the least pivot."""
    return f"""{name}_step AS (
    SELECT {key}, 0 AS k, m, 1e300::DOUBLE AS low FROM {source}
    UNION ALL SELECT {key}, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / r[k + 1]) ELSE list_transform(r, lambda x, j: x - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END), least(low, m[k + 1][k + 1])
      FROM {name}_step WHERE k < {n} AND m[k + 1][k + 1] > 0),
  {name} AS (SELECT {key}, m, low FROM {name}_step WHERE k = {n})"""


def _robust(source: str, key: str, n: int, passes: int, cut: float, least: int) -> str:
    """SQL: fit{passes - 1} (key, m, n_rows) of source (key, b0 ..., v) by reweighted least squares."""
    out = [f"w0 AS (SELECT *, 1.0::DOUBLE AS w FROM {source})"]
    for k in range(passes):
        rows = ", ".join("[" + ", ".join(f"sum(w * b{i} * b{j})" for j in range(n)) + f", sum(w * b{i} * v)]" for i in range(n))
        out.append(f"eq{k} AS (SELECT {key}, count(*) AS n_rows, [{rows}] AS m FROM w{k} GROUP BY {key} HAVING count(*) >= {least})")
        out.append(_gauss(f"fit{k}", f"eq{k}", key, n))
        if k < passes - 1:
            model = " + ".join(f"b{i} * m[{i + 1}][{n + 1}]" for i in range(n))
            out.append(f"e{k} AS (SELECT s.*, v - ({model}) AS e FROM {source} s JOIN fit{k} USING ({key}))")
            out.append(f"c{k} AS (SELECT {key}, median(e) AS mid FROM e{k} GROUP BY {key})")
            out.append(f"d{k} AS (SELECT {key}, greatest({MAD_SCALE} * median(abs(e - mid)), 1e-9) * {cut} AS wide FROM e{k} JOIN c{k} USING ({key}) GROUP BY {key})")
            out.append(f"w{k + 1} AS (SELECT e{k}.* EXCLUDE (e), CASE WHEN abs(e) < wide THEN pow(1 - pow(e / wide, 2), 2) ELSE 0 END AS w FROM e{k} JOIN d{k} USING ({key}))")
    return ", ".join(out)


_BLOCKS = """block AS (
  SELECT vec_id // 64 AS frame, ((vec_id % 8) + 0.5) / 4 - 1 AS x, ((vec_id % 64 // 8) + 0.5) / 4 - 1 AS y, median(floor(embedding[pos]::DOUBLE * 10000 + 0.5) / 10000) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY vec_id),
basis AS (SELECT frame, 1.0 AS b0, (x * x + y * y) / 2 AS b1, (x * x + y * y) / 2 * ((x * x + y * y) / 2) AS b2, x AS b3, y AS b4, v FROM block)"""


@query(f"WITH RECURSIVE {_BLOCKS}, {_robust('basis', 'frame', 5, 3, 3.0, 20)} SELECT frame, e.n_rows AS n, {', '.join(f'{_FOUR(f'f.m[{i + 1}][6]')} AS {c}' for i, c in enumerate(('level', 'fall2', 'fall4', 'slope_x', 'slope_y')))} FROM fit2 f JOIN eq2 e USING (frame)")
def background_fit(spark, d):
    """Each frame's background from the medians of its blocks: a level, two terms of falling off to the corners and a slope, outlying blocks weighing nothing."""
    x, y = (F.col("tx") + 0.5) / 4 - 1, (F.col("ty") + 0.5) / 4 - 1
    b = mosaics(spark, d).select("frame", x.alias("x"), y.alias("y"), plane.median(F.col("plane")).alias("v"))
    r2 = (F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2
    found = basis_fit.robust_fit(b, ["frame"], [F.lit(1.0), r2, r2 * r2, F.col("x"), F.col("y")], F.col("v"))
    return found.select("frame", "n", *[_four(F.get("coefficients", F.lit(i))).alias(c) for i, c in enumerate(("level", "fall2", "fall4", "slope_x", "slope_y"))])


@query(f"""WITH RECURSIVE {_RANKED}, pair AS (SELECT r.frame, s.x / 40 AS x, s.y / 40 AS y, ln(z.flux / s.flux) AS v FROM r JOIN stars s ON s.id = r.a JOIN stars z ON z.id = r.b WHERE k = 1 AND l = 1 AND s.flux > 0.001 AND z.flux > 0.001),
  basis AS (SELECT frame, 1.0 AS b0, x AS b1, y AS b2, x * x AS b3, x * y AS b4, y * y AS b5, v FROM pair), {_robust('basis', 'frame', 6, 3, 3.0, 12)}
  SELECT frame, e.n_rows AS n, {', '.join(f'{_FOUR(f'f.m[{i + 1}][7]')} AS c{i}' for i in range(6))} FROM fit2 f JOIN eq2 e USING (frame)""")
def gain_field(spark, d):
    """A quadratic field over each frame of how much brighter the reference's stars are than their mutual neighbours here, in logarithms, outliers weighing nothing."""
    s = stars(spark, d)
    pairs = spatial.mutual(spatial.within(s.where("frame <> 0"), s.where("frame = 0"), RADIUS, ["frame"]), ["frame"]).select("frame", "a", "b")
    own = s.where("flux > 0.001").select(F.col("id").alias("a"), (F.col("x") / 40).alias("x"), (F.col("y") / 40).alias("y"), F.col("flux").alias("fa"))
    both = pairs.join(own, "a").join(s.where("flux > 0.001").select(F.col("id").alias("b"), F.col("flux").alias("fb")), "b")
    x, y = F.col("x"), F.col("y")
    found = basis_fit.robust_fit(both, ["frame"], [F.lit(1.0), x, y, x * x, x * y, y * y], F.log(F.col("fb") / F.col("fa")), least=12)
    return found.select("frame", "n", *[_four(F.get("coefficients", F.lit(i))).alias(f"c{i}") for i in range(6)])


_P = basis_fit.POWERS
_POWER = lambda i, j: " * ".join(["1.0"] + ["x"] * i + ["y"] * j)


def _scaled(n: int) -> str:
    p = basis_fit._product
    root = lambda i: f"sqrt(n{p(i, i)})"
    return "[" + ", ".join("[" + ", ".join(f"n{p(i, j)} / ({root(i)} * {root(j)})" for j in range(n)) + f", {f'1 / {root(0)}' if i == 0 else '0.0'}]" for i in range(n)) + "]"


def _quadratic_form(a: str, b: str) -> str:
    return " + ".join(f"{a}[{i + 1}] * {b}[{j + 1}] * v{basis_fit._product(i, j)}" for i in range(6) for j in range(6))


_CURVE = f"""WITH RECURSIVE {SAMPLES}, local AS (SELECT x // 8 AS cx, y // 8 AS cy, ch, (x % 8 - 3.5) / 4 AS x, (y % 8 - 3.5) / 4 AS y, q / 50 AS v, w / 100 AS w, 0.0001 + q / 500000 AS variance FROM samples),
sums AS (
  SELECT cx * 24 + cy * 3 + CASE ch WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cell, {', '.join(f'sum(w * {_POWER(*p)}) AS n{i}' for i, p in enumerate(_P))}, {', '.join(f'sum(w * w * variance * {_POWER(*p)}) AS v{i}' for i, p in enumerate(_P))},
    {', '.join(f'sum(w * v * {_POWER(*p)}) AS r{i}' for i, p in enumerate(_P[:6]))}, sum(w * w) AS w2 FROM local GROUP BY ALL),
wide AS (SELECT cell, {_scaled(6)} AS m FROM sums WHERE n0 > 0 AND n1 IS NOT NULL AND n3 > 0 AND n5 > 0 AND n10 > 0 AND n12 > 0 AND n14 > 0), flat AS (SELECT cell, {_scaled(3)} AS m FROM sums WHERE n0 > 0 AND n3 > 0 AND n5 > 0),
{_gauss('q', 'wide', 'cell', 6)}, {_gauss('p', 'flat', 'cell', 3)},
answer AS (
  SELECT s.*, CASE WHEN q.low > {basis_fit.LEAST_PIVOT} THEN [{', '.join(f'q.m[{i + 1}][7] / sqrt(n{basis_fit._product(i, i)})' for i in range(6))}] END AS qu,
    CASE WHEN p.low > {basis_fit.LEAST_PIVOT} THEN [{', '.join(f'p.m[{i + 1}][4] / sqrt(n{basis_fit._product(i, i)})' for i in range(3))}, 0.0, 0.0, 0.0] END AS li FROM sums s LEFT JOIN q USING (cell) LEFT JOIN p USING (cell)),
gap AS (SELECT *, list_transform(qu, lambda a, i: a - li[i]) AS di FROM answer),
form AS (
  SELECT *, {_quadratic_form('li', 'li')} AS vp, {_quadratic_form('qu', 'qu')} AS vq, greatest({_quadratic_form('di', 'di')}, 0) AS vd, {' + '.join(f'di[{i + 1}] * r{i}' for i in range(6))} AS delta FROM gap),
judged AS (
  SELECT cell, delta, CASE WHEN n0 * n0 < {basis_fit.LEAST_SAMPLES} * w2 THEN 'effective_samples' WHEN qu IS NULL THEN 'quadratic_condition' WHEN li IS NULL THEN 'linear_condition' WHEN vp <= 0 OR vq <= 0 OR vq > {basis_fit.MOST_VARIANCE} * vp THEN 'variance' END AS why,
    least(greatest(1 - {basis_fit.CERTAIN} * vd / greatest(delta * delta, 1e-30), 0), 1) AS blend FROM form)"""


@query(f"{_CURVE} SELECT cell, why, CASE WHEN why IS NULL THEN {_FOUR('delta')} END AS delta, CASE WHEN why IS NULL THEN {_FOUR('blend')} END AS blend FROM judged")
def curvature_fit(spark, d):
    """What a quadratic adds to a plane at the centre of each cell of samples, and whether their number, spread and noise allow it."""
    c = F.col
    s = samples(spark, d)
    local = s.select(
        (F.floor(c("x") / 8) * 24 + F.floor(c("y") / 8) * 3 + F.when(c("ch") == "A", 0).when(c("ch") == "N", 1).otherwise(2)).alias("cell"),
        ((c("x") % 8 - 3.5) / 4).alias("x"), ((c("y") % 8 - 3.5) / 4).alias("y"), (c("q") / 50).alias("v"), (c("w") / 100).alias("w"), (0.0001 + c("q") / 500000).alias("variance"),
    )
    found = basis_fit.checked_curvature(basis_fit.moments(local, ["cell"], "w", "x", "y", "v", "variance"), ["cell"])
    return found.select("cell", "why", _four(c("delta")).alias("delta"), _four(c("blend")).alias("blend"))


# Each frame's stars through a lens and a homography of the frame's own; frame 9's homography is singular.
_PROJECTED = STARS + """, lens AS (SELECT DISTINCT frame, 0.01 * (frame - 4) AS k, 0.002 * frame AS p1, -0.001 * frame AS p2, CASE WHEN frame = 9 THEN 0.0 ELSE 1.0 END AS h8, 0.02 * frame AS turn FROM stars),
  site AS (SELECT s.id, s.x AS sx, s.y AS sy, l.*, cos(turn) AS m, sin(turn) AS n FROM stars s JOIN lens l USING (frame))"""
_BEND = "{x} + k * {x} * ({x} * {x} + {y} * {y}) + 2 * p1 * {x} * {y} + p2 * (({x} * {x} + {y} * {y}) + 2 * {x} * {x})"
_BEND_Y = "{y} + k * {y} * ({x} * {x} + {y} * {y}) + p1 * (({x} * {x} + {y} * {y}) + 2 * {y} * {y}) + 2 * p2 * {x} * {y}"


def _lens(spark, d):
    f = F.col("frame")
    turn = 0.02 * f
    last = F.when(f == 9, 0.0).otherwise(1.0)
    rows = [F.cos(turn), -F.sin(turn), F.lit(0.01), F.sin(turn), F.cos(turn), F.lit(-0.02), F.lit(0.01) * last, F.lit(0.005) * last, last]
    p = pr.projection(cx=F.lit(2.0), cy=F.lit(-1.0), norm=F.lit(50.0), k=0.01 * (f - 4), p1=0.002 * f, p2=-0.001 * f, h=F.array(*rows), ox=F.lit(100.0), oy=F.lit(80.0), scale=F.lit(40.0))
    return stars(spark, d).withColumn("p", F.explode(F.array(p)))


@query(f"""WITH {_PROJECTED}, u AS (SELECT *, (sx - 2) / 50 AS x, (sy + 1) / 50 AS y FROM site), v AS (SELECT *, {_BEND.format(x='x', y='y')} AS bx, {_BEND_Y.format(x='x', y='y')} AS b_y FROM u)
  SELECT id, CASE WHEN h8 = 0 THEN 'singular' END AS fault, CASE WHEN h8 > 0 THEN {_FOUR('(m * bx - n * b_y + 0.01) / (0.01 * bx + 0.005 * b_y + 1) * 40 + 100')} END AS x,
    CASE WHEN h8 > 0 THEN {_FOUR('(n * bx + m * b_y - 0.02) / (0.01 * bx + 0.005 * b_y + 1) * 40 + 80')} END AS y FROM v""")
def projected_stars(spark, d):
    """Where each star lands in the output, and what is wrong with its frame's projection."""
    s = _lens(spark, d).select("id", pr.fault(F.col("p")).alias("fault"), F.explode(F.array(pr.forward(F.col("p"), F.col("x"), F.col("y")))).alias("q"))
    return s.select("id", "fault", _four(F.col("q.x")).alias("x"), _four(F.col("q.y")).alias("y"))


_NEWTON = """SELECT * EXCLUDE (x, y, bx, b_y, ja, jb, jd), x - (jd * (bx - tx) - jb * (b_y - ty)) / (ja * jd - jb * jb) AS x, y - (ja * (b_y - ty) - jb * (bx - tx)) / (ja * jd - jb * jb) AS y
  FROM (SELECT *, {bend} AS bx, {bend_y} AS b_y, 1 + k * (3 * x * x + y * y) + 2 * p1 * y + 6 * p2 * x AS ja, 2 * k * x * y + 2 * p1 * x + 2 * p2 * y AS jb, 1 + k * (x * x + 3 * y * y) + 6 * p1 * y + 2 * p2 * x AS jd FROM {of})"""
_STEPS = ", ".join(f"n{i + 1} AS ({_NEWTON.format(of=f'n{i}', bend=_BEND.format(x='x', y='y'), bend_y=_BEND_Y.format(x='x', y='y'))})" for i in range(8))


@query(f"""WITH {_PROJECTED}, o AS (SELECT *, (sx * 0.5) / 40 AS qx, (sy * 0.5) / 40 AS qy FROM site WHERE h8 > 0),
  back AS (SELECT *, m - qx * 0.01 AS a, -n - qx * 0.005 AS b, qx - 0.01 AS r, n - qy * 0.01 AS c, m - qy * 0.005 AS e, qy + 0.02 AS s FROM o),
  n0 AS (SELECT *, (r * e - b * s) / (a * e - b * c) AS tx, (a * s - c * r) / (a * e - b * c) AS ty, (r * e - b * s) / (a * e - b * c) AS x, (a * s - c * r) / (a * e - b * c) AS y FROM back), {_STEPS}
  SELECT id, {_FOUR('x * 50 + 2')} AS x, {_FOUR('y * 50 - 1')} AS y FROM n8""")
def unprojected_places(spark, d):
    """The site behind an output place near each star, by Newton's method; SQL solves the homography's two equations and takes eight whole steps."""
    s = _lens(spark, d).where("frame <> 9").select("id", F.explode(F.array(pr.backward(F.col("p"), F.col("x") * 0.5 + 100, F.col("y") * 0.5 + 80))).alias("q"))
    return s.select("id", _four(F.col("q.x")).alias("x"), _four(F.col("q.y")).alias("y"))
