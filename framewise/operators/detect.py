"""Stars in frames that are held as tiles: sky by mosaic cell, detection on two-by-two cells, windows across tile edges, sizes and shapes.

A frame is a set of square tiles (frame, tx, ty, plane), each a row with its values in one array. Where a step looks beyond a tile's edge, tiles send their
neighbours the rim that these need, not all of themselves; windows around stars are cut from the few tiles that they touch. Levels of the sky are medians on
a grid of values, so a frame of any size sends one count for each level. Values at 1 are saturated."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE
from . import rank, selection


@dataclass(frozen=True)
class Rules:
    """What counts as a star. Cells are two sites wide, and sigmas are the noise of a site. The defaults."""

    detect: float = 10.0
    companion: float = 3.0
    companions: int = 3
    ring: int = 9  # cells: the source has faded there
    ring_sigma: float = 4.0
    ring_share: float = 0.10
    reach: int = 11  # cells: two candidates so near spoil each other
    region: int = 64  # cells
    keep: int = 12  # of a region
    window: int = 11  # sites
    sky: tuple[float, float, float] = (7.0, 9.0, 11.0)  # radii of the two rings that the local sky is taken from
    flatness: float = 0.03
    core: float = 2.5
    least_stars: int = 20
    background: float = 0.75  # share of sites near the sky's level that a star field has


def _cell(x: Column, y: Column) -> Column:
    return F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2))


def sites(tiles: DataFrame, size: int) -> DataFrame:
    """(frame, x, y, v), one row a site: for aggregations that need no neighbours."""
    s = tiles.select("frame", "tx", "ty", F.posexplode("plane").alias("i", "v"))
    return s.select("frame", (F.col("tx") * size + F.col("i") % size).alias("x"), (F.col("ty") * size + F.floor(F.col("i") / size)).alias("y"), "v")


def sky(tiles: DataFrame, size: int, least_sigma: float = 1e-9) -> DataFrame:
    """(frame, level, sigma): arrays over the four sites of a cell, the median and the scaled median distance from it."""
    s = sites(tiles, size).select("frame", _cell(F.col("x"), F.col("y")).alias("cell"), "v")
    by = rank.median_mad(s, ["frame", "cell"], "v")
    four = by.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("cell", "med", "mad"))).alias("s"))
    return four.select("frame", F.transform("s", lambda c: c["med"]).alias("level"), F.transform("s", lambda c: F.greatest(MAD_SCALE * c["mad"], F.lit(least_sigma))).alias("sigma"))


def background_share(tiles: DataFrame, sky_of: DataFrame, size: int, region: int) -> DataFrame:
    """(frame, share) of the sites within three sigma of the level of their own part of the frame (regions of `region` cells): a gradient of the sky is no signal."""
    s = sites(tiles, size).select("frame", _cell(F.col("x"), F.col("y")).alias("cell"), F.floor(F.col("x") / (2 * region)).alias("rx"), F.floor(F.col("y") / (2 * region)).alias("ry"), "v")
    part = ["frame", "cell", "rx", "ry"]
    counts = s.where("v IS NOT NULL").groupBy(*part, "v").agg(F.count(F.lit(1)).alias("times"))
    near = counts.join(rank.median(counts, part, "v", weight="times").drop("n"), part).join(sky_of, "frame")
    flat = F.sum(F.when(F.abs(F.col("v") - F.col("med")) < 3 * F.get("sigma", F.col("cell").cast("int")), F.col("times")).otherwise(0))
    return near.groupBy("frame").agg((flat / F.sum("times")).alias("share"))


def cells(tiles: DataFrame, sky_of: DataFrame, size: int) -> DataFrame:
    """(frame, tx, ty, snr): half the sum of a cell's four signals in units of their noise, so that colours don't modulate it; null at saturated cells."""
    half, col = size // 2, F.col
    joined = tiles.join(sky_of, "frame")

    def one(k: Column) -> Column:
        at = lambda dx, dy: F.get("plane", ((F.floor(k / half) * 2 + dy) * size + k % half * 2 + dx).cast("int"))
        four = [(at(dx, dy), dy * 2 + dx) for dy in (0, 1) for dx in (0, 1)]
        terms = [(v - col("level")[c]) / col("sigma")[c] for v, c in four]
        return F.when(F.greatest(*[v for v, _ in four]) < 1.0, (terms[0] + terms[1] + terms[2] + terms[3]) * 0.5)

    return joined.select("frame", "tx", "ty", F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), one).alias("snr"))


def with_rim(tiles: DataFrame, value: str, size: int, reach: int) -> DataFrame:
    """tiles with `value` grown by `reach` (at most `size`) on all sides from the neighbours' values; null where there is no neighbour."""
    if not 0 < reach <= size:
        raise ValueError("a rim comes from the next tile only")
    wide = size + 2 * reach

    def span(d: Column) -> tuple[Column, Column]:
        """The places of a tile that its neighbour d tiles on needs: (first, number)."""
        return F.when(d == 1, size - reach).otherwise(0), F.when(d == 0, size).otherwise(reach)

    to = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    sent = tiles.select("frame", "tx", "ty", F.col(value).alias("v"), to.alias("d"))
    (x0, nx), (y0, ny) = span(F.col("d.i")), span(F.col("d.j"))
    sent = sent.withColumn("g", F.struct(x0.alias("x0"), nx.alias("nx"), y0.alias("y0"), ny.alias("ny")))
    cut = F.transform(F.sequence(F.lit(0), F.col("g.nx") * F.col("g.ny") - 1), lambda k: F.get("v", ((F.col("g.y0") + F.floor(k / F.col("g.nx"))) * size + F.col("g.x0") + k % F.col("g.nx")).cast("int")))
    sent = sent.select("frame", (F.col("tx") + F.col("d.i")).alias("tx"), (F.col("ty") + F.col("d.j")).alias("ty"), F.struct((-F.col("d.i")).alias("i"), (-F.col("d.j")).alias("j")).alias("from"), cut.alias("v"))
    parts = sent.groupBy("frame", "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct((F.col("from.j") * 3 + F.col("from.i")).alias("k"), "v"))).alias("parts"))  # nine at most

    def one(k: Column) -> Column:
        x, y = k % wide, F.floor(k / wide)
        side = lambda a: F.when(a < reach, -1).when(a >= reach + size, 1).otherwise(0)
        place = lambda a: F.when(a < reach, a).when(a >= reach + size, a - reach - size).otherwise(a - reach)
        width = F.when(side(x) == 0, size).otherwise(reach)
        return F.get(F.try_element_at("parts", (side(y) * 3 + side(x)).cast("int")), (place(y) * width + place(x)).cast("int"))

    grown = parts.where(F.map_contains_key("parts", F.lit(0))).select("frame", "tx", "ty", F.transform(F.sequence(F.lit(0), F.lit(wide * wide - 1)), one).alias("__grown"))
    return tiles.join(grown, ["frame", "tx", "ty"]).withColumn(value, F.col("__grown")).drop("__grown")


def _ring(radius: int) -> list[tuple[int, int]]:
    points = [(radius * math.cos(math.tau * k / 12), radius * math.sin(math.tau * k / 12)) for k in range(12)]
    return [(math.floor(x + 0.5), math.floor(y + 0.5)) for x, y in points]


def candidates(snr: DataFrame, size: int, rules: Rules) -> DataFrame:
    """(frame, cx, cy, s): cells over the threshold that no neighbour within two cells exceeds, whose surroundings come back to the sky at the ring, and that aren't
    alone (no optics put a star into one cell). A cell belongs to its own tile, so it is found once. Cells whose surroundings aren't all there are left out."""
    half = size // 2
    reach = max(2, rules.ring)
    wide = half + 2 * reach
    grown = with_rim(snr, "snr", half, reach)

    def offsets(places: list[tuple[int, int]]) -> Column:
        return F.array(*[F.lit(dy * wide + dx) for dx, dy in places])

    around = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3) if dx or dy]
    next_to = [(dx, dy) for dx, dy in around if max(abs(dx), abs(dy)) == 1]

    def at(i: Column, places: list[tuple[int, int]]) -> Column:
        return F.transform(offsets(places), lambda o: F.get("snr", i + o))

    inner = F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), lambda k: ((F.floor(k / half) + reach) * wide + k % half + reach).cast("int"))
    bright = grown.select("frame", "tx", "ty", "snr", F.explode(F.filter(inner, lambda i: F.get("snr", i) >= rules.detect)).alias("i"))
    seen = bright.select(
        "frame", (F.col("tx") * half + F.col("i") % wide - reach).alias("cx"), (F.col("ty") * half + F.floor(F.col("i") / wide) - reach).alias("cy"), F.get("snr", "i").alias("s"),
        at(F.col("i"), around).alias("around"), at(F.col("i"), next_to).alias("next"), F.array_sort(at(F.col("i"), _ring(rules.ring))).alias("ring"),
    )
    whole = ~F.exists("around", lambda v: v.isNull()) & ~F.exists("ring", lambda v: v.isNull())
    faded = (F.get("ring", F.lit(5)) + F.get("ring", F.lit(6))) / 2 < F.greatest(F.lit(rules.ring_sigma), rules.ring_share * F.col("s"))
    alone = F.size(F.filter("next", lambda v: v > rules.companion)) < rules.companions
    return seen.where(whole & faded & ~alone & ~F.exists("around", lambda v: v > F.col("s"))).select("frame", "cx", "cy", "s")


def uncrowded(found: DataFrame, rules: Rules) -> DataFrame:
    """Candidates with region (rx, ry), without those that another one of their region stands within reach of, whichever is brighter."""
    step = rules.reach + 1
    c = found.withColumn("rx", F.floor(F.col("cx") / rules.region)).withColumn("ry", F.floor(F.col("cy") / rules.region))
    key = ["frame", "rx", "ry"]
    mine = c.select(*key, "cx", "cy", F.floor(F.col("cx") / step).alias("u"), F.floor(F.col("cy") / step).alias("v"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = mine.select(*key, F.col("cx").alias("ox"), F.col("cy").alias("oy"), "u", "v", near.alias("d")).select(*key, "ox", "oy", (F.col("u") + F.col("d.i")).alias("u"), (F.col("v") + F.col("d.j")).alias("v"))
    apart = F.greatest(F.abs(F.col("cx") - F.col("ox")), F.abs(F.col("cy") - F.col("oy")))
    crowded = mine.join(other, [*key, "u", "v"]).where((apart > 0) & (apart <= rules.reach)).select("frame", "cx", "cy").distinct()
    return c.join(crowded, ["frame", "cx", "cy"], "left_anti")


def detect(tiles: DataFrame, sky_of: DataFrame, size: int, rules: Rules = Rules(), strongest: bool = True) -> DataFrame:
    """(frame, x, y, s) in sites: the stars, at most `keep` of each region: its strongest, or evenly through those that it has."""
    found = uncrowded(candidates(cells(tiles, sky_of, size), size, rules), rules)
    region = ["frame", "rx", "ry"]
    if strongest:
        best = selection.top_of_region(found.withColumn("order", F.struct("cy", "cx")), region, "s", "order", rules.keep)
    else:
        placed = found.withColumn("order", F.lit(1)).withColumn("line", F.struct("cy", "cx"))
        numbered = selection.top_of_region(placed, region, "order", "line", 2**31 - 1).join(found.groupBy(*region).agg(F.count(F.lit(1)).alias("n")), region)
        stride = F.greatest(F.floor(F.col("n") / rules.keep), F.lit(1))
        best = numbered.where(((F.col("rk") - 1) % stride == 0) & ((F.col("rk") - 1) / stride < rules.keep))
    return best.select("frame", (F.col("cx") * 2).alias("x"), (F.col("cy") * 2).alias("y"), "s")


def windows(stars: DataFrame, tiles: DataFrame, size: int, reach: int) -> DataFrame:
    """stars (frame, x, y, ...) with px: (dy, dx, v) of all sites within `reach`, row after row; stars whose window isn't all there are left out."""
    tile = lambda c, d: F.floor((F.col(c) + d) / size).cast("long")
    asked = stars.withColumn("tx", F.explode(F.sequence(tile("x", -reach), tile("x", reach)))).withColumn("ty", F.explode(F.sequence(tile("y", -reach), tile("y", reach))))
    held = tiles.select("frame", F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), "plane")
    both = asked.join(held, ["frame", "tx", "ty"])
    low = lambda c, t: F.greatest(F.col(c) - reach, F.col(t) * size)
    high = lambda c, t: F.least(F.col(c) + reach, F.col(t) * size + size - 1)
    both = both.withColumn("b", F.struct(low("x", "tx").alias("x0"), high("x", "tx").alias("x1"), low("y", "ty").alias("y0"), high("y", "ty").alias("y1")))
    row = lambda y: F.transform(F.sequence(F.col("b.x0"), F.col("b.x1")), lambda x: F.struct((y - F.col("y")).cast("int").alias("dy"), (x - F.col("x")).cast("int").alias("dx"), F.get("plane", ((y - F.col("ty") * size) * size + x - F.col("tx") * size).cast("int")).alias("v")))
    part = F.flatten(F.transform(F.sequence(F.col("b.y0"), F.col("b.y1")), row))
    own = stars.columns
    cut = both.select(*own, part.alias("part")).groupBy("frame", "x", "y").agg(*[F.first(c).alias(c) for c in own if c not in ("frame", "x", "y")], F.array_sort(F.flatten(F.collect_list("part"))).alias("px"))
    return cut.where(F.size("px") == (2 * reach + 1) ** 2).where(~F.exists("px", lambda p: p["v"].isNull()))


def signals(cut: DataFrame, sky_of: DataFrame) -> DataFrame:
    """Windows with px: (dy, dx, cell, w), w being the signal in units of its site's noise."""
    value = lambda p, c: F.struct(p["dy"].alias("dy"), p["dx"].alias("dx"), c.alias("cell"), ((p["v"] - F.get("level", c)) / F.get("sigma", c)).alias("w"))
    joined = cut.join(sky_of, "frame")
    px = F.transform("px", lambda p: value(p, _cell(F.col("x") + p["dx"], F.col("y") + p["dy"]).cast("int")))
    return joined.withColumn("px", px).drop("level", "sigma")


def response(cut: DataFrame) -> DataFrame:
    """(frame, response): the four sites' median signal in the stars' cores over the median of the four, 1 where a site saw nothing."""
    core = F.filter("px", lambda p: (F.abs(p["dx"]) <= 1) & (F.abs(p["dy"]) <= 1))
    rows = cut.select("frame", F.explode(core).alias("p")).select("frame", F.col("p.cell").alias("cell"), F.greatest(F.col("p.w"), F.lit(0.0)).alias("w"))
    med = rank.median(rows, ["frame", "cell"], "w")
    four = med.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("cell", "med"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0.0)))
    middle = plane.bind(values, lambda v: F.transform(v, lambda x: F.when(x > 1e-3, x / F.greatest(plane.median(v), F.lit(1e-6))).otherwise(1.0)))
    return four.select("frame", middle.alias("response"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once for each row, however often, and within whatever loop, later ones read them."""
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("__o")
    return df.select("*", made).select(*kept, "__o.*")


def _sum(px: Column | str, value) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda s, p: s + value(p))


def measured(cut: DataFrame, rules: Rules = Rules(), aperture: Column | None = None) -> DataFrame:
    """Windows of signals with response, as (frame, x, y, cx, cy, flux, hfd, eccentricity, angle): centroid and flux of the core, the diameter of the circle with half the
    window's flux above the local sky, and the elongation of its second moments with its direction in degrees. Without flux a star has no row.

    `aperture` is the radius for the moments; by default two and a half times the half-flux radius."""
    col = F.col
    far = lambda p: F.sqrt((p["dx"] * p["dx"] + p["dy"] * p["dy"]).cast("double"))
    even = lambda p: F.struct(p["dy"].alias("dy"), p["dx"].alias("dx"), far(p).alias("r"), (p["w"] / F.greatest(F.get("response", p["cell"]), F.lit(1e-6))).alias("w"))
    s = _once(cut, px=F.transform("px", even))
    a, b, c = rules.sky
    ring = lambda lo, hi: F.transform(F.filter("px", lambda p: (p["r"] >= lo) & (p["r"] <= hi)), lambda p: p["w"])
    in_core = lambda p: (p["w"] > 0) & (p["r"] <= rules.core)
    s = _once(s, inner=plane.median(ring(a, b)), outer=plane.median(ring(b, c)), peak=F.greatest(F.array_max(F.transform("px", lambda p: p["w"])), F.lit(0.0)), raw=F.filter("px", in_core))
    local = F.when(col("inner") - col("outer") <= rules.flatness * F.greatest("peak", F.lit(1e-6)), col("outer")).otherwise(0.0)
    s = _once(s, local=local, flux=_sum("raw", lambda p: p["w"]), fx=_sum("raw", lambda p: p["w"] * p["dx"]), fy=_sum("raw", lambda p: p["w"] * p["dy"]))
    s = _once(s, px=F.transform("px", lambda p: p.withField("w", p["w"] - col("local"))))
    s = _once(s, core=F.filter("px", in_core), half=_sum("px", lambda p: p["w"]) / 2)
    s = _once(s, cw=_sum("core", lambda p: p["w"]), mx=_sum("core", lambda p: p["w"] * p["dx"]), my=_sum("core", lambda p: p["w"] * p["dy"])).where("cw > 0 AND half > 0")
    s = _once(s, ox=col("mx") / col("cw"), oy=col("my") / col("cw"))
    x, y = (lambda p: p["dx"] - col("ox")), (lambda p: p["dy"] - col("oy"))
    s = _once(s, radial=F.array_sort(F.transform("px", lambda p: F.struct(F.sqrt(x(p) * x(p) + y(p) * y(p)).alias("r"), p["dy"].alias("dy"), p["dx"].alias("dx"), p["w"].alias("w")))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("before"), F.lit(None).cast("double").alias("hfr"))

    def step(t: Column, p: Column) -> Column:
        here = t["before"] + (p["r"] - t["before"]) * F.least(F.greatest((col("half") - t["sum"]) / F.greatest(p["w"], F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
        reached = t["hfr"].isNull() & (t["sum"] + p["w"] >= col("half"))
        return F.struct((t["sum"] + p["w"]).alias("sum"), p["r"].alias("before"), F.when(reached, here).otherwise(t["hfr"]).alias("hfr"))

    s = _once(s, curve=F.aggregate("radial", start, step))
    s = _once(s, hfr=F.coalesce("curve.hfr", "curve.before"))
    s = _once(s, limit=F.least(F.greatest(2.5 * col("hfr") if aperture is None else aperture, F.lit(2.0)), F.lit(float(rules.window))))
    s = _once(s, source=F.filter("radial", lambda p: (p["w"] > 0) & (p["r"] <= col("limit"))))
    s = _once(s, **{k: _sum("source", f) for k, f in (("mw", lambda p: p["w"]), ("sxx", lambda p: p["w"] * x(p) * x(p)), ("syy", lambda p: p["w"] * y(p) * y(p)), ("sxy", lambda p: p["w"] * x(p) * y(p)))}).where("mw > 0")
    s = _once(s, xx=col("sxx") / col("mw"), yy=col("syy") / col("mw"), xy=col("sxy") / col("mw"))
    s = _once(s, spread=F.sqrt((col("xx") - col("yy")) * (col("xx") - col("yy")) + 4 * col("xy") * col("xy")))
    major, minor = (col("xx") + col("yy") + col("spread")) / 2, F.greatest((col("xx") + col("yy") - col("spread")) / 2, F.lit(0.0))
    eccentricity = F.sqrt(F.least(F.greatest(1 - minor / F.greatest(major, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)))
    angle = F.degrees(F.atan2(2 * col("xy"), col("xx") - col("yy"))) / 2
    return s.select("frame", "x", "y", (col("x") + col("fx") / col("flux")).alias("cx"), (col("y") + col("fy") / col("flux")).alias("cy"), "flux", (2 * col("hfr")).alias("hfd"), eccentricity.alias("eccentricity"), angle.alias("angle"))


def frame_metrics(stars: DataFrame, least: int) -> DataFrame:
    """(frame, n, hfd, eccentricity, angle) of frames with `least` measured stars: medians, and the mean direction weighted by elongation (0 to 180 degrees, as 179 and -1 are
    one direction)."""
    twice = F.radians(2 * F.col("angle"))
    by = stars.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("eccentricity") * F.cos(twice)).alias("c"), F.sum(F.col("eccentricity") * F.sin(twice)).alias("s")).where(F.col("n") >= least)
    half = F.degrees(F.atan2("s", "c")) / 2
    med = lambda c: rank.median(stars, ["frame"], c, c).drop("n")
    return by.join(med("hfd"), "frame").join(med("eccentricity"), "frame").select("frame", "n", "hfd", "eccentricity", F.when(half < 0, half + 180).otherwise(half).alias("angle"))


def burst_aperture(metrics: DataFrame, frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(aperture), one row: a quarter more than the frames' median half-flux diameter, so that all are judged through one window; null where fewer than three frames, or than
    three in four, have been measured."""
    n = frames.select("frame").distinct().agg(F.count(F.lit(1)).alias("frames"))  # one row
    med = rank.median(metrics.where("hfd > 0").withColumn("all", F.lit(1)), ["all"], "hfd")
    enough = (F.col("n") * 4 >= F.col("frames") * 3) & (F.col("n") >= 3)
    return n.join(F.broadcast(med), how="left").select(F.when(enough, F.least(F.greatest(1.25 * F.col("med"), F.lit(2.0)), F.lit(float(rules.window)))).alias("aperture"))
