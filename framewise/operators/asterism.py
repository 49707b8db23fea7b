"""Star catalogues matched by the shapes of triangles, and the simplest transform that explains given pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import tiles as plane
from . import selection

BRIGHTEST, TOLERANCE, SCALE_LIMIT, BIN, LEAST_VOTES = 14, 0.004, 1.25, 1.0, 4


def triangles(stars: DataFrame, brightest: int = BRIGHTEST) -> DataFrame:
    """(frame, p, q, long, ax, ay, bx, by, cx, cy) of the triangles of each frame's brightest stars (frame, id, x, y, flux): the corners
    opposite the longest, the middle and the shortest side, and the other sides' lengths over the longest. Flat and near-isosceles
    triangles, whose corners noise would swap, are left out."""
    top = selection.top_of_region(stars, ["frame"], "flux", "id", brightest)
    packed = top.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("rk", "x", "y"))).alias("s"))  # `brightest` rows at most
    for k in "ijk":
        packed = packed.withColumn(k, F.explode(F.sequence(F.lit(1), F.size("s"))))
    t = packed.where("i < j AND j < k").select("frame", *[F.element_at("s", F.col(k)).alias(f"s{k}") for k in "ijk"])
    far = lambda a, b: F.sqrt((F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")) + (F.col(f"{a}.y") - F.col(f"{b}.y")) * (F.col(f"{a}.y") - F.col(f"{b}.y")))
    sides = F.reverse(F.array_sort(F.array(*[F.struct(far(a, b).alias("d"), F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")) for a, b, c in (("sj", "sk", "si"), ("si", "sk", "sj"), ("si", "sj", "sk"))])))
    t = t.select("frame", F.explode(F.array(sides)).alias("v"))  # computed once, not for each of the columns below
    at = lambda i, c: F.element_at("v", i)[c]
    t = t.select("frame", at(1, "d").alias("long"), (at(2, "d") / at(1, "d")).alias("p"), (at(3, "d") / at(1, "d")).alias("q"), *[at(i + 1, c).alias(n + c) for i, n in enumerate("abc") for c in "xy"])
    return t.where((F.col("long") > 0) & (F.col("p") < 0.98) & (F.col("q") > 0.1) & (F.col("p") - F.col("q") > 0.02))


def match(reference: DataFrame, targets: DataFrame, brightest: int = BRIGHTEST) -> DataFrame:
    """(frame, votes, transform) from each target frame's pixels to the reference's (frame, id, x, y, flux; one frame).

    Triangles of like shape meet by cells of their two side ratios and vote for a rotation. The fullest three neighbouring bins win; the medians of
    their votes give rotation, scale and shift, as coincidences are among them. Frames with fewer than four such votes have no row."""
    cell = lambda c: F.floor(F.col(c) / TOLERANCE)
    names = ["long", "p", "q", "ax", "ay", "bx", "by", "cx", "cy"]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    ref = triangles(reference, brightest).select(*[F.col(n).alias("r_" + n) for n in names], near.alias("d"))
    ref = ref.withColumn("u", F.floor(F.col("r_p") / TOLERANCE) + F.col("d.i")).withColumn("v", F.floor(F.col("r_q") / TOLERANCE) + F.col("d.j")).drop("d")
    tri = triangles(targets, brightest).withColumn("u", cell("p")).withColumn("v", cell("q"))
    scale = F.col("r_long") / F.col("long")
    both = tri.join(ref, ["u", "v"]).where((F.abs(F.col("p") - F.col("r_p")) <= TOLERANCE) & (F.abs(F.col("q") - F.col("r_q")) <= TOLERANCE) & scale.between(1 / SCALE_LIMIT, SCALE_LIMIT))
    turn = F.degrees(F.atan2(F.col("r_cy") - F.col("r_by"), F.col("r_cx") - F.col("r_bx")) - F.atan2(F.col("cy") - F.col("by"), F.col("cx") - F.col("bx")))
    votes = both.withColumn("scale", scale).withColumn("deg", turn - 360 * F.floor(turn / 360)).withColumn("bin", (F.floor(F.col("deg") / BIN) % int(360 / BIN)).cast("int"))
    bins = votes.groupBy("frame", "bin").agg(F.count(F.lit(1)).alias("n")).select("frame", "n", F.explode(F.array(*[F.pmod(F.col("bin") + k, F.lit(int(360 / BIN))) for k in (-1, 0, 1)])).alias("best"))
    best = bins.groupBy("frame", "best").agg(F.sum("n").alias("votes")).groupBy("frame").agg(F.max(F.struct("votes", (-F.col("best")).alias("less"))).alias("m"))
    best = best.select("frame", "m.votes", (-F.col("m.less")).alias("best")).where(F.col("votes") >= LEAST_VOTES)
    mode = votes.join(best, "frame").where(F.pmod(F.col("bin") - F.col("best") + 1, F.lit(int(360 / BIN))) <= 2)
    turned = (F.pmod(F.col("deg") - F.col("best") * BIN + 180, F.lit(360.0)) - 180).alias("turned")
    corners = F.array(*[F.struct(*[F.col(k + c).alias(n) for k, c, n in (("r_", f"{v}x", "rx"), ("r_", f"{v}y", "ry"), ("", f"{v}x", "x"), ("", f"{v}y", "y"))]) for v in "abc"]).alias("corners")
    # A frame has at most (brightest choose 3)^2 votes.
    packed = mode.groupBy("frame", "votes", "best").agg(F.collect_list(F.struct(turned, "scale", corners)).alias("m"))
    once = lambda df, *columns: df.select("*", F.explode(F.array(F.struct(*columns))).alias("__o")).select(*df.columns, "__o.*")
    theta = F.radians(F.col("best") * BIN + plane.median(F.transform("m", lambda v: v["turned"]))).alias("theta")
    mid = once(packed, theta, plane.median(F.transform("m", lambda v: v["scale"])).alias("size"))
    mid = once(mid, (F.col("size") * F.sin("theta")).alias("sn"), (F.col("size") * F.cos("theta")).alias("cs"), F.flatten(F.transform("m", lambda v: v["corners"])).alias("all"))
    dx = plane.median(F.transform("all", lambda c: c["rx"] - (F.col("cs") * c["x"] - F.col("sn") * c["y"]))).alias("dx")
    dy = plane.median(F.transform("all", lambda c: c["ry"] - (F.col("sn") * c["x"] + F.col("cs") * c["y"]))).alias("dy")
    mid = once(mid, dx, dy)
    return mid.select("frame", "votes", geo.similarity(F.col("theta"), F.col("size"), F.col("dx"), F.col("dy")).alias("transform"))


def simplest_fit(pairs: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """(by, model, rms, transform) of pairs (by, x, y, u, v): the first of translation, euclidean, similarity and affine, each by least squares,
    whose root mean square residual is within `tolerance` of the best one's. Sums by group, and one pass for the residuals of all four: a group's
    fits are one row, which meets its pairs by sorting, as files tell nothing of how many there are. Pairs at one point have a translation only."""
    x, y, u, v = (F.col(c) for c in "xyuv")
    m = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m" + c) for c in "xyuv"], *[F.covar_pop(p, q).alias(p + q) for p, q in ("xx", "yy", "xy", "xu", "xv", "yu", "yv")])
    c = {k: F.col(k) for k in ("xx", "yy", "xy", "xu", "xv", "yu", "yv")}
    size = c["xx"] + c["yy"]
    a, b = F.when(size > 1e-12, (c["xu"] + c["yv"]) / size), F.when(size > 1e-12, (c["xv"] - c["yu"]) / size)
    unit = F.sqrt(a * a + b * b)
    det = c["xx"] * c["yy"] - c["xy"] * c["xy"]

    def about_means(p: Column, q: Column, r: Column, s: Column) -> Column:
        return geo.affine(p, q, F.col("mu") - p * F.col("mx") - q * F.col("my"), r, s, F.col("mv") - r * F.col("mx") - s * F.col("my"))

    one, zero = F.lit(1.0), F.lit(0.0)
    ladder = [
        ("translation", about_means(one, zero, zero, one)),
        ("euclidean", F.when(unit > 1e-12, about_means(a / unit, -b / unit, b / unit, a / unit))),
        ("similarity", F.when(size > 1e-12, about_means(a, -b, b, a))),
        ("affine", F.when(F.abs(det) > 1e-12, about_means((c["xu"] * c["yy"] - c["yu"] * c["xy"]) / det, (c["yu"] * c["xx"] - c["xu"] * c["xy"]) / det, (c["xv"] * c["yy"] - c["yv"] * c["xy"]) / det, (c["yv"] * c["xx"] - c["xv"] * c["xy"]) / det))),
    ]
    fits = m.select(*by, F.array(*[F.struct(F.lit(name).alias("model"), t.alias("t")) for name, t in ladder]).alias("fits"))

    def far(i: int) -> Column:
        px, py = geo.apply(F.col("fits")[i]["t"], x, y)
        return (px - u) * (px - u) + (py - v) * (py - v)

    rest = pairs.join(fits.hint("merge"), by).groupBy(*by).agg(F.first("fits").alias("fits"), F.array(*[F.sqrt(F.avg(far(i))) for i in range(len(ladder))]).alias("rms"))
    tried = F.zip_with("fits", "rms", lambda f, r: F.struct(f["model"].alias("model"), r.alias("rms"), f["t"].alias("transform")))
    good = rest.withColumn("least", F.array_min("rms")).withColumn("tried", tried).where("least IS NOT NULL")
    return good.select(*by, F.filter("tried", lambda f: f["rms"] <= F.col("least") + tolerance)[0].alias("__g")).select(*by, "__g.model", "__g.rms", "__g.transform")
