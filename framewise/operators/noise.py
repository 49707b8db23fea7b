"""Noise models var = alpha * level + beta from block statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tiles import bind
from . import rank

LEAST_BLOCKS, LEAST_IN_BIN, LEAST_BINS = 32, 8, 3


def lower_envelope(blocks: DataFrame, group: list[str], mean: str, var: str, percentile: float, bins: int = 24) -> DataFrame:
    """(group, alpha, beta, blocks) fitted to a low rank of the variance in each of `bins` bins of the mean.

    A block on an edge varies far more than the noise, so a bin counts with the rank `percentile` of its variances, bins with fewer than 8
    blocks don't count, and three passes weigh down bins above the line. Groups of fewer than 32 blocks or 3 bins have no row. A group
    sends at most `bins` rows to the fit, whatever its size."""
    m = F.col(mean)
    range_ = blocks.groupBy(*group).agg(F.min(m).alias("__lo"), F.max(m).alias("__hi"), F.count(F.lit(1)).alias("blocks"))
    range_ = range_.where((F.col("blocks") >= LEAST_BLOCKS) & (F.col("__hi") > F.col("__lo")))
    placed = blocks.join(range_, group).withColumn("bin", F.floor((m - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (bins - 1) + 0.5))
    low = rank.rank_select(placed, [*group, "bin"], var, {"y": rank.round_rank(percentile), "n_": F.lit(0)}).drop("n_")
    sizes = placed.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") >= LEAST_IN_BIN)
    points = low.join(sizes, [*group, "bin"]).join(range_, group)
    x = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("bin") / (bins - 1))
    packed = points.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("bin", x.alias("x"), "y", F.col("w").cast("double").alias("w")))).alias("p"), F.first("blocks").alias("blocks"))  # `bins` at most
    fitted = packed.where(F.size("p") >= LEAST_BINS).select(*group, "blocks", line(F.col("p")).alias("f"))
    return fitted.where(F.col("f.alpha").isNotNull()).select(*group, F.greatest("f.alpha", F.lit(0.0)).alias("alpha"), F.greatest("f.beta", F.lit(1e-10)).alias("beta"), "blocks")


def line(points: Column, passes: int = 3) -> Column:
    """Struct (alpha, beta) of an array of (x, y, w): least squares, then passes with less weight on what lies above the line."""
    def total(p: Column, f) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, q: s + f(q))

    def fit(p: Column, own: str) -> Column:
        sums = {"s": lambda q: q[own], "sx": lambda q: q[own] * q["x"], "sy": lambda q: q[own] * q["y"], "sxx": lambda q: q[own] * q["x"] * q["x"], "sxy": lambda q: q[own] * q["x"] * q["y"]}

        def solve(t: Column) -> Column:
            den = t["s"] * t["sxx"] - t["sx"] * t["sx"]
            alpha = F.when(F.abs(den) >= 1e-18, (t["s"] * t["sxy"] - t["sx"] * t["sy"]) / den)
            return F.struct(alpha.alias("alpha"), ((t["sy"] - alpha * t["sx"]) / t["s"]).alias("beta"))

        return bind(F.struct(*[total(p, f).alias(n) for n, f in sums.items()]), solve)

    def weigh(p: Column, f: Column) -> Column:
        def one(q: Column) -> Column:
            guess = f["alpha"] * q["x"] + f["beta"]
            r = q["y"] - guess
            own = F.when(r > 0, q["w"] / (1 + 4 * (r / F.greatest(F.abs(guess), F.lit(1e-9))))).otherwise(q["w"])
            return F.struct(q["x"].alias("x"), q["y"].alias("y"), q["w"].alias("w"), own.alias("own"))

        return F.transform(p, one)

    state = F.struct(points.alias("p"), fit(points, "w").alias("f"))
    for _ in range(passes - 1):
        state = bind(state, lambda s: bind(weigh(s["p"], s["f"]), lambda p: F.struct(s["p"].alias("p"), fit(p, "own").alias("f"))))
    return state["f"]


def nominal(iso: Column, levels: Column) -> tuple[Column, Column]:
    """(alpha, beta) when nothing was measured: shot noise by the gain, and two levels of read noise at base gain."""
    gain, span = F.greatest(iso / 100, F.lit(1.0)), F.greatest(levels, F.lit(1.0))
    alpha = 1 / (span * F.greatest(1 / gain, F.lit(1e-3)))
    read = 2 * F.sqrt(gain) / span
    return alpha, read * read


def variance(level: Column, alpha: Column, beta: Column) -> Column:
    return F.greatest(alpha * F.greatest(level, F.lit(0.0)) + beta, F.lit(1e-12))


def first_model(groups: DataFrame, group: list[str], models: list[tuple[str, DataFrame]], otherwise: tuple[Column, Column]) -> DataFrame:
    """(group, source, alpha, beta): the first of the named models that has the group, else the nominal values."""
    out, names = groups.select(*group).distinct(), []
    for i, (name, m) in enumerate(models):
        out = out.join(m.select(*group, F.struct(F.lit(name).alias("source"), "alpha", "beta").alias(f"__m{i}")), group, "left")
        names.append(f"__m{i}")
    last = F.struct(F.lit("nominal").alias("source"), otherwise[0].alias("alpha"), otherwise[1].alias("beta"))
    return out.select(*group, F.coalesce(*names, last).alias("m")).select(*group, "m.source", "m.alpha", "m.beta")
