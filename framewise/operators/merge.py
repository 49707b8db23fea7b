"""Weighted merges of samples onto a finer grid, and the robustness weights of frames that disagree with the others.

Weights are whole millionths, so every sum is one of integers: the same over any split of the input, and after a lost executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE, clamp
from . import rank

MILLION = 1_000_000


def moments(samples: DataFrame, cell: list[str], w: Column, dx: Column, dy: Column, v: Column, clipped: Column) -> DataFrame:
    """(cell, the nine sums of w times 1, dx, dy, dx dx, dx dy, dy dy, v, v dx, v dy, low, high, clipped): partial sums of a plane fit."""
    sums = {"w": w, "wx": w * dx, "wy": w * dy, "wxx": w * dx * dx, "wxy": w * dx * dy, "wyy": w * dy * dy, "wv": w * v, "wvx": w * v * dx, "wvy": w * v * dy}
    return samples.groupBy(*cell).agg(*[F.sum(e).alias(n) for n, e in sums.items()], F.min(v).alias("low"), F.max(v).alias("high"), F.bool_or(clipped).alias("clipped"))


def add_moments(a: DataFrame, b: DataFrame, cell: list[str]) -> DataFrame:
    """Moments of two splits of the samples, added up."""
    how = {"low": F.min, "high": F.max, "clipped": F.bool_or}
    return a.unionByName(b).groupBy(*cell).agg(*[how.get(c, F.sum)(c).alias(c) for c in a.columns if c not in cell])


def footprint(samples: DataFrame, scale: int, reach: int, sigma: float) -> DataFrame:
    """samples (x, y in input pixels, any fraction) once for each output pixel within `reach` of them: ox, oy, and `kernel`, a Gaussian of
    the distance in millionths."""
    at = lambda c: (F.col(c) + 0.5) * scale - 0.5
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    s = samples.withColumn("__u", at("x")).withColumn("__v", at("y")).withColumn("__d", F.explode(near))
    s = s.withColumn("ox", F.floor(F.col("__u") + 0.5) + F.col("__d.i")).withColumn("oy", F.floor(F.col("__v") + 0.5) + F.col("__d.j"))
    far = (F.col("__u") - F.col("ox")) * (F.col("__u") - F.col("ox")) + (F.col("__v") - F.col("oy")) * (F.col("__v") - F.col("oy"))
    return s.withColumn("kernel", F.floor(F.exp(-far / (2 * sigma * sigma)) * MILLION + 0.5).cast("long")).where("kernel > 0").drop("__u", "__v", "__d")


def deposit(samples: DataFrame, weight: Column, value: str, scale: int = 2, reach: int = 1, sigma: float = 0.6, keep: list[str] | None = None) -> DataFrame:
    """(keep, ox, oy, sum_w, sum_wv, n): each sample spread over its footprint; weight (0 to 1) is noise, robustness and frame weight in one."""
    keep = keep or []
    w = F.floor(F.col("kernel") * weight + 0.5).cast("long")
    spread = footprint(samples, scale, reach, sigma).withColumn("__w", w).where("__w > 0")
    return spread.groupBy(*keep, "ox", "oy").agg(F.sum("__w").alias("sum_w"), F.sum(F.col("__w") * F.col(value)).alias("sum_wv"), F.count(F.lit(1)).alias("n"))


def effective_frames(deposits: DataFrame, frame: str, block: int = 8) -> DataFrame:
    """(bx, by, frames, effective) of rows (frame, ox, oy, sum_w): (sum d)^2 / sum d^2 of what each frame gave to a block."""
    part = lambda c: F.floor(F.col(c) / block)
    each = deposits.groupBy(frame, part("ox").alias("bx"), part("oy").alias("by")).agg(F.sum("sum_w").cast("double").alias("d"))
    return each.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("frames"), (F.sum("d") * F.sum("d") / F.sum(F.col("d") * F.col("d"))).alias("effective"))


def others(means: DataFrame, site: list[str]) -> DataFrame:
    """means (frame, site, s, n: sums of whole values and their number) with `own`, `rest` (the mean of the other frames' means there, null
    if there is none) and `seen` (frames at the site)."""
    micro = means.withColumn("own", F.floor(F.col("s") * MILLION / F.col("n") + 0.5).cast("long"))
    sums = micro.groupBy(*site).agg(F.sum("own").alias("__all"), F.count(F.lit(1)).alias("seen"))
    return micro.join(sums, site).withColumn("rest", F.when(F.col("seen") > 1, F.floor((F.col("__all") - F.col("own")) / (F.col("seen") - 1) + 0.5).cast("long"))).drop("__all")


def smooth_decision(r: Column, reject: float) -> Column:
    """0 up to `reject`, 1 from twice that, and a smooth ramp between."""
    low, high = reject, min(2 * reject, 1.0)
    t = (r - low) / max(high - low, 1e-6)
    return F.when(r <= low, 0.0).when(r >= high, 1.0).otherwise(t * t * (3 - 2 * t))


def robustness(compared: DataFrame, frame: str, site: list[str], channel: str, stride: Column, alpha: float, beta: float, misplaced: float = 0.0, floor: float = 0.002, strength: float = 12.0, threshold: float = 0.12, reject: float = 0.25, samples: int = 9, cap: float = 3.0) -> DataFrame:
    """(frame, site, weight: 0 to 255) of others()' rows by (frame, site, channel): how well a frame agrees with the others at a site.

    The tolerance is the noise of a local mean, what a misplaced gradient makes, and a floor; a frame that disagrees a little everywhere
    (its median over the sites where stride holds) gets a wider one, up to `cap` times. The worst channel decides. Where no other frame
    looked, the sample stays: 255."""
    own = (F.abs(F.col("own") - F.col("rest"))).alias("d")
    typical = rank.median(compared.where(stride & F.col("rest").isNotNull()).select(frame, channel, own), [frame, channel], "d", "__typical").drop("n")
    c = compared.join(typical, [frame, channel], "left")
    level = F.col("rest") / MILLION
    expected = F.greatest(alpha * F.greatest(level, F.lit(0.0)) + beta, F.lit(1e-12)) / samples + misplaced * misplaced + floor * floor
    wide = F.least(MAD_SCALE * F.coalesce("__typical", F.lit(0.0)) / MILLION, cap * F.sqrt(expected))
    sigma2 = F.greatest(expected, wide * wide)
    d = (F.col("own") - F.col("rest")) / MILLION
    r = clamp(strength * F.exp(-(d * d) / sigma2) - threshold, 0.0, 1.0)
    worst = c.groupBy(frame, *site).agg(F.min(r).alias("r"), F.min("seen").alias("seen"))
    return worst.select(frame, *site, F.when(F.col("seen") < 2, 255).otherwise(F.floor(smooth_decision(F.col("r"), reject) * 255 + 0.5)).cast("int").alias("weight"))


def combine_grids(parts: DataFrame, grid: str, cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sums, refused) of partial sums (grid, cell, ...): those of the grid with the most rows (ties: the smallest name) added up by cell,
    and the number of rows of each other grid, which must not be mixed in."""
    sizes = parts.groupBy(grid).agg(F.count(F.lit(1)).alias("rows"))
    best = sizes.orderBy(F.desc("rows"), grid).limit(1).select(F.col(grid).alias("__best"))
    own = parts.join(F.broadcast(best), F.col(grid) == F.col("__best")).drop("__best")  # one row
    sums = own.groupBy(grid, *cell).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in (grid, *cell)])
    return sums, sizes.join(F.broadcast(best), F.col(grid) != F.col("__best")).drop("__best")
