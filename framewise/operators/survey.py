"""Judging frames against their own group: survey flags, sharpness from stars, confidence of registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE, clamp
from . import rank

LEAST_GROUP, SOFT, FEW_STARS, LEAST_TYPICAL = 5, 0.75, 0.5, 10


def elongation_threshold(typical: Column) -> Column:
    return F.greatest(typical + 0.15, F.lit(0.35))


def flag_frames(frames: DataFrame, group: str) -> DataFrame:
    """frames (group, sharpness, eccentricity, stars, error; all but group may be null) with `relative` (sharpness over the median of the
    group's frames that were measured alike) and `flags`, in the order elongated, few-stars, no-stars, soft, unreadable.

    Where three quarters of a group's readable frames have stars, it is judged by them; frames without are named then. Groups of
    fewer than five readable frames are not judged. A frame with an error is unreadable and counts in no median."""
    ok = F.col("error").isNull()
    has = F.col("stars").isNotNull()
    sizes = frames.where(ok).groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.count("stars").alias("__starred"))
    sizes = sizes.withColumn("__by_stars", F.col("__starred") * 4 >= F.col("__n") * 3)
    alike = frames.where(ok).join(sizes, group).where(has == F.col("__by_stars"))
    typical = rank.median(alike, [group], "sharpness", "__sharp").withColumnRenamed("n", "__measured")
    starred = frames.where(ok & has)
    ecc = rank.median(starred, [group], "eccentricity", "__ecc").drop("n")
    count = rank.median(starred, [group], "stars", "__count").drop("n")
    known = sizes.join(typical, group, "left").join(ecc, group, "left").join(count, group, "left")
    out = frames.join(known, group, "left")
    relative = F.when(ok & (has == F.col("__by_stars")) & (F.col("__sharp") > 0), F.col("sharpness") / F.col("__sharp"))
    out = out.withColumn("relative", relative)
    judged = ok & (F.col("__n") >= LEAST_GROUP) & (F.coalesce("__measured", F.lit(0)) > 0)
    seen = F.col("eccentricity").isNotNull() & has
    flags = [
        ("elongated", judged & F.col("__by_stars") & seen & (F.col("eccentricity") > elongation_threshold(F.col("__ecc")))),
        ("few-stars", judged & F.col("__by_stars") & seen & (F.col("__count") >= LEAST_TYPICAL) & (F.col("stars") < FEW_STARS * F.col("__count"))),
        ("no-stars", judged & F.col("__by_stars") & ~seen),
        ("soft", judged & (F.col("relative") < SOFT)),
        ("unreadable", ~ok),
    ]
    named = F.array_compact(F.array(*[F.when(c, name) for name, c in flags]))
    return out.select(*frames.columns, "relative", named.alias("flags"))


def star_sharpness(frames: DataFrame, group: str) -> DataFrame:
    """frames (group, sharpness, hfd) with sharpness replaced by the median half-flux diameter over the frame's own, where at least three
    and three quarters of the group's frames have one; those without get 0.9 of the worst. `by_stars` says whether that was done."""
    measured = F.when(F.col("hfd") > 0, F.col("hfd"))
    sizes = frames.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.count(measured).alias("__m"), F.max(measured).alias("__worst"))
    med = rank.median(frames.where("hfd > 0"), [group], "hfd", "__med").drop("n")
    out = frames.join(sizes.join(med, group, "left"), group)
    by_stars = (F.col("__m") * 4 >= F.col("__n") * 3) & (F.col("__m") >= 3)
    med = F.greatest("__med", F.lit(1e-6))
    value = F.when(~by_stars, F.col("sharpness")).when(F.col("hfd") > 0, med / F.col("hfd")).otherwise(0.9 * med / F.greatest("__worst", F.lit(1e-6)))
    return out.select(*[c for c in frames.columns if c != "sharpness"], value.alias("sharpness"), by_stars.alias("by_stars"))


def agreement(agreeing: Column, measured: Column, enough: int = 20) -> Column:
    """The share of what was measured that agrees, held down where little was measured."""
    share = F.least(agreeing / measured, F.lit(1.0)) * F.least(measured / enough, F.lit(1.0))
    return F.when(measured > 0, share).otherwise(0.0)


def normalised_confidence(regs: DataFrame, group: str) -> DataFrame:
    """regs (group, probes, residual, inliers, measured, overlap) with `confidence`: agreement times overlap, divided by one plus the excess
    of the residual over the group's median in three spreads; null without probes, or in a group of fewer than four residuals."""
    of = regs.where((F.col("probes") > 0) & F.col("residual").isNotNull() & ~F.isnan("residual"))
    known = rank.median_mad(of, [group], "residual").join(of.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), group).where("__n >= 4")
    out = regs.join(known, group, "left")
    spread = F.greatest(F.col("mad") * MAD_SCALE, 0.15 * F.col("med"), F.lit(1e-4))
    excess = F.greatest((F.col("residual") - F.col("med")) / (3 * spread), F.lit(0.0))
    value = clamp(agreement(F.col("inliers"), F.col("measured")) / (1 + excess) * F.col("overlap"), 0.0, 1.0)
    return out.select(*regs.columns, F.when((F.col("probes") > 0) & F.col("__n").isNotNull(), value).alias("confidence"))
