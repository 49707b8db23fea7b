"""Robust lines and planes by groups: a fixed number of reweighted least-squares passes, each two aggregations.

A pass needs five sums by group and the median absolute residual, taken from counts; coefficients and scale are one row for each group,
are written to the shared folder and join the data again, which is read anew each time. No group is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.robust import MAD_SCALE, tukey_weight
from ..sources.shared import materialize
from . import rank


def robust_line(df: DataFrame, group: list[str], x: str, y: str, passes: int = 3, cut: float = 4.0, floor: float = 1e-9, least: int = 8) -> DataFrame:
    """(group, gain, shift, n) of y = gain * x + shift; residuals beyond `cut` scaled deviations weigh nothing. Groups of fewer than
    `least` pairs, or without spread in x, have no row."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    weighted = pairs.withColumn("__w", F.lit(1.0))
    for i in range(passes):
        w, u, v = F.col("__w"), F.col("__x"), F.col("__y")
        s = weighted.groupBy(*group).agg(F.sum(w).alias("s"), F.sum(w * u).alias("sx"), F.sum(w * v).alias("sy"), F.sum(w * u * u).alias("sxx"), F.sum(w * u * v).alias("sxy"), F.count(F.lit(1)).alias("n"))
        det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
        gain = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
        fit = s.where((F.col("n") >= least) & (F.abs(det) > 1e-18)).select(*group, gain.alias("gain"), ((F.col("sy") - gain * F.col("sx")) / F.col("s")).alias("shift"), "n")
        if i == passes - 1:
            return fit
        fit = materialize(fit.drop("n"), "line")
        off = F.col("__y") - F.col("gain") * F.col("__x") - F.col("shift")
        med = rank.median_of_many(pairs.join(fit, group).select(*group, F.abs(off).alias("__r")), group, "__r")
        fit = materialize(fit.join(med, group).withColumn("__k", F.greatest(cut * MAD_SCALE * F.col("med"), F.lit(floor))), "scale")
        weighted = pairs.join(fit, group).withColumn("__w", tukey_weight(off, F.col("__k"))).select(*group, "__x", "__y", "__w")
    raise ValueError("at least one pass")


def plane_at_centre(m: DataFrame, key: list[str]) -> DataFrame:
    """(key, value, how) from moments sw, sx, sy, sxx, sxy, syy, sv, sxv, syv about each cell's centre: the weighted plane's value there,
    or the mean where the samples lie too far off or in a line, or nothing where there are none."""
    s = F.col("sw")
    mx, my, mv = F.col("sx") / s, F.col("sy") / s, F.col("sv") / s
    xx, yy, xy = F.col("sxx") / s - mx * mx, F.col("syy") / s - my * my, F.col("sxy") / s - mx * my
    xv, yv = F.col("sxv") / s - mx * mv, F.col("syv") / s - my * mv
    det = xx * yy - xy * xy
    bent = det < 0.05 * (xx + yy) * (xx + yy) / 4
    plane = mv - ((yy * xv - xy * yv) / det) * mx - ((xx * yv - xy * xv) / det) * my
    how = F.when(s <= 0, "empty").when(F.sqrt(mx * mx + my * my) > 0.6, "far").when(bent, "line").otherwise("plane")
    out = m.select(*key, how.alias("how"), mv.alias("__m"), plane.alias("__p"))
    return out.select(*key, F.when(F.col("how") == "plane", F.col("__p")).when(F.col("how") != "empty", F.col("__m")).alias("value"), "how")
