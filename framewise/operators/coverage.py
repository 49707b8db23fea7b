"""Sub-pixel phases: circular means, the phases that a set of frames distinguishes, and their spread over the plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mean_phases(samples: DataFrame, by: list[str], phase: str) -> DataFrame:
    """(by, phase, concentration): the circular mean in [0, 1) of phases in [0, 1), null where they cancel, and how alike they are (0 to 1)."""
    a = 2 * F.pi() * F.col(phase)
    m = samples.groupBy(*by).agg(F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    turn = F.atan2("s", "c") / (2 * F.pi())
    there = (F.abs("c") >= 1e-12) | (F.abs("s") >= 1e-12)
    return m.select(*by, F.when(there, turn - F.floor(turn)).alias("phase"), F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")).alias("concentration"))


def effective_phases(phases: DataFrame, by: list[str], cells: int = 1024) -> DataFrame:
    """(by, frames, effective) of rows (by, phase): one over the largest gap around the circle, between 1 and the number of phases.

    Gaps are taken within cells of the circle and between neighbouring cells that aren't empty, so that a group's phases are never
    sorted in one task."""
    p = phases.where("phase IS NOT NULL").withColumn("__cell", F.least(F.floor(F.col("phase") * cells), F.lit(cells - 1)))
    inner = p.withColumn("__gap", F.lead("phase").over(Window.partitionBy(*by, "__cell").orderBy("phase")) - F.col("phase"))
    inner = inner.groupBy(*by, "__cell").agg(F.max("__gap").alias("gap"), F.min("phase").alias("lo"), F.max("phase").alias("hi"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("__cell")
    between = inner.withColumn("next", F.lead("lo").over(w) - F.col("hi"))  # at most `cells` rows a group
    g = between.groupBy(*by).agg(F.max(F.greatest("gap", "next")).alias("gap"), (F.min("lo") + 1 - F.max("hi")).alias("wrap"), F.sum("n").alias("frames"))
    gap = F.greatest(F.coalesce("gap", F.lit(0.0)), "wrap")
    return g.select(*by, "frames", F.when(gap <= 1e-6, F.col("frames").cast("double")).otherwise(F.least(F.greatest(1 / gap, F.lit(1.0)), F.col("frames").cast("double"))).alias("effective"))


def phase_coverage(samples: DataFrame, by: list[str], x_phase: str, y_phase: str, bins: int = 4) -> DataFrame:
    """(by, samples, phases): the exponential of the entropy of the phases' bins, each axis in `bins`."""
    bin_of = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    counts = samples.groupBy(*by, (bin_of(y_phase) * bins + bin_of(x_phase)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy(*by).agg(F.sum("n").alias("samples"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    return packed.select(*by, "samples", F.exp(F.ln("samples") - F.col("nln") / F.col("samples")).alias("phases"))
