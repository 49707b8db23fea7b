"""Cumulative analytics of ordered groups.

Running values are taken in two levels: within coarse steps of the order (a day, say), each a window of its own, and over the
steps' totals. So a group that holds a third of all rows is read by as many tasks as it has steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rank


def running(df: DataFrame, group: list[str], step: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with each named running sum over its group's rows up to its own, in (step, order); step is coarser than order."""
    local = Window.partitionBy(*group, step).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.select("*", *[x.alias(f"__x_{n}") for n, x in sums.items()])
    totals = inner.groupBy(*group, step).agg(*[F.sum(f"__x_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, step, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    out = inner.select("*", *[F.sum(f"__x_{n}").over(local).alias(f"__l_{n}") for n in sums]).join(totals, [*group, step])
    return out.select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, group: list[str], step: str, order: list[str], name: str = "n") -> DataFrame:
    """df with each row's place in its group, from 1."""
    return running(df, group, step, order, {name: F.lit(1)})


def split_curve(df: DataFrame, group: list[str], step: str, order: list[str], value: str) -> DataFrame:
    """df with n, run_sum and split_sum: values with odd places less those with even ones."""
    placed = numbered(df, group, step, order)
    return running(placed, group, step, order, {"run_sum": F.col(value), "split_sum": F.when(F.col("n") % 2 == 1, F.col(value)).otherwise(-F.col(value))})


def checkpoints(limit: int = 1 << 40) -> list[int]:
    """4, then each 5/4 of the one before, rounded up to an even number: about ten for each factor of ten."""
    out = [4]
    while out[-1] < limit:
        n = -(-out[-1] * 5 // 4)
        out.append(n + n % 2)
    return out


def power_law(points: DataFrame, group: list[str], n: str, noise: str) -> DataFrame:
    """(group, exponent, amplitude, r2) of noise = amplitude * n ^ exponent, where the points suffice."""
    p = points.where(F.col(noise) > 0).select(*group, F.col(n).alias("__n"), F.ln(n).alias("__x"), F.ln(noise).alias("__y"))
    fit = p.groupBy(*group).agg(
        F.regr_slope("__y", "__x").alias("exponent"), F.exp(F.regr_intercept("__y", "__x")).alias("amplitude"), F.regr_r2("__y", "__x").alias("r2"),
        F.count(F.lit(1)).alias("__c"), F.min("__n").alias("__lo"), F.max("__n").alias("__hi"),
    )
    return fit.where((F.col("__c") >= 5) & (F.col("__lo") >= 4) & (F.col("__hi") >= 2 * F.col("__lo"))).withColumnRenamed("__hi", "last_n").drop("__c", "__lo")


def projections(fit: DataFrame, group: list[str]) -> DataFrame:
    """(group, fraction, extra): frames more for 5, 10 and 20 % less noise, where the fit is good."""
    good = fit.where((F.col("exponent") < -0.05) & (F.col("r2") >= 0.8))
    rows = good.select(*group, "exponent", "last_n", F.explode(F.array(F.lit(0.05), F.lit(0.1), F.lit(0.2))).alias("fraction"))
    return rows.select(*group, "fraction", F.ceil(F.col("last_n") * (F.pow(1 - F.col("fraction"), 1 / F.col("exponent")) - 1)).cast("long").alias("extra"))


def relative_to_median(df: DataFrame, group: list[str], value: str, name: str = "rel") -> DataFrame:
    """df with value / its group's median, and the number of the group's values."""
    med = rank.median(df, group, value, "__med").withColumnRenamed("n", "members")
    return df.join(med, group).withColumn(name, F.col(value) / F.col("__med")).drop("__med")


def sessions(df: DataFrame, group: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """(group, session_start, session_end, n): rows no more than gap_seconds apart."""
    s = df.groupBy(*group, F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end"))
    return s.select(*group, "session_start", "session_end", "n")
