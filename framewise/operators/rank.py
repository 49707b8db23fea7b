"""Exact order statistics of groups.

Values are counted by group first (partial sums on the map side), so a group of any size reaches one task only as its distinct
values, which a running sum reads as a stream. Nothing is collected into an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(group, value, c, below, n): c rows have the value, `below` have smaller ones, n have any. Other columns are dropped; the
    group and value columns must have other names than these three. A row counts `weight` times."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*group, value, "c", (F.sum("c").over(w) - F.col("c")).alias("below"), F.sum("c").over(Window.partitionBy(*group)).alias("n"))


def rank_select(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column], weight: str | None = None) -> DataFrame:
    """For each name, the value of a 0-based rank, an expression of the group's size n."""
    at = value_counts(df, group, value, weight)
    pick = [F.max(F.when((F.col("below") <= k) & (F.col("below") + F.col("c") > k), F.col(value))).alias(name) for name, k in ranks.items()]
    return at.groupBy(*group).agg(*pick)


def upper_median(n: Column | str = "n") -> Column:
    return F.floor(F.col(n) / 2)


def floor_rank(p: float) -> Column:
    return F.floor((F.col("n") - 1) * p)


def round_rank(p: float) -> Column:
    return F.floor((F.col("n") - 1) * p + 0.5)


def ceil_rank(p: float) -> Column:
    return F.ceil((F.col("n") - 1) * p)


def median(df: DataFrame, group: list[str], value: str, name: str = "med", weight: str | None = None) -> DataFrame:
    """(group, name, n): the median, the mean of the two middle values where n is even, from counts by value."""
    at = value_counts(df, group, value, weight)
    pick = lambda k: F.max(F.when((F.col("below") <= k) & (F.col("below") + F.col("c") > k), F.col(value)))
    both = at.groupBy(*group).agg(pick(F.floor((F.col("n") - 1) / 2)).alias("__lo"), pick(F.floor(F.col("n") / 2)).alias("__hi"), F.first("n").alias("__n"))
    return both.select(*group, ((F.col("__lo") + F.col("__hi")) / 2).alias(name), F.col("__n").alias("n"))


def median_of_many(df: DataFrame, group: list[str], value: str, name: str = "med") -> DataFrame:
    """(group, name): the median as above, of doubles >= 0 that hardly repeat, so that counts by value would be as many as rows. Rows are counted by steps of the logarithm first;
    only values of the steps that hold the two middle ranks are counted then. df is read twice. A step takes a thousandth of a value's size."""
    step = F.when(F.col(value) > 0, F.rint(F.log(F.col(value)) * 1000)).otherwise(F.lit(float("-inf")))
    rows = df.where(F.col(value).isNotNull()).select(*group, value, step.alias("__step"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    steps = value_counts(rows, group, "__step").where((F.col("below") <= high) & (F.col("below") + F.col("c") > low)).select(*group, "__step", F.col("below").alias("__before"), F.col("n").alias("__n"))
    near = rows.join(steps, [*group, "__step"]).groupBy(*group, "__before", "__n", value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = near.select(*group, value, "c", F.col("__n").alias("n"), (F.sum("c").over(w) - F.col("c") + F.min("__before").over(w)).alias("below"))
    pick = lambda k: F.max(F.when((F.col("below") <= k) & (F.col("below") + F.col("c") > k), F.col(value)))
    return at.groupBy(*group).agg(pick(low).alias("__lo"), pick(high).alias("__hi")).select(*group, ((F.col("__lo") + F.col("__hi")) / 2).alias(name))


def median_mad(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, med, mad): the median, and the median distance from it. Few values a group are read again: each distinct one once."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("times"))
    med = median(df, group, value).drop("n")
    far = counts.join(med, group).select(*group, F.abs(F.col(value) - F.col("med")).alias("far"), "times")
    return med.join(median(far, group, "far", "mad", weight="times").drop("n"), group)


def lowest_share_mean(df: DataFrame, group: list[str], value: str, share: int = 10) -> DataFrame:
    """(group, total, k): the sum of the lowest k = max(1, n / share) values."""
    at = value_counts(df, group, value).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / share)))
    used = F.greatest(F.lit(0), F.least(F.col("c"), F.col("k") - F.col("below")))
    return at.groupBy(*group).agg(F.sum(F.col(value) * used).alias("total"), F.first("k").alias("k"))
