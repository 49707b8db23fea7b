"""Selection: first, spread and best rows, duplicates, group references, ranks within regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_rows(df: DataFrame, step: str, order: list[str], keep: int) -> DataFrame:
    """`keep` rows evenly spaced in the order, the first and the last included, with their place `pos` from 0.

    Counts by step place each step; only rows of steps that hold a wanted place are numbered."""
    counts = df.groupBy(step).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)  # one row for each step
    counts = counts.select(step, (F.sum("__c").over(w) - F.col("__c")).alias("__before"), "__c", F.sum("__c").over(Window.partitionBy()).alias("__n"))
    want = counts.select(step, "__before", F.explode(F.sequence(F.lit(0), F.least(F.lit(keep), F.col("__n")).cast("int") - 1)).alias("__i"), "__c", "__n")
    want = want.withColumn("__pos", F.floor(F.col("__i") * (F.col("__n") - 1) / F.greatest(F.least(F.lit(keep), F.col("__n")) - 1, F.lit(1))))
    want = want.where((F.col("__pos") >= F.col("__before")) & (F.col("__pos") < F.col("__before") + F.col("__c"))).select(step, "__before", "__pos").distinct()
    rows = df.join(want.select(step, "__before").distinct(), step)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(step).orderBy(*order)) - 1 + F.col("__before"))
    return rows.join(want.select(step, F.col("__pos").alias("pos")), [step, "pos"]).drop("__before")


def first_of_equal(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with same_as: the smallest `order` of the rows with an equal key, null for that row itself and for rows without a key."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"))
    out = df.join(first, key, "left")
    return out.withColumn("same_as", F.when(F.col("__first") < F.col(order), F.col("__first"))).drop("__first")


def references(df: DataFrame, group: str, score: str, frame: str) -> DataFrame:
    """(group, members, reference): each group's best frame; equal scores go to the larger frame."""
    return df.groupBy(F.coalesce(F.col(group), F.lit("")).alias(group)).agg(F.count(F.lit(1)).alias("members"), F.max_by(frame, F.struct(score, frame)).alias("reference"))


def top_of_region(df: DataFrame, region: list[str], score: str, key: str, keep: int) -> DataFrame:
    """The `keep` best rows of each region, with rk from 1; equal scores go by key."""
    rk = F.row_number().over(Window.partitionBy(*region).orderBy(F.desc(score), key))
    return df.withColumn("rk", rk).where(F.col("rk") <= keep)


def tally(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n, rk): each field's values by how often they occur, ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rk", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value")))


def spread_of_groups(placed: DataFrame, place: str, size: str, k: int) -> DataFrame:
    """The rows at k places spread evenly over their group, of rows that know their 1-based place and the group's size."""
    i, n = F.col(place) - 1, F.col(size)
    gaps = F.greatest(F.least(n, F.lit(k)) - 1, F.lit(1))
    # Place i is one of floor(j * (n - 1) / gaps): that of the least j that reaches it.
    j = F.ceil(i * gaps / F.greatest(n - 1, F.lit(1)))
    return placed.where((i == 0) | (F.floor(j * (n - 1) / gaps) == i))
