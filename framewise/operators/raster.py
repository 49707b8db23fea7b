"""Grids in long form: one row for each site. Neighbours are found by moving copies of the keys; dense planes are better held as
arrays (functions.tiles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_sites(tiles: DataFrame, key: list[str], values: str, width: int) -> DataFrame:
    """(key, pos, x, y, v) of planes held as arrays, row after row."""
    out = tiles.select(*key, F.posexplode(values).alias("pos", "v"))
    return out.select(*key, "pos", (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def deposit(samples: DataFrame, cell: list[str], value: str, weight: str) -> DataFrame:
    """(cell, sum_w, sum_wv, sum_ww, n): partial sums of a weighted merge, which add up over any split of the samples."""
    w, v = F.col(weight), F.col(value)
    return samples.where(w > 0).groupBy(*cell).agg(F.sum(w).alias("sum_w"), F.sum(w * v).alias("sum_wv"), F.sum(w * w).alias("sum_ww"), F.count(F.lit(1)).alias("n"))


def combine(parts: list[DataFrame], cell: list[str]) -> DataFrame:
    """Partial sums added up; all must have the same columns."""
    if any(set(p.columns) != set(parts[0].columns) for p in parts):
        raise ValueError("partial sums of different shapes don't combine")
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in parts[0].columns if c not in cell])


def leave_one_out(df: DataFrame, site: list[str], value: str, weight: str | None = None) -> DataFrame:
    """df with loo: the site's weighted mean without the row's own share; null where the others weigh nothing."""
    w = F.col(weight) if weight else F.lit(1)
    sums = df.groupBy(*site).agg(F.sum(w).alias("__w"), F.sum(w * F.col(value)).alias("__wv"))
    rest = F.col("__w") - w
    return df.join(sums, site).withColumn("loo", F.when(rest > 0, (F.col("__wv") - w * F.col(value)) / rest)).drop("__w", "__wv")


def fill_holes(cells: DataFrame, plane: list[str], total: str, width: int, height: int, reach: int = 1) -> DataFrame:
    """(plane, x, y, total, n, ring) for the cells that have a value, a whole number, and for those within `reach` of one: the sum and
    the number of the values in the nearest square ring that has any (ring 0: the cell's own). Sums of whole numbers have no order."""
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(max(abs(dx), abs(dy))).alias("r")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)])
    near = cells.select(*plane, "x", "y", F.col(total).alias("__v"), F.explode(shifts).alias("d"))
    near = near.select(*plane, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), F.col("d.r").alias("ring"), "__v")
    near = near.where(f"x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}")
    rings = near.groupBy(*plane, "x", "y", "ring").agg(F.sum("__v").alias(total), F.count(F.lit(1)).alias("n"))
    return rings.groupBy(*plane, "x", "y").agg(F.min(F.struct("ring", total, "n")).alias("m")).select(*plane, "x", "y", f"m.{total}", "m.n", "m.ring")
