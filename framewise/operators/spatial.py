"""Joins of points by distance and of intervals by overlap, as equi-joins on cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sequence


def within(a: DataFrame, b: DataFrame, radius: float, keep: list[str] | None = None) -> DataFrame:
    """(a, b, d2, and the columns `keep` of a) of points (id, x, y) at most `radius` apart: cells of that size, each point of `b` in the nine around it."""
    keep = keep or []
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = a.select(F.col("id").alias("a"), *keep, F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    right = b.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"), near.alias("d"))
    right = right.select("b", "bx", "by", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    return left.join(right, ["cx", "cy"]).select(*keep, "a", "b", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def chained(points: DataFrame, size: float, ahead: int = 8) -> DataFrame:
    """(p, q) of points (id, x, y, ...): each with the next `ahead` ones by x in its cell of `size`, and over the cells' borders likewise. A few near pairs of each
    point, as many for any density; which pairs these are is no promise."""
    cell = lambda c, off: F.floor((c + off) / size)
    grids = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.struct(*points.columns).alias("p"), F.explode(F.array(F.lit(0.0), F.lit(size / 2))).alias("off"))
    grids = grids.select("p", "off", cell(F.col("p.x"), F.col("off")).alias("cx"), cell(F.col("p.y"), F.col("off")).alias("cy"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("off", "cx", "cy").orderBy("p.x", "p.id")
    pairs = grids.repartition(parts, "off", "cx", "cy").select("p", "off", F.array(*[F.lead("p", k).over(w) for k in range(1, ahead + 1)]).alias("q")).select("p", "off", F.explode("q").alias("q"))
    same = (cell(F.col("p.x"), 0.0) == cell(F.col("q.x"), 0.0)) & (cell(F.col("p.y"), 0.0) == cell(F.col("q.y"), 0.0))
    return pairs.where(F.col("q").isNotNull() & ((F.col("off") == 0) | ~same)).select("p", "q")


def between(points: DataFrame, radius: float) -> DataFrame:
    """(p, q): all pairs at most `radius` apart of points (id, x, y, comp, ...) whose comp differs. Comps are ordered by their size, and a point looks for larger ones
    only, and only where its cell or one around it has any: where one comp fills a place, no pairs of its own are made."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    sizes = points.groupBy("comp").agg(F.struct(F.count(F.lit(1)).alias("n"), "comp").alias("o"))
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.struct(*points.columns).alias("p"), F.col("comp"), cell("x").alias("cx"), cell("y").alias("cy")).join(sizes.hint("merge"), "comp").drop("comp")
    near = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("c")
    top = placed.groupBy("cx", "cy").agg(F.max("o").alias("top")).select("top", near).groupBy("c.cx", "c.cy").agg(F.max("top").alias("top"))
    left = placed.join(top.hint("merge"), ["cx", "cy"]).where("o < top").select("p", "o", near).select("p", "o", "c.*")
    right = placed.select(F.col("p").alias("q"), F.col("o").alias("oq"), "cx", "cy")
    dx, dy = F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")
    return left.join(right.hint("merge"), ["cx", "cy"]).where((F.col("o") < F.col("oq")) & (dx * dx + dy * dy <= radius * radius)).select("p", "q")


def nearest(pairs: DataFrame, of: str = "a", to: str = "b", by: list[str] | None = None) -> DataFrame:
    """The pair of least distance of each (by, of); equal distances go to the smaller `to`."""
    by = by or []
    return pairs.groupBy(*by, of).agg(F.min(F.struct("d2", to)).alias("m")).select(*by, of, F.col(f"m.{to}").alias(to), "m.d2")


def mutual(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs that are each other's nearest, for each value of `by`."""
    by = by or []
    return nearest(pairs, by=by).join(nearest(pairs, "b", "a", by).select(*by, "a", "b"), [*by, "a", "b"])


def one_to_one(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The nearest `b` of each `a`; of several `a` with one `b` the smallest stays."""
    by = by or []
    return nearest(pairs, by=by).groupBy(*by, "b").agg(F.min(F.struct("a", "d2")).alias("m")).select(*by, "m.a", "b", "m.d2")


def nearest_two(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, d2, d2_next): the nearest, and the distance of the next one if there is one."""
    by = by or []
    w = Window.partitionBy(*by, "a").orderBy("d2", "b")
    ranked = pairs.withColumn("rk", F.row_number().over(w)).where("rk <= 2")
    return ranked.groupBy(*by, "a").agg(F.max(F.when(F.col("rk") == 1, F.col("b"))).alias("b"), F.min("d2").alias("d2"), F.max(F.when(F.col("rk") == 2, F.col("d2"))).alias("d2_next"))


def overlaps(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """(a, b) of closed integer intervals (id, lo, hi) that overlap: each lies in the cells of `size` that it touches, and a pair
    is kept in the first cell that both touch."""
    def cells(t: DataFrame, name: str) -> DataFrame:
        spread = F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size)))
        return t.select(F.col("id").alias(name), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"), spread.alias("cell"))

    both = cells(a, "a").join(cells(b, "b"), "cell").where("a_lo <= b_hi AND b_lo <= a_hi")
    return both.where(F.col("cell") == F.floor(F.greatest("a_lo", "b_lo") / size)).select("a", "b")


def overlap_counts(a: DataFrame, b: DataFrame, step: int = 1 << 10) -> DataFrame:
    """a (id, lo, hi) with n: how many closed integer intervals of b overlap it, without making the pairs. Those that begin by hi
    less those that end before lo; both are running sums over the distinct edges, taken within stretches of `step` and over these, that a looks up."""
    begun = b.groupBy(F.col("lo").alias("at")).agg(F.count(F.lit(1)).alias("b"), F.lit(0).cast("long").alias("e"))
    ended = b.groupBy((F.col("hi") + 1).alias("at")).agg(F.lit(0).cast("long").alias("b"), F.count(F.lit(1)).alias("e"))
    asked = a.select(F.explode(F.array("lo", "hi")).alias("at")).distinct().select("at", F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("e"))
    edges = begun.unionByName(ended).unionByName(asked).groupBy("at").agg(F.sum("b").alias("b"), F.sum("e").alias("e"))
    sums = sequence.running(edges.withColumn("__step", F.floor(F.col("at") / step)), [], "__step", ["at"], {"begun": F.col("b"), "ended": F.col("e")})
    low, high = sums.select(F.col("at").alias("lo"), "ended"), sums.select(F.col("at").alias("hi"), "begun")
    return a.join(low, "lo").join(high, "hi").select("id", "lo", "hi", (F.col("begun") - F.col("ended")).alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: list[str], ts: str, value: str, step: str, name: str = "prev") -> DataFrame:
    """left with the latest earlier-or-equal `value` of right by key. Both sides are ordered together within (key, step); a step
    without an earlier row takes the last value of the steps before it."""
    one = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__l", F.lit(1))
    other = right.select(*key, ts, step, F.col(value).alias("__v"), F.lit(0).alias("__l"))
    both = one.unionByName(other, allowMissingColumns=True)
    local = F.last("__v", True).over(Window.partitionBy(*key, step).orderBy(ts, "__l").rowsBetween(Window.unboundedPreceding, 0))
    last = other.groupBy(*key, step).agg(F.max_by("__v", ts).alias("__e"))
    steps = both.select(*key, step).distinct().join(last, [*key, step], "left")
    carried = steps.withColumn("__c", F.last("__e", True).over(Window.partitionBy(*key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)))
    out = both.withColumn("__p", local).where("__l = 1").join(carried.select(*key, step, "__c"), [*key, step])
    return out.withColumn(name, F.coalesce("__p", "__c")).select(*left.columns, name)
