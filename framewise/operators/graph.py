"""Graphs of frames: components, the forest of strongest links, transforms along it, and least squares over the links.

A graph is a table of links (a, b, ...), held once each. Rounds are written to the shared folder, so a plan never grows with them; their number is
logarithmic in the size of a component but for `potentials`, which stops by its residual. Nothing but sums and counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import tiles as plane
from ..sources.shared import materialize, remove, written


def _jumped(up: DataFrame, tag: str, most: int = 64) -> DataFrame:
    """up (c, parent, t), t leading from c to its parent, with every parent replaced by its root, which is its own parent: pointer jumping."""
    now, path = written(up, tag)
    for _ in range(most):
        far = now.select(F.col("c").alias("parent"), F.col("parent").alias("__p"), F.col("t").alias("__t"))
        step = now.join(far, "parent").select("c", "parent", "t", "__p", "__t")
        if step.where("parent <> __p").isEmpty():
            return now
        last = path
        now, path = written(step.select("c", F.col("__p").alias("parent"), F.when(F.col("parent") == F.col("__p"), F.col("t")).otherwise(_after(F.col("__t"), F.col("t"))).alias("t")), tag)
        remove(up.sparkSession, last)
    raise RuntimeError("pointers didn't settle")


def _after(t: Column, u: Column) -> Column:
    """t after u; either is computed once, however long its expression."""
    return plane.bind(F.struct(t.alias("t"), u.alias("u")), lambda s: geo.compose(s["t"], s["u"]))


def _back(t: Column) -> Column:
    return plane.bind(t, geo.inverse)


def _identity() -> Column:
    return geo.affine(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)])


def forest(nodes: DataFrame, links: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """(nodes, tree): (node, comp, t) with the smallest node of each component and the transform from the node to it; and the links (a, b) of the
    spanning forest of greatest weight, equal weights going to the smaller (a, b).

    links: (a, b, weight, t), t leading from b's frame to a's. Each round every component takes its best link to another one (Boruvka's rounds), transforms are
    composed along the pointers that these make, so no path is walked link by link."""
    spark = nodes.sparkSession
    placed, path = written(nodes.select("node", F.col("node").alias("comp"), _identity().alias("t")).distinct(), "placed")
    held = materialize(links.where("a <> b").select("a", "b", "weight", "t"), "links")
    taken: DataFrame | None = None
    side = lambda x: placed.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"), F.col("t").alias(f"t{x}"))
    order = F.struct((-F.col("weight")).alias("w"), "a", "b")
    for _ in range(most):
        across = held.join(side("a"), "a").join(side("b"), "b").where("ca <> cb")
        # From a component's root over the link to the other component's root.
        to_a = _after(F.col("ta"), _after(F.col("t"), _back(F.col("tb"))))
        to_b = _after(F.col("tb"), _after(_back(F.col("t")), _back(F.col("ta"))))
        both = across.select(F.explode(F.array(F.struct(F.col("cb").alias("c"), F.col("ca").alias("parent"), to_a.alias("t"), order.alias("o")), F.struct(F.col("ca").alias("c"), F.col("cb").alias("parent"), to_b.alias("t"), order.alias("o")))).alias("x")).select("x.*")
        best = materialize(both.groupBy("c").agg(F.min_by(F.struct("parent", "t", "o"), F.col("o")).alias("m")).select("c", "m.*"), "best")
        if best.isEmpty():
            break
        picked = best.select("o.a", "o.b").distinct()
        taken = picked if taken is None else taken.unionByName(picked)
        # Two components that take one link point at each other: the smaller one stays a root. Components that took none are roots, too.
        back = best.select(F.col("c").alias("parent"), F.col("parent").alias("back"))
        up = best.join(back, "parent", "left").withColumn("root", (F.col("back") == F.col("c")) & (F.col("c") < F.col("parent")))
        up = up.select("c", F.when(F.coalesce("root", F.lit(False)), F.col("c")).otherwise(F.col("parent")).alias("parent"), F.when(F.coalesce("root", F.lit(False)), _identity()).otherwise(F.col("t")).alias("t"))
        roots = up.select(F.col("parent").alias("c")).distinct().join(up, "c", "left_anti").select("c", F.col("c").alias("parent"), _identity().alias("t"))
        top = _jumped(up.unionByName(roots), "jumped").select(F.col("c").alias("comp"), "parent", F.col("t").alias("__t"))
        last = path
        moved = placed.join(top, "comp", "left").select("node", F.coalesce("parent", "comp").alias("comp"), F.when(F.col("parent").isNull(), F.col("t")).otherwise(_after(F.col("__t"), F.col("t"))).alias("t"))
        placed, path = written(moved, "placed")
        remove(spark, last)
    else:
        raise RuntimeError("the forest didn't settle")
    # The smallest node of a component becomes its origin.
    low = placed.groupBy("comp").agg(F.min("node").alias("low"))
    origin = placed.join(low, "comp").where("node = low").select("comp", "low", _back(F.col("t")).alias("__t"))
    out = placed.join(origin, "comp").select("node", F.col("low").alias("comp"), _after(F.col("__t"), F.col("t")).alias("t"))
    none = held.select("a", "b").where("false")
    return materialize(out, "forest"), materialize(none if taken is None else taken.distinct(), "tree")


def components(nodes: DataFrame, links: DataFrame, most: int = 64) -> DataFrame:
    """(node, comp): the smallest node that links (a, b) reach.

    Each round every component points at its smallest linked one if that is smaller, pointers are followed to their ends, and links within a component go, as do
    copies of others; so what is left shrinks fast."""
    spark, c = nodes.sparkSession, F.col
    placed, path = written(nodes.select("node", c("node").alias("comp")).distinct(), "components")
    known = lambda n: placed.select(c("node").alias(n))
    ends = lambda t: t.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, held = written(ends(links.select("a", "b")).join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi").select("a", "b"), "links")
    for _ in range(most):
        if left.isEmpty():
            return placed
        up, tops = _followed(left.groupBy(c("b").alias("c")).agg(F.min("a").alias("parent")), most)
        at = lambda n: up.select(c("c").alias(n), c("parent").alias(f"p{n}"))
        last, gone = path, held
        placed, path = written(placed.join(up, c("comp") == c("c"), "left").select("node", F.coalesce("parent", "comp").alias("comp")), "components")
        moved = left.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        left, held = written(ends(moved), "links")
        for x in (last, gone, tops):
            remove(spark, x)
    raise RuntimeError("the components didn't settle")


def _followed(up: DataFrame, most: int) -> tuple[DataFrame, str]:
    """up (c, parent), every parent smaller than its c, with each parent replaced by the end of its pointers; and where it is."""
    now, path = written(up, "followed")
    for _ in range(most):
        far = now.select(F.col("c").alias("parent"), F.col("parent").alias("__p"))
        if now.join(far, "parent", "left_semi").isEmpty():
            return now, path
        last = path
        now, path = written(now.join(far, "parent", "left").select("c", F.coalesce("__p", "parent").alias("parent")), "followed")
        remove(up.sparkSession, last)
    raise RuntimeError("pointers didn't settle")


def anchored(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """(node, fixed) of the components of links (a, b) that hold an anchor (node)."""
    comps = components(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), links)
    known = comps.join(anchors.select("node", F.lit(True).alias("fixed")).distinct(), "node", "left")
    return materialize(known.join(known.where("fixed").select("comp").distinct(), "comp").select("node", F.coalesce("fixed", F.lit(False)).alias("fixed")), "anchored")


def potentials(links: DataFrame, known: DataFrame, tolerance: float = 1e-9, most: int = 10_000) -> DataFrame:
    """(node, x) of least squares over links (a, b, value, weight): x[b] - x[a] as near `value` as weights ask, x = 0 where known (node, fixed; see `anchored`) is fixed.

    Conjugate gradients on the graph's Laplacian, scaled by its diagonal. Links of one pair of nodes are added up first; a step is one join of the direction to the
    links, one sum by node, and two rows of sums. It ends when the residual is `tolerance` of the right-hand side."""
    spark = links.sparkSession
    pairs = links.where("a <> b AND weight > 0").groupBy("a", "b").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("value")).alias("wv"))
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("w"), (-F.col("wv")).alias("wv")), F.struct(F.col("b").alias("node"), F.col("w"), F.col("wv")))).alias("e")).select("e.*")
    start = known.join(ends.groupBy("node").agg(F.sum("w").alias("d"), F.sum("wv").alias("r")), "node")
    zero = F.when(F.col("fixed"), 0.0)
    start = start.select("node", "fixed", "d", F.lit(0.0).alias("x"), zero.otherwise(F.col("r")).alias("r"), zero.otherwise(F.col("r") / F.col("d")).alias("p"))
    now, path = written(start, "state")
    first = now.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()
    rr, rz = first[0] or 0.0, first[1] or 0.0
    enough = rr * tolerance * tolerance
    for _ in range(most):
        if rr <= enough or rz == 0:
            break
        p = lambda n: now.select(F.col("node").alias(n), F.col("p").alias(f"p{n}"))
        flow = pairs.join(p("a"), "a").join(p("b"), "b").withColumn("f", F.col("w") * (F.col("pb") - F.col("pa")))
        out = flow.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("f").alias("f")), F.struct(F.col("a").alias("node"), (-F.col("f")).alias("f")))).alias("e")).select("e.*")
        q = F.when(F.col("fixed"), 0.0).otherwise(F.coalesce("f", F.lit(0.0)))
        step = now.join(out.groupBy("node").agg(F.sum("f").alias("f")), "node", "left").withColumn("q", q).drop("f")
        last = path
        now, path = written(step, "state")
        c = F.col
        pq = now.agg(F.sum(c("p") * c("q"))).first()[0]
        remove(spark, last)
        if not pq or pq <= 0:
            raise ValueError("the links don't fix every node")
        now = now.withColumn("x", c("x") + rz / pq * c("p")).withColumn("r", c("r") - rz / pq * c("q")).drop("q")
        rr, after = now.agg(F.sum(c("r") * c("r")), F.sum(c("r") * c("r") / c("d"))).first()
        now = now.withColumn("p", F.when(c("fixed"), 0.0).otherwise(c("r") / c("d") + after / rz * c("p")))
        rz = after
    else:
        raise RuntimeError("the solution didn't settle")
    return materialize(now.select("node", "x"), "potentials")


def robust_potentials(links: DataFrame, anchors: DataFrame, passes: int = 3, scale: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(potentials, links with their residual and the weight of the last pass): solved again `passes` times, each link weighing less the further off it is, by the soft L1 rule:
    w / sqrt(1 + w (residual / scale)^2). links: (a, b, value, weight), weights being one over a variance."""
    known = anchored(links.where("a <> b AND weight > 0").select("a", "b").distinct(), anchors)
    weighted = links.withColumn("__w", F.col("weight"))
    for _ in range(passes):
        found = potentials(weighted.select("a", "b", "value", F.col("__w").alias("weight")), known)
        at = lambda n: found.select(F.col("node").alias(n), F.col("x").alias(f"x{n}"))
        rest = links.join(at("a"), "a").join(at("b"), "b").withColumn("residual", F.col("value") - F.col("xb") + F.col("xa")).drop("xa", "xb")
        far = F.col("residual") * F.sqrt("weight") / scale
        weighted = rest.withColumn("__w", F.col("weight") / F.sqrt(1 + far * far))
    return found, weighted.withColumnRenamed("__w", "used")
