"""Least squares over a few basis functions for each group, reweighted against outliers, and locally weighted quadratics with a check of what curvature adds.

A group's rows meet as sums of products: partial sums on the map side, one row for each group; the system is solved in that row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear
from ..functions import tiles as plane
from ..functions.robust import MAD_SCALE, tukey_weight
from . import rank


def dot(coefficients: Column, basis: list[Column]) -> Column:
    terms = [F.get(coefficients, F.lit(i)) * b for i, b in enumerate(basis)]
    return sum(terms[1:], terms[0])


def robust_fit(df: DataFrame, group: list[str], basis: list[Column], value: Column, passes: int = 3, cut: float = 3.0, least: int = 20, floor: float = 1e-9) -> DataFrame:
    """(group, n, coefficients) of value over the basis: `passes` fits, each row weighing by Tukey's rule on its residual of the pass before, `cut` scaled deviations wide.
    Groups of fewer than `least` rows have no row; where a later pass can't be solved, the last one that could stands."""
    k = len(basis)
    rows = df.select(*group, *[b.cast("double").alias(f"__b{i}") for i, b in enumerate(basis)], value.cast("double").alias("__v")).where("__v IS NOT NULL")
    own = [F.col(f"__b{i}") for i in range(k)]
    weighted, best = rows.withColumn("__w", F.lit(1.0)), None
    for i in range(passes):
        w = F.col("__w")
        sums = [F.sum(w * p).alias(f"__p{j}") for j, p in enumerate(linear.products(own))] + [F.sum(w * b * F.col("__v")).alias(f"__r{j}") for j, b in enumerate(own)]
        by = weighted.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *sums).where(F.col("n") >= least)
        x = linear.solve(F.array(*[F.col(f"__p{j}") for j in range(k * (k + 1) // 2)]), F.array(*[F.col(f"__r{j}") for j in range(k)]), k)
        now = by.select(*group, "n", F.explode(F.array(x)).alias("coefficients"))
        best = now if best is None else best.join(now.select(*group, F.col("coefficients").alias("__c")), group, "left").select(*group, "n", F.coalesce("__c", "coefficients").alias("coefficients"))
        best = best.where("coefficients IS NOT NULL")
        if i == passes - 1:
            return best
        rest = rows.join(best.select(*group, "coefficients"), group).withColumn("__e", F.col("__v") - dot(F.col("coefficients"), own)).drop("coefficients")
        spread = rank.median_mad(rest, group, "__e").select(*group, F.greatest(MAD_SCALE * F.col("mad"), F.lit(floor)).alias("__s"))
        weighted = rest.join(spread, group).withColumn("__w", tukey_weight(F.col("__e"), cut * F.col("__s"))).drop("__e", "__s")
    raise ValueError("at least one pass")


#: Powers of x and y up to the fourth, and where the products of the first six stand among them. Fixed values.
POWERS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3), (4, 0), (3, 1), (2, 2), (1, 3), (0, 4))
LEAST_PIVOT, LEAST_SAMPLES, MOST_VARIANCE, CERTAIN = 1e-3, 12, 4, 9


def moments(df: DataFrame, key: list[str], w: str, x: str, y: str, v: str, variance: str) -> DataFrame:
    """(key, normal, noise, rhs, w2): sums that add up over any split of the samples around a centre (x and y from there): of weights and of squared weights times variances by
    the powers of x and y, of weighted values by the first six, and of squared weights."""
    def power(i: int, j: int) -> Column:
        out = F.lit(1.0)
        for c, n in ((x, i), (y, j)):
            for _ in range(n):
                out = out * F.col(c)
        return out

    nv = F.col(w) * F.col(w) * F.greatest(F.col(variance), F.lit(0.0))
    sums = [F.sum(F.col(w) * power(*p)).alias(f"__n{i}") for i, p in enumerate(POWERS)] + [F.sum(nv * power(*p)).alias(f"__v{i}") for i, p in enumerate(POWERS)]
    sums += [F.sum(F.col(w) * F.col(v) * power(*p)).alias(f"__r{i}") for i, p in enumerate(POWERS[:6])] + [F.sum(F.col(w) * F.col(w)).alias("w2")]
    by = df.groupBy(*key).agg(*sums)
    pack = lambda c, n: F.array(*[F.col(f"__{c}{i}") for i in range(n)])
    return by.select(*key, pack("n", 15).alias("normal"), pack("v", 15).alias("noise"), pack("r", 6).alias("rhs"), "w2")


def _product(i: int, j: int) -> int:
    return POWERS.index((POWERS[i][0] + POWERS[j][0], POWERS[i][1] + POWERS[j][1]))


def _response(m: Column, n: int) -> Column:
    """Weights by which the sums rhs give the value at the centre of a fit of the first n powers, or null where they are too little spread."""
    scale = F.array(*[F.sqrt(F.get(m, F.lit(_product(i, i)))) for i in range(n)])

    def scaled(s: Column) -> Column:
        packed = F.array(*[F.get(m, F.lit(_product(i, j))) / (F.get(s, F.lit(i)) * F.get(s, F.lit(j))) for i in range(n) for j in range(i + 1)])
        first = F.array(*[1 / F.get(s, F.lit(0)) if i == 0 else F.lit(0.0) for i in range(n)])
        x = linear.solve(packed, first, n, LEAST_PIVOT)
        return F.when(~F.exists(s, lambda v: v.isNull() | (v <= 1e-15)), F.zip_with(x, s, lambda a, b: a / b))

    return plane.bind(scale, scaled)


def _variance(a: Column, b: Column, noise: Column, n: int = 6) -> Column:
    terms = [F.get(a, F.lit(i)) * F.get(b, F.lit(j)) * F.get(noise, F.lit(_product(i, j))) for i in range(n) for j in range(n)]
    return sum(terms[1:], terms[0])


def checked_curvature(m: DataFrame, key: list[str], bounded: bool = False) -> DataFrame:
    """(key, why, delta, blend) of moments: how far the quadratic's value at the centre is off the plane's, and how much of that to take, which falls to nothing where noise explains it.
    why names what forbids it: too few effective samples, a fit that the samples don't fix, or a variance of more than four times the plane's; with `bounded` the last only limits
    the share so that the mixture's variance stays there."""
    c = F.col
    once = lambda df, **columns: df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("__o")).select(*df.columns, "__o.*")
    s = once(m, quad=_response(c("normal"), 6), line=_response(c("normal"), 3))
    pad = F.concat(c("line"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    s = once(s, line6=pad, diff=F.zip_with(c("quad"), pad, lambda a, b: a - b))
    var = lambda a, b: _variance(c(a), c(b), c("noise"))
    s = once(s, vp=var("line6", "line6"), vq=var("quad", "quad"), vpq=var("line6", "quad"), vd=F.greatest(var("diff", "diff"), F.lit(0.0)), delta=F.aggregate(F.zip_with("diff", "rhs", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))
    a, b = c("vq") + c("vp") - 2 * c("vpq"), 2 * (c("vpq") - c("vp"))
    limit = F.when(a > 0, 6 * c("vp") / (F.sqrt(b * b + 12 * a * c("vp")) + b))
    cap = F.when(c("vq") <= MOST_VARIANCE * c("vp"), F.lit(1.0)).when(F.lit(bounded) & (limit > 0), F.least(limit, F.lit(1.0)))
    few = F.get("normal", F.lit(0)) * F.get("normal", F.lit(0)) < LEAST_SAMPLES * c("w2")
    why = F.when(few, "effective_samples").when(c("quad").isNull(), "quadratic_condition").when(c("line").isNull(), "linear_condition").when((c("vp") <= 0) | (c("vq") <= 0) | cap.isNull(), "variance")
    share = F.least(F.greatest(1 - CERTAIN * c("vd") / F.greatest(c("delta") * c("delta"), F.lit(1e-30)), F.lit(0.0)), cap)
    s = s.withColumn("why", why)
    return s.select(*key, "why", F.when(c("why").isNull(), c("delta")).alias("delta"), F.when(c("why").isNull(), share).alias("blend"))
