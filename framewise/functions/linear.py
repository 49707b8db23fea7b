"""Small symmetric systems held as arrays, solved inside a row by higher-order functions: nothing is exploded, and a group's system is its sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tiles as plane


def place(i: int, j: int) -> int:
    """Of entry (i, j) among the packed lower triangle's rows."""
    i, j = max(i, j), min(i, j)
    return i * (i + 1) // 2 + j


def products(basis: list[Column]) -> list[Column]:
    """The packed lower triangle of the products of basis functions."""
    return [basis[i] * basis[j] for i in range(len(basis)) for j in range(i + 1)]


def _dot(n: Column, f) -> Column:
    """Sum of f(k) for k from 0 to n - 1."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, k: s + f(k))).otherwise(0.0)


def cholesky(packed: Column, n: int, least: float = 1e-12) -> Column:
    """The packed lower factor of a packed matrix, or null where a pivot is under `least` of its diagonal entry."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(i + 1)])
    at = lambda a, i, j: F.get(a, (i * (i + 1) / 2 + j).cast("int"))

    def entry(a: Column, low: Column, e: Column) -> Column:
        i, j = e["i"], e["j"]
        rest = at(a, i, j) - _dot(j, lambda k: at(low, i, k) * at(low, j, k))
        return plane.bind(rest, lambda v: F.when(i > j, v / at(low, j, j)).when(v > least * at(a, i, i), F.sqrt(v)))

    none = F.array().cast("array<double>")
    factor = plane.bind(packed, lambda a: F.aggregate(entries, none, lambda low, e: F.when(low.isNotNull(), F.concat(low, F.array(entry(a, low, e))))))
    return plane.bind(factor, lambda low: F.when(~F.exists(low, lambda v: v.isNull() | F.isnan(v)), low))


def solve(packed: Column, right: Column, n: int, least: float = 1e-12) -> Column:
    """x of A x = right, A being symmetric, positive definite and packed; null where it isn't."""
    at = lambda a, i, j: F.get(a, (i * (i + 1) / 2 + j).cast("int"))
    none = F.array().cast("array<double>")
    places = F.sequence(F.lit(0), F.lit(n - 1))

    def both(s: Column) -> Column:
        low, b = s["low"], s["b"]
        forth = F.aggregate(places, none, lambda y, i: F.concat(y, F.array((F.get(b, i) - _dot(i, lambda k: at(low, i, k) * F.get(y, k))) / at(low, i, i))))
        # Backwards: the last unknown comes first, so unknown i is at place n - 1 - i.
        back = lambda y: F.aggregate(places, none, lambda x, m: F.concat(x, F.array((F.get(y, n - 1 - m) - _dot(m, lambda k: at(low, n - 1 - k, n - 1 - m) * F.get(x, k))) / at(low, n - 1 - m, n - 1 - m))))
        return F.reverse(plane.bind(forth, back))

    pair = F.struct(cholesky(packed, n, least).alias("low"), right.alias("b"))
    return plane.bind(pair, lambda s: F.when(s["low"].isNotNull(), both(s)))
