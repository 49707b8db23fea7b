"""Affine, projective and sky geometry as column expressions.

An affine transform is a struct (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f. Angles of the sky are in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AFFINE = ("a", "b", "c", "d", "e", "f")


def affine(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for n, v in zip(AFFINE, values)])


def similarity(theta: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """Rotation by theta (radians) and scale about the origin, then a shift."""
    s, c = scale * F.sin(theta), scale * F.cos(theta)
    return affine(c, -s, dx, s, c, dy)


def apply(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t["a"] * x + t["b"] * y + t["c"], t["d"] * x + t["e"] * y + t["f"]


def inverse(t: Column) -> Column:
    """The transform back, or null where the linear part is singular."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    a, b, d, e = t["e"] / det, -t["b"] / det, -t["d"] / det, t["a"] / det
    return F.when(F.abs(det) >= 1e-12, affine(a, b, -(a * t["c"] + b * t["f"]), d, e, -(d * t["c"] + e * t["f"])))


def compose(t: Column, u: Column) -> Column:
    """t after u."""
    row = lambda p, q, r: (t[p] * u["a"] + t[q] * u["d"], t[p] * u["b"] + t[q] * u["e"], t[p] * u["c"] + t[q] * u["f"] + t[r])
    return affine(*row("a", "b", "c"), *row("d", "e", "f"))


def rescale(t: Column, factor: Column | float) -> Column:
    """t found at one resolution, for another."""
    return affine(t["a"], t["b"], t["c"] * factor, t["d"], t["e"], t["f"] * factor)


def rotation(t: Column) -> Column:
    return F.atan2(t["d"], t["a"])


def scale(t: Column) -> Column:
    """Mean of the lengths that the unit vectors get."""
    return (F.sqrt(t["a"] * t["a"] + t["d"] * t["d"]) + F.sqrt(t["b"] * t["b"] + t["e"] * t["e"])) / 2


def centre_offset(t: Column, width: Column, height: Column) -> tuple[Column, Column]:
    x, y = apply(t, width / 2, height / 2)
    return x - width / 2, y - height / 2


def max_difference(t: Column, u: Column, width: Column, height: Column) -> Column:
    """The largest distance between two images of a corner; no inner point has a larger one."""
    zero, far = F.lit(0.0), []
    for x, y in ((zero, zero), (width, zero), (zero, height), (width, height)):
        (p, q), (r, s) = apply(t, x, y), apply(u, x, y)
        far.append(F.sqrt((p - r) * (p - r) + (q - s) * (q - s)))
    return F.greatest(*far)


def effective_model(t: Column, width: Column, height: Column, tolerance: float) -> Column:
    """The simplest kind of transform that stays within `tolerance` of t over the frame."""
    one, zero = F.lit(1.0), F.lit(0.0)
    near = lambda u: max_difference(t, u, width, height) <= tolerance
    shift = affine(one, zero, t["c"], zero, one, t["f"])
    turn = similarity(rotation(t), one, t["c"], t["f"])
    both = similarity(rotation(t), scale(t), t["c"], t["f"])
    return F.when(near(shift), "translation").when(near(turn), "euclidean").when(near(both), "similarity").otherwise("affine")


def project(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Image under a homography of nine coefficients, row by row; null where its denominator vanishes."""
    z = m[6] * x + m[7] * y + m[8]
    ok = F.abs(z) >= 1e-12
    return F.when(ok, (m[0] * x + m[1] * y + m[2]) / z), F.when(ok, (m[3] * x + m[4] * y + m[5]) / z)


def projected_bounds(m: list[Column], width: Column, height: Column) -> Column:
    """Struct (x0, y0, x1, y1) of a frame's footprint, half a pixel wider than its centres; null where the horizon crosses the frame,
    or the homography is singular."""
    det = m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    low = F.lit(-0.5)
    corners = [(low, low), (width - 0.5, low), (low, height - 0.5), (width - 0.5, height - 0.5)]
    z = F.array(*[m[6] * x + m[7] * y + m[8] for x, y in corners])
    ok = (det != 0) & (F.forall(z, lambda v: v >= 1e-8) | F.forall(z, lambda v: v <= -1e-8))
    images = [project(m, x, y) for x, y in corners]
    xs, ys = [p[0] for p in images], [p[1] for p in images]
    return F.when(ok, F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1")))


class Sky:
    """A gnomonic projection: reference pixel, its place on the sky, and degrees per pixel as a 2 by 2 matrix."""

    def __init__(self, x0: Column, y0: Column, ra0: Column, dec0: Column, cd: tuple[Column, Column, Column, Column]):
        self.x0, self.y0, self.ra0, self.dec0, self.cd = x0, y0, F.radians(ra0), F.radians(dec0), cd

    def to_sky(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - self.x0, y - self.y0
        xi, eta = F.radians(self.cd[0] * dx + self.cd[1] * dy), F.radians(self.cd[2] * dx + self.cd[3] * dy)
        s, c = F.sin(self.dec0), F.cos(self.dec0)
        ra = F.degrees(self.ra0 + F.atan2(xi, c - eta * s))
        return ra - 360 * F.floor(ra / 360), F.degrees(F.asin((s + eta * c) / F.sqrt(1 + xi * xi + eta * eta)))

    def to_pixel(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        """Null on the far side of the sky, and where the matrix is singular."""
        a, d = F.radians(ra) - self.ra0, F.radians(dec)
        w = F.sin(self.dec0) * F.sin(d) + F.cos(self.dec0) * F.cos(d) * F.cos(a)
        xi = F.degrees(F.cos(d) * F.sin(a) / w)
        eta = F.degrees((F.cos(self.dec0) * F.sin(d) - F.sin(self.dec0) * F.cos(d) * F.cos(a)) / w)
        det = self.cd[0] * self.cd[3] - self.cd[1] * self.cd[2]
        ok = (w > 1e-6) & (F.abs(det) > 1e-30)
        return F.when(ok, self.x0 + (self.cd[3] * xi - self.cd[1] * eta) / det), F.when(ok, self.y0 + (self.cd[0] * eta - self.cd[2] * xi) / det)
