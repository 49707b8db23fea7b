"""Brightness maps between frames: gain * v + offset, and gains that vary smoothly over the frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(gain: Column, offset: Column) -> Column:
    return F.struct(gain.alias("gain"), offset.alias("offset"))


def apply(m: Column, v: Column) -> Column:
    return m["gain"] * v + m["offset"]


def inverse(m: Column) -> Column:
    """The map back, or null where the gain has collapsed."""
    return F.when(F.abs(m["gain"]) >= 1e-6, linear(1 / m["gain"], -m["offset"] / m["gain"]))


def compose(m: Column, n: Column) -> Column:
    """m after n."""
    return linear(m["gain"] * n["gain"], m["gain"] * n["offset"] + m["offset"])


def gain_factor(c: list[Column], u: Column, v: Column) -> Column:
    """exp of a quadratic in u and v without a constant: x, y, xx, xy, yy."""
    return F.exp(c[0] * u + c[1] * v + c[2] * u * u + c[3] * u * v + c[4] * v * v)


def gain_bounds(c: list[Column], u: tuple[Column, Column], v: tuple[Column, Column]) -> tuple[Column, Column]:
    """Bounds of gain_factor over a rectangle, from the range of each term; extremes inside are covered too."""
    def square(a: tuple[Column, Column]) -> tuple[Column, Column]:
        low = F.when((a[0] <= 0) & (a[1] >= 0), 0.0).otherwise(F.least(a[0] * a[0], a[1] * a[1]))
        return low, F.greatest(a[0] * a[0], a[1] * a[1])

    corners = [u[0] * v[0], u[0] * v[1], u[1] * v[0], u[1] * v[1]]
    terms = [u, v, square(u), (F.least(*corners), F.greatest(*corners)), square(v)]
    low = sum((F.least(k * a, k * b) for k, (a, b) in zip(c[1:], terms[1:])), F.least(c[0] * u[0], c[0] * u[1]))
    high = sum((F.greatest(k * a, k * b) for k, (a, b) in zip(c[1:], terms[1:])), F.greatest(c[0] * u[0], c[0] * u[1]))
    return F.exp(low), F.exp(high)


def arcseconds(diameter: Column, pitch_um: Column, focal_mm: Column) -> Column:
    """An angle from pixels; null where the optics are unknown or not positive."""
    return F.when((pitch_um > 0) & (focal_mm > 0), diameter * 206.265 * pitch_um / focal_mm)
