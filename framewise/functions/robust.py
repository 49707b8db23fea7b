"""Column functions: rounding, robust weights, tone and sky geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def micro(x: Column) -> Column:
    """x to a millionth, halves up: the same in any engine that has floor()."""
    return F.floor(x * 1000000 + 0.5) / 1000000


def tukey_weight(r: Column, k: Column) -> Column:
    u = r / k
    return F.when(F.abs(r) < k, (1 - u * u) * (1 - u * u)).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0031308)), F.lit(1 / 2.4)) - 0.055)


def srgb_decode(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((F.greatest(x, F.lit(0.04045)) + 0.055) / 1.055, F.lit(2.4)))


def midtone(x: Column, m: Column) -> Column:
    """The midtone curve through (0, 0), (m, 1/2) and (1, 1)."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def tangent_plane(ra: Column, dec: Column, ra0: float, dec0: float) -> tuple[Column, Column]:
    """Gnomonic projection about (ra0, dec0), all in degrees; null on the far side."""
    a, d = F.radians(ra - ra0), F.radians(dec)
    s0, c0 = math.sin(math.radians(dec0)), math.cos(math.radians(dec0))
    w = s0 * F.sin(d) + c0 * F.cos(d) * F.cos(a)
    x = F.degrees(F.cos(d) * F.sin(a) / w)
    y = F.degrees((c0 * F.sin(d) - s0 * F.cos(d) * F.cos(a)) / w)
    return F.when(w > 1e-6, x), F.when(w > 1e-6, y)
