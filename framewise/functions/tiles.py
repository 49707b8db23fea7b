"""Planes held as one array, row after row, worked on in place: no row is exploded, and nothing is shuffled.

Functions take a column of doubles and the plane's width; heights follow from the array's size."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(f):
    """f(plane, ...) with the plane's expression computed once, however often f reads it."""
    @functools.wraps(f)
    def bound(value: Column | str, *args, **kwargs) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return bind(value, lambda p: f(p, *args, **kwargs))

    return bound


def bind(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _at(plane: Column, i: Column) -> Column:
    return F.element_at(plane, (i + 1).cast("int"))


@_once
def mean(plane: Column) -> Column:
    return total(plane) / F.size(plane)


def total(plane: Column) -> Column:
    return F.aggregate(plane, F.lit(0.0), lambda s, v: s + v)


def mean_square(plane: Column) -> Column:
    return F.aggregate(plane, F.lit(0.0), lambda s, v: s + v * v) / F.size(plane)


@_once
def blur3(plane: Column, width: int) -> Column:
    """1-2-1 along both axes; a border value stands for its missing neighbour."""
    last = F.size(plane) - width
    across = F.transform(plane, lambda v, i: (F.when(i % width > 0, _at(plane, i - 1)).otherwise(v) + 2 * v + F.when(i % width < width - 1, _at(plane, i + 1)).otherwise(v)) / 4)
    # The first pass is bound once, so that the second doesn't compute it anew for each neighbour.
    down = lambda p: F.transform(p, lambda v, i: (F.when(i >= width, _at(p, i - width)).otherwise(v) + 2 * v + F.when(i < last, _at(p, i + width)).otherwise(v)) / 4)
    return bind(across, down)


def blur_n(plane: Column, width: int, times: int) -> Column:
    for _ in range(times):
        plane = bind(plane, lambda p: blur3(p, width))
    return plane


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


@_once
def downsample2(plane: Column, width: int) -> Column:
    """Means of 2 by 2 values; an odd last row or column is left out."""
    half = width // 2
    places = F.sequence(F.lit(0), (F.floor(F.size(plane) / (2 * width)) * half).cast("int") - 1)

    def four(k: Column) -> Column:
        i = F.floor(k / half) * (2 * width) + k % half * 2
        return (_at(plane, i) + _at(plane, i + 1) + _at(plane, i + width) + _at(plane, i + width + 1)) / 4

    return F.transform(places, four)


def _inner(plane: Column, width: int) -> Column:
    """Places that have all four neighbours."""
    return F.filter(F.sequence(F.lit(0), F.size(plane) - 1), lambda i: (i >= width) & (i < F.size(plane) - width) & (i % width > 0) & (i % width < width - 1))


@_once
def tensor(plane: Column, width: int) -> Column:
    """Struct (a, b, c): means of gx gx, gx gy and gy gy of central differences (not halved) over the inner values."""
    gx, gy = (lambda i: _at(plane, i + 1) - _at(plane, i - 1)), (lambda i: _at(plane, i + width) - _at(plane, i - width))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    add = lambda s, i: F.struct((s["a"] + gx(i) * gx(i)).alias("a"), (s["b"] + gx(i) * gy(i)).alias("b"), (s["c"] + gy(i) * gy(i)).alias("c"))
    n = (width - 2) * (F.size(plane) / width - 2)
    return F.aggregate(_inner(plane, width), zero, add, lambda s: F.struct((s["a"] / n).alias("a"), (s["b"] / n).alias("b"), (s["c"] / n).alias("c")))


@_once
def energy(plane: Column, width: int) -> Column:
    """Each value's squared gradient by central differences (not halved), null at the border."""
    def one(v: Column, i: Column) -> Column:
        gx, gy = _at(plane, i + 1) - _at(plane, i - 1), _at(plane, i + width) - _at(plane, i - width)
        return F.when((i >= width) & (i < F.size(plane) - width) & (i % width > 0) & (i % width < width - 1), gx * gx + gy * gy)

    return F.transform(plane, one)


@_once
def tenengrad(plane: Column, width: int) -> Column:
    """Mean squared gradient."""
    gx, gy = (lambda i: _at(plane, i + 1) - _at(plane, i - 1)), (lambda i: _at(plane, i + width) - _at(plane, i - width))
    n = (width - 2) * (F.size(plane) / width - 2)
    return F.aggregate(_inner(plane, width), F.lit(0.0), lambda s, i: s + (gx(i) * gx(i) + gy(i) * gy(i))) / n


def anisotropy(plane: Column, width: int) -> Column:
    """(l1 - l2) / (l1 + l2) of the gradient tensor's eigenvalues."""
    return bind(tensor(plane, width), lambda t: F.when(t["a"] + t["c"] > 1e-20, F.sqrt((t["a"] - t["c"]) * (t["a"] - t["c"]) + 4 * t["b"] * t["b"]) / (t["a"] + t["c"])).otherwise(0.0))


def multiscale_laplacian(plane: Column, width: int, height: int, levels: int = 3) -> Column:
    """Energy of what a blur takes away, at up to three scales with weights 1, 1/2, 1/4; a scale is at least 8 values wide and high."""
    if levels == 0 or width < 8 or height < 8:
        return F.lit(0.0)

    def level(p: Column) -> Column:
        return bind(blur3(p, width), lambda b: mean_square(minus(p, b)) + 0.5 * multiscale_laplacian(downsample2(b, width), width // 2, height // 2, levels - 1))

    return bind(plane, level)


@_once
def local_contrast(plane: Column, width: int) -> Column:
    """Root mean square of what two blurs take away."""
    return F.sqrt(mean_square(minus(plane, blur_n(plane, width, 2))))


@_once
def estimated_blur(plane: Column, width: int) -> Column:
    """The blur radius that fits how much gradient energy two more blurs take away."""
    def solve(e0: Column, e1: Column) -> Column:
        r = F.least(F.greatest(e1 / e0, F.lit(1e-6)), F.lit(0.999999))
        return F.when(e0 <= 1e-20, 10.0).otherwise(F.sqrt(r / (1 - r)))

    pair = F.struct(tenengrad(plane, width).alias("e0"), tenengrad(blur_n(plane, width, 2), width).alias("e1"))
    return bind(pair, lambda s: solve(s["e0"], s["e1"]))


@_once
def excess(plane: Column, width: int, reach: int = 2) -> Column:
    """Each value less the mean of the middle two of the four neighbours `reach` away; null where one is missing."""
    def one(v: Column, i: Column) -> Column:
        x, last = i % width, F.size(plane) - reach * width
        known = (x >= reach) & (x < width - reach) & (i >= reach * width) & (i < last)
        four = [_at(plane, i - reach), _at(plane, i + reach), _at(plane, i - reach * width), _at(plane, i + reach * width)]
        return F.when(known, v - (sum(four[1:], four[0]) - F.least(*four) - F.greatest(*four)) / 2)

    return F.transform(plane, one)


def pair_sums(a: Column, b: Column) -> Column:
    """Struct (n, x, y, xx, yy, xy, dd): the number, sums, squares, products and squared differences of two planes' values."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "yy", "xy", "dd")])
    two = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        d = x - y
        return F.struct((s["x"] + x).alias("x"), (s["y"] + y).alias("y"), (s["xx"] + x * x).alias("xx"), (s["yy"] + y * y).alias("yy"), (s["xy"] + x * y).alias("xy"), (s["dd"] + d * d).alias("dd"))

    return F.aggregate(two, zero, add)


@_once
def detrended(plane: Column, width: int) -> Column:
    """Struct (mean, var) of a square plane: the mean, and the variance about the fitted plane with n - 3 degrees of freedom."""
    c, n = (width - 1) / 2, width * width
    suu = n * (n - 1) / 12
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("s", "ss", "su", "sw")])
    u, w = (lambda i: i % width - c), (lambda i: F.floor(i / width) - c)

    def add(s: Column, p: Column) -> Column:
        v, i = p["v"], p["i"]
        return F.struct((s["s"] + v).alias("s"), (s["ss"] + v * v).alias("ss"), (s["su"] + u(i) * v).alias("su"), (s["sw"] + w(i) * v).alias("sw"))

    def end(s: Column) -> Column:
        rest = s["ss"] - s["s"] * s["s"] / n - (s["su"] * s["su"] + s["sw"] * s["sw"]) / suu
        return F.struct((s["s"] / n).alias("mean"), (F.greatest(rest, F.lit(0.0)) / (n - 3)).alias("var"))

    return F.aggregate(F.transform(plane, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), zero, add, end)


def _clamped(plane: Column, width: int, height: int, x: Column, y: Column) -> Column:
    inside = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    return _at(plane, inside(y, height) * width + inside(x, width))


@_once
def bilinear(plane: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """The value between four neighbours; outside, the border's."""
    i, j = F.floor(x), F.floor(y)
    p = lambda dx, dy: _clamped(plane, width, height, i + dx, j + dy)
    a = p(0, 0) + (p(1, 0) - p(0, 0)) * (x - i)
    b = p(0, 1) + (p(1, 1) - p(0, 1)) * (x - i)
    return a + (b - a) * (y - j)


def cubic_weights(t: Column) -> list[Column]:
    """Of the four neighbours along an axis, for an interpolating cubic."""
    t2, t3 = t * t, t * t * t
    return [0.5 * (2 * t2 - t3 - t), 0.5 * (3 * t3 - 5 * t2 + 2), 0.5 * (4 * t2 - 3 * t3 + t), 0.5 * (t3 - t2)]


@_once
def bicubic(plane: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """The value between sixteen neighbours."""
    i, j = F.floor(x), F.floor(y)
    wx, wy = cubic_weights(x - i), cubic_weights(y - j)
    rows = [sum((w * _clamped(plane, width, height, i + k - 1, j + m - 1) for k, w in enumerate(wx[1:], 1)), wx[0] * _clamped(plane, width, height, i - 1, j + m - 1)) for m in range(4)]
    return sum((w * r for w, r in zip(wy[1:], rows[1:])), wy[0] * rows[0])


@_once
def dilated(mask: Column, width: int, height: int) -> Column:
    """A mask of 0 and 1, with every neighbour of a 1 (diagonal ones too)."""
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    return F.transform(mask, lambda v, i: F.greatest(*[_clamped(mask, width, height, i % width + dx, F.floor(i / width) + dy) for dx, dy in near]))


@_once
def extended_to_edge(mask: Column, width: int, height: int) -> Column:
    """A mask of 0 and 1, where border cells take over a 1 of the inner cell next to them."""
    def one(v: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        ix, iy = F.when(x == 0, 1).when(x == width - 1, width - 2).otherwise(x), F.when(y == 0, 1).when(y == height - 1, height - 2).otherwise(y)
        at = lambda a, b: _at(mask, b * width + a)
        edge = (x == 0) | (y == 0) | (x == width - 1) | (y == height - 1)
        return F.when(edge, F.greatest(v, at(ix, iy), at(ix, y), at(x, iy))).otherwise(v)

    return F.transform(mask, one)


def median(values: Column) -> Column:
    """Of an array without nulls; the mean of the middle two where their number is even."""
    pick = lambda s: (F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int")) + F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))) / 2
    return bind(F.array_sort(values), pick)


@_once
def mad_sigma(values: Column, scale: float = 1.4826) -> Column:
    return bind(F.struct(values.alias("v"), median(values).alias("m")), lambda s: scale * median(F.transform(s["v"], lambda x: F.abs(x - s["m"]))))
