"""A frame's projection as column expressions: lens distortion about its centre, a homography, then the output's scale and centre.

A projection is a struct (cx, cy, norm, k, p1, p2, h, ox, oy, scale), h being the nine homography entries, row after row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tiles as plane

FIELDS = ("cx", "cy", "norm", "k", "p1", "p2", "h", "ox", "oy", "scale")
# How near the inverse must come, its steps, and how often a step is halved.
TOLERANCE, STEPS, HALVINGS, LEAST_TURN, LEAST_DET, HORIZON = 1e-6, 40, 12, 1e-14, 1e-14, 1e-12


def projection(**values: Column) -> Column:
    return F.struct(*[values[n].alias(n) for n in FIELDS])


def _h(h: Column, i: int) -> Column:
    return F.get(h, F.lit(i))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _adjugate(h: Column) -> list[Column]:
    a, b, c, d, e, f, g, k, m = (_h(h, i) for i in range(9))
    return [e * m - f * k, c * k - b * m, b * f - c * e, f * g - d * m, a * m - c * g, c * d - a * f, d * k - e * g, b * g - a * k, a * e - b * d]


def inverse3(h: Column) -> Column:
    """The inverse of nine entries, up to a common factor; null where they are singular or not finite."""
    most = F.array_max(F.transform(h, F.abs))

    def of(m: Column) -> Column:
        adj = _adjugate(m)
        det = _h(m, 0) * adj[0] + _h(m, 1) * adj[3] + _h(m, 2) * adj[6]
        return plane.bind(F.struct(F.array(*adj).alias("a"), det.alias("d")), lambda s: F.when(F.abs(s["d"]) >= LEAST_DET, F.transform(s["a"], lambda v: v / s["d"])))

    usable = ~F.exists(h, lambda v: ~_finite(v)) & (most > 0)
    return plane.bind(most, lambda s: F.when(usable, plane.bind(F.transform(h, lambda v: v / s), of)))


def homogeneous(h: Column, x: Column, y: Column) -> Column:
    """(x, y) through a homography, or null at its horizon."""
    z = _h(h, 6) * x + _h(h, 7) * y + _h(h, 8)
    size = F.abs(_h(h, 6) * x) + F.abs(_h(h, 7) * y) + F.abs(_h(h, 8))
    p = F.struct(((_h(h, 0) * x + _h(h, 1) * y + _h(h, 2)) / z).alias("x"), ((_h(h, 3) * x + _h(h, 4) * y + _h(h, 5)) / z).alias("y"))
    return F.when(F.abs(z) > HORIZON * size, p)


def distorted(p: Column, x: Column, y: Column) -> Column:
    """Struct (x, y, a, b, c, d): a normalised place as the lens moves it, and the derivatives, row after row."""
    k, p1, p2 = p["k"], p["p1"], p["p2"]
    r2 = x * x + y * y
    values = {
        "x": x + k * x * r2 + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), "y": y + k * y * r2 + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y,
        "a": 1 + k * (3 * x * x + y * y) + 2 * p1 * y + 6 * p2 * x, "b": 2 * k * x * y + 2 * p1 * x + 2 * p2 * y,
        "c": 2 * k * x * y + 2 * p1 * x + 2 * p2 * y, "d": 1 + k * (x * x + 3 * y * y) + 6 * p1 * y + 2 * p2 * x,
    }
    return F.struct(*[v.alias(n) for n, v in values.items()])


def fault(p: Column) -> Column:
    """What makes a projection unusable, or null."""
    numbers = F.concat(F.array(*[p[n] for n in FIELDS if n != "h"]), p["h"])
    return F.when(F.exists(numbers, lambda v: ~_finite(v)), "nonfinite").when((p["norm"] <= 0) | (p["scale"] <= 0), "scale").when(inverse3(p["h"]).isNull(), "singular")


def _forward(p: Column, x: Column, y: Column) -> Column:
    """Of a normalised place."""
    seen = plane.bind(distorted(p, x, y), lambda u: homogeneous(p["h"], u["x"], u["y"]))
    return plane.bind(seen, lambda q: F.when(q.isNotNull(), F.struct((q["x"] * p["scale"] + p["ox"]).alias("x"), (q["y"] * p["scale"] + p["oy"]).alias("y"))))


def forward(p: Column, x: Column, y: Column) -> Column:
    """Struct (x, y) of a site in the output, or null where the projection is unusable or the site lies at its horizon."""
    return F.when(fault(p).isNull(), _forward(p, (x - p["cx"]) / p["norm"], (y - p["cy"]) / p["norm"]))


def backward(p: Column, x: Column, y: Column) -> Column:
    """The site of an output place, by Newton's method with halved steps; null where none is found whose image is within TOLERANCE."""
    start = plane.bind(inverse3(p["h"]), lambda h: homogeneous(h, (x - p["ox"]) / p["scale"], (y - p["oy"]) / p["scale"]))

    def solve(t: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def move(e: Column) -> Column:
                det = e["a"] * e["d"] - e["b"] * e["c"]
                rx, ry = e["x"] - t["x"], e["y"] - t["y"]
                sx, sy = (e["d"] * rx - e["b"] * ry) / det, (e["a"] * ry - e["c"] * rx) / det
                factors = F.array(*[F.lit(0.5**b) for b in range(HALVINGS)])

                def trial(v: Column) -> Column:
                    far = lambda f: plane.bind(distorted(p, s["x"] - v["sx"] * f, s["y"] - v["sy"] * f), lambda q: F.hypot(q["x"] - t["x"], q["y"] - t["y"]))
                    good = F.get(F.filter(factors, lambda f: far(f) < v["r"]), F.lit(0))
                    return plane.bind(good, lambda f: F.when(f.isNull(), s).otherwise(F.struct((s["x"] - v["sx"] * f).alias("x"), (s["y"] - v["sy"] * f).alias("y"))))

                parts = F.struct(sx.alias("sx"), sy.alias("sy"), F.hypot(rx, ry).alias("r"))
                return F.when(det > LEAST_TURN, plane.bind(parts, trial))

            near = plane.bind(_forward(p, s["x"], s["y"]), lambda q: F.hypot(q["x"] - x, q["y"] - y) <= TOLERANCE)
            return F.when(s.isNull() | near, s).otherwise(plane.bind(distorted(p, s["x"], s["y"]), move))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), t, step)
        close = lambda s: plane.bind(_forward(p, s["x"], s["y"]), lambda q: F.hypot(q["x"] - x, q["y"] - y) <= TOLERANCE)
        return plane.bind(found, lambda s: F.when(close(s), F.struct((s["x"] * p["norm"] + p["cx"]).alias("x"), (s["y"] * p["norm"] + p["cy"]).alias("y"))))

    return F.when(fault(p).isNull(), plane.bind(start, lambda t: F.when(t.isNotNull(), solve(t))))
