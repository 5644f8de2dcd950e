"""Geometry and rounding as column expressions. A point is a struct of x and y, in mm on the paper, y down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: control points of a quarter ellipse stand at this share of the radius.
KAPPA = 0.5522847498


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"]


def length(a: Column) -> Column:
    return F.hypot(a["x"], a["y"])


def scaled(a: Column, factor: Column) -> Column:
    return point(a["x"] * factor, a["y"] * factor)


def with_length(a: Column, wanted: Column) -> Column:
    """The same direction with another length; a zero vector stays."""
    n = length(a)
    return F.when(n == 0, point(a["x"], a["y"])).otherwise(scaled(a, wanted / F.when(n == 0, 1.0).otherwise(n)))


def normalized(a: Column) -> Column:
    return with_length(a, F.lit(1.0))


def perpendicular(a: Column) -> Column:
    """A quarter turn to the right of travel."""
    return point(-a["y"], a["x"])


def rotation(a: Column) -> Column:
    """The angle of a tangent, with y down."""
    return F.atan2(a["y"], a["x"])


def round_up(v: Column) -> Column:
    """To the nearest integer, halves upward."""
    return F.floor(v + 0.5)


def round_even(v: Column) -> Column:
    """Halves to the even neighbour."""
    return F.bround(v, 0)


def round_away(v: Column) -> Column:
    """Halves away from zero."""
    return F.round(v, 0)


def native(mm: Column) -> Column:
    """Thousandths of a millimetre."""
    return round_up(mm * 1000.0).cast("long")


def is_near(a: Column, b: Column, kind: str = "double") -> Column:
    """Equal up to a relative 1e-12, as floats 1e-5."""
    a, b, scale = a.cast(kind), b.cast(kind), (1e12 if kind == "double" else 1e5)
    return F.abs(a - b) * F.lit(scale).cast(kind) <= F.least(F.abs(a), F.abs(b))


def is_zero(a: Column, kind: str = "double") -> Column:
    return F.abs(a.cast(kind)) <= F.lit(1e-12 if kind == "double" else 1e-5).cast(kind)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Shares of ink as shares of light, in single precision."""
    one = F.lit(1.0).cast("float")
    k = k.cast("float")
    light = lambda ink: one - (ink.cast("float") * (one - k) + k)
    return F.struct(light(c).alias("r"), light(m).alias("g"), light(y).alias("b"))


def mix(a: Column, b: Column, p: Column) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * p, a["y"] + (b["y"] - a["y"]) * p)


def split_bezier(a: Column, b: Column, c: Column, d: Column, p: Column) -> Column:
    """Inner control points of both parts and the point between them: five points. At p <= 0 and p >= 1 one part is
    that end alone."""
    ab, bc, cd = mix(a, b, p), mix(b, c, p), mix(c, d, p)
    abc, bcd = mix(ab, bc, p), mix(bc, cd, p)
    return F.when(p <= 0, F.array(a, a, a, b, c)).when(p >= 1, F.array(b, c, d, d, d)).otherwise(F.array(ab, abc, mix(abc, bcd, p), bcd, cd))


def ellipse(cx: Column, cy: Column, rx: Column, ry: Column) -> Column:
    """Thirteen points of four cubics, from the right by way of the bottom."""
    place = [(1, 0), (1, KAPPA), (KAPPA, 1), (0, 1), (-KAPPA, 1), (-1, KAPPA), (-1, 0), (-1, -KAPPA), (-KAPPA, -1), (0, -1), (KAPPA, -1), (1, -KAPPA), (1, 0)]
    return F.array(*[point(cx + rx * F.lit(float(u)), cy + ry * F.lit(float(v))) for u, v in place])


def placed(points: Column, at: Column, angle: Column, scale: Column) -> Column:
    """Points turned by an angle, scaled and moved."""
    c, s = F.cos(angle) * scale, F.sin(angle) * scale
    return F.transform(points, lambda p: point(p["x"] * c - p["y"] * s + at["x"], p["x"] * s + p["y"] * c + at["y"]))


def mm_per_metre(scale: Column) -> Column:
    return F.lit(1000.0) / scale


def pixels_per_mm(resolution: Column, scale: Column) -> Column:
    """resolution: pixels a metre on the ground."""
    return resolution * scale / 1000.0


def image_size(extent: Column, resolution: Column, scale: Column, frame: Column) -> Column:
    """Pixels of an image of extent(w, h) in mm with a frame of so many metres all round."""
    per = pixels_per_mm(resolution, scale)
    size = lambda mm: F.greatest(round_away((mm + 2 * frame * mm_per_metre(scale)) * per), F.lit(1.0)).cast("long")
    return F.struct(size(extent["w"]).alias("w"), size(extent["h"]).alias("h"))
