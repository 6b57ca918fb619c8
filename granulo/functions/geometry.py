"""Geometry and magnitudes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(d: Column) -> Column:
    """Of a circle of diameter d."""
    return F.pi() * F.pow(d / 2, F.lit(2.0))


def volume(d: Column) -> Column:
    """Of a sphere of diameter d."""
    return F.lit(4.0) / 3 * F.pi() * F.pow(d / 2, F.lit(3.0))


def sphere_diameter(v: Column) -> Column:
    """Of the sphere of volume v."""
    return F.pow(F.lit(6.0) * v / F.pi(), F.lit(1.0 / 3))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_to_magnitude(v: Column, order: bool = True) -> Column:
    """The power of ten at or below |v|; or, without order, v rounded down to a multiple of it. Null for 0."""
    mag = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))).cast("double"))
    return F.when(v != 0, mag if order else F.floor(v / mag) * mag)


def ceil_to_magnitude(v: Column, order: bool = True) -> Column:
    """The power of ten at or above |v|; or, without order, v rounded up to a multiple of the one below. Null for 0."""
    if order:
        return F.when(v != 0, F.pow(F.lit(10.0), F.ceil(F.log10(F.abs(v))).cast("double")))
    mag = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))).cast("double"))
    return F.when(v != 0, F.ceil(v / mag) * mag)


def rgb_to_256(c: Column) -> Column:
    """An array of channels from 0..1 to 0..255; fractions are cut off."""
    return F.transform(c, lambda x: (x * 255).cast("int"))


def rgb_to_unit(c: Column) -> Column:
    """An array of channels from 0..255 to 0..1."""
    return F.transform(c, lambda x: x.cast("double") / 255)


def rgb_shade(c: Column, factor: Column | float) -> Column:
    """An array of whole channels, of which the first three are darkened to a share of 1 - factor (fractions are cut off, and
    a factor below 0 makes them lighter); all are held within 0..255. A fourth, for opacity, stays."""
    left = F.lit(1.0) - factor
    return F.transform(c, lambda x, i: F.least(F.lit(255), F.greatest(F.lit(0), F.when(i < 3, (x * left).cast("int")).otherwise(x.cast("int")))))


#: The colours of agglomerate and particle types.
TYPE_COLOURS = {"collector": "blue", "similar": "red", "separate": "lime", "attached2coll": "blue"}


def type_colour(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, colour in TYPE_COLOURS.items():
        out = F.when(kind == name, F.lit(colour)).otherwise(out)
    return out
