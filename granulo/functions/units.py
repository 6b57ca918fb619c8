"""Scale and magnification from image tags, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of each unit that tags use.
METRES = {"nm": 1e-9, "µm": 1e-6, "m": 1.0}


def unit_metres(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, m in METRES.items():
        out = F.when(unit == name, F.lit(m)).otherwise(out)
    return out


def magnification(text: Column) -> Column:
    """From a text such as `25.00 K X`: its first number, a thousand times that with a `K` among its words."""
    words = F.split(F.trim(text), r"\s+")
    n = F.element_at(words, 1).try_cast("double")
    return n * F.when(F.array_contains(words, "K"), 1000.0).otherwise(1.0)


def old_format(tags: Column) -> Column:
    """Whether tags lack a named pixel size, so that pixel_size() takes an unnamed number for metres."""
    return F.coalesce(tags["ap_image_pixel_size"], tags["ap_pixel_size"]).isNull() & tags[""].isNotNull()


def pixel_size(tags: Column, strict: bool = True) -> Column:
    """Metres of a pixel from a map of tags: ap_image_pixel_size, or else ap_pixel_size (`name|value|unit`), or else the
    fourth of the unnamed numbers (`||..|metres`); null where none is there. A unit that isn't known fails the query, or
    gives null if not strict."""
    named = F.coalesce(tags["ap_image_pixel_size"], tags["ap_pixel_size"])
    parts = F.split(named, r"\|")
    plain = F.get(F.split(tags[""], r"\|"), F.lit(3)).try_cast("double")
    unit = F.get(parts, F.lit(2))
    metres = unit_metres(unit)
    if strict:
        metres = F.coalesce(metres, F.raise_error(F.concat(F.lit("unknown unit of pixel size: "), F.coalesce(unit, F.lit("none")))).cast("double"))
    return F.when(named.isNotNull(), F.get(parts, F.lit(1)).try_cast("double") * metres).otherwise(plain)
