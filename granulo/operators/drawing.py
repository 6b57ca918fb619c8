"""Pictures as SVG text: circles over an image, and distributions. A picture is a row of a table (one for each data set) or,
for a distribution, a text made of its bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions import geometry as G

#: Ends of the scale by which values become colours.
LOW, HIGH = (0, 0, 255), (255, 0, 0)


def hex_colour(c: Column) -> Column:
    """`#rrggbb` of an array of whole channels."""
    return F.concat(F.lit("#"), F.array_join(F.transform(F.slice(c, 1, 3), lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), ""))


def colour_by(value: str, low: tuple[int, ...] = LOW, high: tuple[int, ...] = HIGH, levels: int | None = None) -> Column:
    """The colour of a value by its place between the least and the greatest of its data set; with levels, in so many steps.
    Where all are equal, and where there is none, it is the low end."""
    w = Window.partitionBy("ds_id")
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    t = F.coalesce(G.ratio(F.col(value) - lo, hi - lo), F.lit(0.0))
    if levels and levels > 1:
        t = F.least(F.lit(1.0), F.floor(t * levels) / (levels - 1))
    return hex_colour(F.array(*[(F.lit(a) + t * (b - a)).cast("int") for a, b in zip(low, high, strict=True)]))


def colour_by_type(kind: str = "type") -> Column:
    return G.type_colour(F.col(kind))


def overlay(circles: DataFrame, colour: Column, alpha: float = 0.2, labels: bool = True, size: DataFrame | None = None) -> DataFrame:
    """(ds_id, svg): the circles (ds_id, ID, X, Y, D, in pixels) of each data set, filled with an opacity of alpha and
    outlined, small ones above large ones. size (ds_id, width, height): the images'; without it the picture ends where the
    circles do. What one image shows fits one row."""
    n = lambda c: F.round(c, 3).cast("string")
    shape = F.concat(F.lit('<circle cx="'), n(F.col("X")), F.lit('" cy="'), n(F.col("Y")), F.lit('" r="'), n(F.col("D") / 2), F.lit('" fill="'), F.col("colour"), F.lit(f'" fill-opacity="{alpha}" stroke="'), F.col("colour"), F.lit('"/>'))
    if labels:
        shape = F.concat(shape, F.lit('<text x="'), n(F.col("X")), F.lit('" y="'), n(F.col("Y")), F.lit('">'), F.col("ID").cast("string"), F.lit("</text>"))
    rows = circles.withColumn("colour", F.coalesce(colour, F.lit("black"))).select("ds_id", F.struct((-F.col("D")).alias("d"), "ID", shape.alias("s")).alias("x"), (F.col("X") + F.col("D") / 2).alias("right"), (F.col("Y") + F.col("D") / 2).alias("below"))
    drawn = rows.groupBy("ds_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "").alias("s"), F.ceil(F.max("right")).alias("right"), F.ceil(F.max("below")).alias("below"))
    if size is not None:
        drawn = drawn.join(size.select("ds_id", "width", "height"), "ds_id", "left")
    else:
        drawn = drawn.withColumn("width", F.lit(None).cast("long")).withColumn("height", F.lit(None).cast("long"))
    box = F.concat_ws(" ", F.lit("0 0"), F.coalesce("width", "right").cast("string"), F.coalesce("height", "below").cast("string"))
    return drawn.select("ds_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), box, F.lit('">'), F.col("s"), F.lit("</svg>")).alias("svg"))


def plot_distribution(dist: DataFrame, norm: bool = False, step: bool = False, width: int = 600, height: int = 400) -> str:
    """A distribution's bars (or, with step, its outline) and its running share as a line. norm: shares in percent, not
    counts. Only the bins reach the driver."""
    rows = dist.orderBy("bin").select("left", "right", "counts", "counts_norm", "cummulative_norm").collect()
    if not rows:
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}"></svg>'
    value = [100 * (r.counts_norm or 0.0) if norm else float(r.counts) for r in rows]
    lo, hi, top = rows[0].left, rows[-1].right, max(*value, 0.0) or 1.0
    x = lambda v: round((v - lo) / ((hi - lo) or 1.0) * width, 2)
    y = lambda v, most: round(height - v / most * height, 2)
    if step:
        points = " ".join(f"{x(e)},{y(v, top)}" for r, v in zip(rows, value, strict=True) for e in (r.left, r.right))
        bars = f'<polyline fill="none" stroke="blue" points="{points}"/>'
    else:
        bars = "".join(f'<rect x="{x(r.left)}" y="{y(v, top)}" width="{round(x(r.right) - x(r.left), 2)}" height="{round(height - y(v, top), 2)}" fill="blue"><title>{r.left} to {r.right}: {v}</title></rect>' for r, v in zip(rows, value, strict=True))
    line = " ".join(f"{x(r.right)},{y(r.cummulative_norm or 0.0, 1.0)}" for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{bars}<polyline fill="none" stroke="red" points="{line}"/></svg>'
