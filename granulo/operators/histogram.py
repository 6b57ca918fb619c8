"""Size and count distributions over bins that are closed on the right."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions import geometry as G

COUNT_COLUMNS = ["left", "mid", "right", "width", "counts", "cummulative", "counts_norm", "cummulative_norm"]
VOLUME_COLUMNS = ["volume", "volume_cummulative", "volume_norm", "volume_cummulative_norm"]


def bin_edges(start: float = 0.0, end: float = 10e-6, periods: float = 20, log: bool = False, step: bool = False) -> list[float]:
    """Edges from start to end: `periods` bins, or bins of width `periods` (which may end beyond); in powers of ten with
    log, where widths are exponents."""
    if log:
        if start <= 0 or end <= 0:
            raise ValueError("a logarithmic scale needs bounds above 0")
        a, b = math.log10(start), math.log10(end)
        e = np.arange(a, b + periods, periods) if step else np.linspace(a, b, int(periods) + 1)
        return [float(10.0**x) for x in e]
    return [float(x) for x in (np.arange(start, end + periods, periods) if step else np.linspace(start, end, int(periods) + 1))]


def parse_edges(text: str, low: float, high: float) -> list[float]:
    """Edges from an older text form: `[a, b, ...]`, `start, end, n`, `start, end, step, n` (n ignored), or `n` bins from
    low to high."""
    text = text.strip()
    if text.startswith("["):
        return [float(x) for x in text.strip("[]").split(",")]
    parts = [float(x) for x in text.split(",")]
    if len(parts) == 1:
        return bin_edges(low, high, parts[0])
    if len(parts) == 3:
        return bin_edges(*parts)
    if len(parts) == 4:
        return bin_edges(parts[0], parts[1], parts[2], step=True)
    raise ValueError(f"no bins in {text!r}")


def auto_edges(values: DataFrame, column: str = "D") -> list[float]:
    """20 bins between the powers of ten around the least and the greatest value; one row reaches the driver."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    if lo is None:
        raise ValueError("no values to set bins by")
    power = lambda v, f: 10.0 ** f(math.log10(abs(v))) if v else 0.0
    return bin_edges(power(lo, math.floor), power(hi, math.ceil), 20)


def _rounded(x: float, digits: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    whole = math.floor(abs(x))
    places = digits if whole else -math.floor(math.log10(abs(x))) - 1 + digits
    return round(x, places)


def labels(edges: list[float], mode: str = "exact") -> list[tuple[float, float]]:
    """Left and right of each bin as reported: exact, or rounded to 3 digits with the first left lowered (`pandas`)."""
    if mode == "exact":
        return list(zip(edges, edges[1:], strict=False))
    for digits in range(3, 20):
        r = [_rounded(x, digits) for x in edges]
        if len(set(r)) == len(r):
            break
    return [(r[0] - 10.0**-digits if i == 0 else r[i], r[i + 1]) for i in range(len(r) - 1)]


def bins(spark, edges: list[float], label_mode: str = "exact") -> DataFrame:
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(labels(edges, label_mode))]
    return spark.createDataFrame(rows, "bin int, left double, right double")


def bin_of(value, edges: list[float]):
    """The number of the bin (left, right] that holds a value, the first one with its left edge; null outside."""
    arr = F.array(*[F.lit(float(x)) for x in edges])
    below = F.size(F.filter(arr, lambda e: e < value))
    inside = (value >= edges[0]) & (value <= edges[-1])
    return F.when(inside, F.greatest(below - 1, F.lit(0)))


def distribution(values: DataFrame, column: str, edges: list[float], volume: bool = True, label_mode: str = "exact") -> DataFrame:
    """Counts, and volumes of spheres of the bins' middles, with running sums and shares; empty bins stay, values outside
    don't count. One partial aggregation of at most as many rows as bins crosses the network."""
    counted = values.select(bin_of(F.col(column).cast("double"), edges).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    d = bins(values.sparkSession, edges, label_mode).join(counted, "bin", "left")
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("counts", F.coalesce("n", F.lit(0)).cast("long")).withColumn("mid", (F.col("left") + F.col("right")) / 2).withColumn("width", F.col("right") - F.col("left"))
    d = d.withColumn("cummulative", F.sum("counts").over(run)).withColumn("counts_norm", G.ratio(F.col("counts"), F.sum("counts").over(every)))
    d = d.withColumn("cummulative_norm", F.sum("counts_norm").over(run))
    if volume:
        d = d.withColumn("volume", F.col("counts") * F.pi() / 6 * F.pow("mid", F.lit(3.0))).withColumn("volume_cummulative", F.sum("volume").over(run))
        d = d.withColumn("volume_norm", G.ratio(F.col("volume"), F.sum("volume").over(every))).withColumn("volume_cummulative_norm", F.sum("volume_norm").over(run))
    return d.select("bin", *COUNT_COLUMNS, *(VOLUME_COLUMNS if volume else []))


def select_distribution(dist: DataFrame, orientation: str = "mid", norm: bool = False, cumulative: bool = False) -> DataFrame:
    """Two columns: where a bin is (left, mid or center, right) and a count or share, running or not."""
    x = {"left": "left", "mid": "mid", "center": "mid", "right": "right"}[orientation]
    y = ("cummulative" if cumulative else "counts") + ("_norm" if norm else "")
    return dist.select(x, y)
