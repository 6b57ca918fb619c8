"""Exact quantiles by ranks, without a task that holds all values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group's range of values. Only those that hold a rank in question are put in order.
CELLS = 1024


def quantiles(rows: DataFrame, by: list[str], asked: dict[str, tuple[str, float]]) -> DataFrame:
    """by and, for each name of asked, the quantile (column, p) of every group, between neighbours in proportion. Missing
    values don't count; a group without any has null. Columns are counted by value first, which map-side sums keep small; the
    counts of CELLS cells tell in which of them a rank lies. Counts are kept, as they are read again and again."""
    columns = sorted({c for c, _ in asked.values()})
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("col__"), F.col(c).cast("double").alias("v__")) for c in columns]))
    flat = rows.select(*by, value.alias("x__")).select(*by, "x__.*").filter("v__ is not null")
    key = [*by, "col__"]
    counts = flat.groupBy(*key, "v__").agg(F.count("*").alias("c__")).cache()
    size = counts.groupBy(*key).agg(F.min("v__").alias("lo__"), F.max("v__").alias("hi__"), F.sum("c__").alias("n__"))
    part = F.when(F.col("hi__") > F.col("lo__"), F.floor((F.col("v__") - F.col("lo__")) / (F.col("hi__") - F.col("lo__")) * CELLS)).otherwise(F.lit(0)).cast("int")
    celled = counts.join(F.broadcast(size) if not by else size, key).withColumn("cell__", part)
    wanted = F.array(*[F.struct(F.lit(name).alias("name__"), F.lit(c).alias("of__"), F.lit(float(p)).alias("p__")) for name, (c, p) in asked.items()])
    at = size.select(*key, "n__", F.explode(wanted).alias("w__")).select(*key, "n__", "w__.*").filter("of__ = col__")
    place = F.col("p__") * (F.col("n__") - 1)
    at = at.select(*key, "name__", (place - F.floor(place)).alias("part__"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank__"))
    cells = celled.groupBy(*key, "cell__").agg(F.sum("c__").alias("m__"))
    cells = cells.withColumn("before__", F.sum("m__").over(Window.partitionBy(*key).orderBy("cell__")) - F.col("m__"))
    hit = at.join(cells, key).filter("rank__ >= before__ and rank__ < before__ + m__").select(*key, "name__", "part__", "rank__", "cell__", "before__").distinct()
    inside = celled.join(hit.select(*key, "cell__").distinct(), [*key, "cell__"], "left_semi")
    inside = inside.withColumn("to__", F.sum("c__").over(Window.partitionBy(*key, "cell__").orderBy("v__")))
    found = hit.join(inside, [*key, "cell__"]).filter("rank__ < before__ + to__ and rank__ >= before__ + to__ - c__")
    found = found.groupBy(*by, "name__").agg(F.min("v__").alias("a__"), F.max("v__").alias("b__"), F.first("part__").alias("part__"))
    found = found.withColumn("q__", F.col("a__") + (F.col("b__") - F.col("a__")) * F.col("part__"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name__") == name, F.col("q__"))).alias(name) for name in asked])
