"""Pairs of circles that touch or overlap, by an equi-join on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.functions import geometry as G

#: Sizes of circles fall into this many classes at most, each of half the size of the one before.
LEVELS = 20


def gridded(parts: DataFrame, few: bool = False) -> DataFrame:
    """Each circle with its size class and the largest circle of its data set. A class's cell is at least as wide as its
    circles; the factor guards touching pairs against rounding. few: data sets are few enough to broadcast a row for each."""
    top = parts.groupBy("ds_id").agg(F.max("D").alias("top"))
    j = parts.select("ds_id", "ID", "X", "Y", "D").join(F.broadcast(top) if few else top, "ds_id")
    top_cell = F.when(F.col("top") > 0, F.col("top") * (1 + 1e-9)).otherwise(F.lit(1.0))
    level = F.when(F.col("D") > 0, F.least(F.lit(LEVELS), F.floor(F.log2(F.col("top") / F.col("D"))))).otherwise(F.lit(LEVELS)).cast("int")
    return j.select("ds_id", "ID", "X", "Y", "D", top_cell.alias("cell0"), level.alias("level"))


def _cell(x: str, level: str):
    return F.floor(F.col(x) / (F.col("cell0") / F.pow(F.lit(2.0), F.col(level).cast("double"))))


def overlap_pairs(parts: DataFrame) -> DataFrame:
    """(ds_id, a, b, Da, Db, dist) of circles with dist <= (Da + Db) / 2, each pair once. a is of the finer size class, or
    has the lesser ID in the same one.

    A circle looks for partners in its own class and all coarser ones that its data set has. As half the sum of diameters
    is at most the coarser cell's width, the partner's cell is one of nine. One giant circle makes one more class, not
    coarse cells for all."""
    g = gridded(parts)
    levels = g.groupBy("ds_id").agg(F.collect_set("level").alias("levels"))
    right = g.select("ds_id", F.col("level").alias("at"), _cell("X", "level").alias("cx"), _cell("Y", "level").alias("cy"), F.col("ID").alias("b"), F.col("X").alias("Xb"), F.col("Y").alias("Yb"), F.col("D").alias("Db"))
    left = g.join(levels, "ds_id").select("ds_id", "level", "cell0", F.col("ID").alias("a"), F.col("X").alias("Xa"), F.col("Y").alias("Ya"), F.col("D").alias("Da"), F.explode(F.filter("levels", lambda k: k <= F.col("level"))).alias("at"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = left.withColumn("gx", _cell("Xa", "at")).withColumn("gy", _cell("Ya", "at")).withColumn("o", near)
    left = left.select("ds_id", "level", "at", (F.col("gx") + F.col("o.i")).alias("cx"), (F.col("gy") + F.col("o.j")).alias("cy"), "a", "Xa", "Ya", "Da")
    dist = G.distance(F.col("Xa"), F.col("Ya"), F.col("Xb"), F.col("Yb"))
    met = left.join(right, ["ds_id", "at", "cx", "cy"]).filter("level > at or a < b")
    return met.withColumn("dist", dist).filter(F.col("dist") <= (F.col("Da") + F.col("Db")) / 2).select("ds_id", "a", "b", "Da", "Db", "dist")


def edges(pairs: DataFrame) -> DataFrame:
    """Both directions of pairs: ds_id, ID, other, D_ID, D_other, dist."""
    one = pairs.select("ds_id", F.col("a").alias("ID"), F.col("b").alias("other"), F.col("Da").alias("D"), F.col("Db").alias("D_other"), "dist")
    return one.unionByName(pairs.select("ds_id", F.col("b").alias("ID"), F.col("a").alias("other"), F.col("Db").alias("D"), F.col("Da").alias("D_other"), "dist"))


def degrees(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ds_id, ID, n_neighbours, neighbours) of every particle; IDs in order."""
    n = edges(pairs).groupBy("ds_id", "ID").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("other")).alias("neighbours"))
    return parts.select("ds_id", "ID").join(n, ["ds_id", "ID"], "left").select("ds_id", "ID", F.coalesce("n", F.lit(0)).alias("n_neighbours"), F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def contained(pairs: DataFrame) -> DataFrame:
    """(ds_id, ID) of circles inside another: dist <= (D_other - D) / 2. Equal circles at one place contain each other."""
    return edges(pairs).filter(F.col("dist") <= (F.col("D_other") - F.col("D")) / 2).select("ds_id", "ID").distinct()


def flag_contained(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """parts with the boolean idj."""
    inside = contained(pairs).withColumn("in__", F.lit(True))
    return parts.join(inside, ["ds_id", "ID"], "left").withColumn("idj", F.coalesce("in__", F.lit(False))).drop("in__")


def neighbours_of(parts: DataFrame, x: float, y: float, d: float, within: float) -> DataFrame:
    """Particles that touch a circle (x, y, d), among those whose centre is at most `within` away."""
    dist = G.distance(F.col("X"), F.col("Y"), F.lit(float(x)), F.lit(float(y)))
    return parts.withColumn("dist", dist).filter((F.col("dist") <= within) & (F.col("dist") <= (F.lit(float(d)) + F.col("D")) / 2))
