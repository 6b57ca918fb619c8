"""From a source's rows to particles: diameter, scale, one row for each ID, derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulo.errors import EmptySourceError, UnknownIdError
from granulo.functions import geometry as G

#: Order of columns of a particle table.
COLUMNS = ["ds_id", "ID", "name", "D", "X", "Y", "area", "volume"]


def with_diameter(source: DataFrame) -> DataFrame:
    """ds_id, ID long and X, Y, D, R double; whichever of D and R is missing follows from the other."""
    have = set(source.columns)
    if not {"D", "R"} & have:
        raise EmptySourceError("a source needs D or R")
    d = F.col("D").cast("double") if "D" in have else F.col("R").cast("double") * 2
    r = F.col("R").cast("double") if "R" in have else F.col("D").cast("double") / 2
    return source.select("ds_id", F.col("ID").cast("long").alias("ID"), F.col("X").cast("double").alias("X"), F.col("Y").cast("double").alias("Y"), d.alias("D"), r.alias("R"))


def scale(pixels: DataFrame, info: DataFrame) -> DataFrame:
    """Lengths times the pixel size of their data set (info: ds_id, px_size). Data sets without a size, or of size 0, are
    left out; missing_scale() lists them."""
    px = info.select("ds_id", F.col("px_size").cast("double").alias("px_size")).filter("px_size <> 0")
    j = pixels.join(px, "ds_id")
    return j.select("ds_id", "ID", *[(F.col(c) * F.col("px_size")).alias(c) for c in ("X", "Y", "D", "R")])


def require_scale(pixels: DataFrame, info: DataFrame) -> None:
    """Raises if a data set with particles has no usable pixel size."""
    lost = [r[0] for r in missing_scale(pixels, info).orderBy("ds_id").limit(5).collect()]
    if lost:
        raise EmptySourceError(f"no pixel size for data sets {lost}; settings or image tags must tell it")


def missing_scale(pixels: DataFrame, info: DataFrame) -> DataFrame:
    """Data sets with particles that have no usable pixel size."""
    return pixels.select("ds_id").distinct().join(info.filter("px_size <> 0"), "ds_id", "left_anti")


def dedupe(rows: DataFrame, duplicate_id: str = "last") -> DataFrame:
    """One row for each (ds_id, ID). `last`: the one of least R stays, as when rows come from large to small and later
    ones replace earlier. `reassign`: all rows stay and IDs are dealt anew, larger first. Rows are sorted by ID before the
    name of the data set, as numbers that differ sort faster than texts that don't."""
    ties = [F.col("X"), F.col("Y")]
    if duplicate_id == "last":
        w = Window.partitionBy("ID", "ds_id").orderBy(F.col("R"), *ties)
        return rows.withColumn("k__", F.row_number().over(w)).filter("k__ = 1").drop("k__")
    if duplicate_id == "reassign":
        w = Window.partitionBy("ds_id").orderBy(F.col("R").desc(), F.col("ID"), *ties)
        return rows.withColumn("ID", (F.row_number().over(w) - 1).cast("long"))
    raise ValueError(f"duplicate_id {duplicate_id!r}")


def derive(rows: DataFrame) -> DataFrame:
    """COLUMNS of rows (ds_id, ID, X, Y, D)."""
    return rows.select("ds_id", "ID", F.concat(F.lit("P"), F.col("ID").cast("string")).alias("name"), "D", "X", "Y", G.area(F.col("D")).alias("area"), G.volume(F.col("D")).alias("volume"))


def particles(source: DataFrame, info: DataFrame | None = None, duplicate_id: str = "last") -> DataFrame:
    """Particles of a source in pixels (with info: in metres)."""
    rows = with_diameter(source)
    return derive(dedupe(scale(rows, info) if info is not None else rows, duplicate_id))


def by_ids(parts: DataFrame, ids: list[int]) -> DataFrame:
    """The particles of a list of IDs, in its order (column pos). An ID that no data set has raises."""
    wanted = parts.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, ID long")
    found = parts.join(F.broadcast(wanted), "ID")
    missing = set(ids) - {r[0] for r in found.select("ID").distinct().collect()}  # no more rows than ids
    if missing:
        raise UnknownIdError(f"no particle has ID {sorted(missing)}")
    return found.orderBy("ds_id", "pos")


def largest(parts: DataFrame) -> DataFrame:
    """For each data set its largest particle; the least ID of equals."""
    return parts.groupBy("ds_id").agg(F.max(F.struct("D", (-F.col("ID")).alias("minus"))).alias("m")).select("ds_id", (-F.col("m.minus")).alias("ID"), F.col("m.D").alias("D"))


def smallest(parts: DataFrame) -> DataFrame:
    """For each data set its smallest particle; the least ID of equals."""
    return parts.groupBy("ds_id").agg(F.min(F.struct("D", "ID")).alias("m")).select("ds_id", "m.ID", "m.D")


def diameter_range(parts: DataFrame) -> DataFrame:
    """Least and greatest D of each data set, and over all of them the same in all_min and all_max."""
    per = parts.groupBy("ds_id").agg(F.min("D").alias("min_D"), F.max("D").alias("max_D"))
    return per.crossJoin(F.broadcast(parts.agg(F.min("D").alias("all_min"), F.max("D").alias("all_max"))))


def without_source(datasets: DataFrame, parts: DataFrame) -> DataFrame:
    """Data sets that have no particles yet."""
    return datasets.join(parts.select("ds_id").distinct(), "ds_id", "left_anti")


def exclude(datasets: DataFrame, names: DataFrame) -> DataFrame:
    """Data sets that an exclude list (ds_id) doesn't name."""
    return datasets.join(names.select("ds_id"), "ds_id", "left_anti")


def union_passes(passes: list[DataFrame]) -> DataFrame:
    """Detection passes one after another; nothing is merged, IDs run on from 0 by (pass, place)."""
    every = None
    for k, p in enumerate(passes):
        p = p.withColumn("pass", F.lit(k))
        every = p if every is None else every.unionByName(p)
    w = Window.partitionBy("ds_id").orderBy("pass", "place")
    return every.withColumn("ID", (F.row_number().over(w) - 1).cast("long"))
