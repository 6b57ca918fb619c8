"""Particle files: three layouts of columns, recognised by the header's names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulo.errors import ParticleCsvError

#: The columns by which each layout is known.
LAYOUTS = {
    "native": {"ID", "X", "Y", "R"},
    "imagej": {"Index", "Type", "X", "Y", "Width", "Height"},
    "legacy": {"ID", "X (pixels)", "Y (pixels)", "Radius (pixels)"},
}
_TEXT = {"Type", "Name", "Color", "Fill", "Group", "Pos", " ", ""}


def recognise(columns: list[str]) -> str:
    """The layout whose columns are all there. Of several, the native one if it is among them; else an error."""
    fits = [k for k, need in LAYOUTS.items() if need <= set(columns)]
    if len(fits) > 1 and "native" in fits:
        return "native"
    if len(fits) != 1:
        raise ParticleCsvError(f"columns {columns} fit {fits or 'no layout'}")
    return fits[0]


def _read(spark: SparkSession, path, encoding: str) -> DataFrame:
    return spark.read.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def header(spark: SparkSession, path, encoding: str = "UTF-8") -> list[str]:
    """The column names of a file; no row is read."""
    return _read(spark, path, encoding).columns


def from_native(df: DataFrame) -> DataFrame:
    return df.withColumn("ID", F.col("ID").cast("double").cast("long")).withColumns({c: F.col(c).cast("double") for c in ("X", "Y", "R")})


def from_legacy(df: DataFrame) -> DataFrame:
    return from_native(df.withColumnsRenamed({"X (pixels)": "X", "Y (pixels)": "Y", "Radius (pixels)": "R"}))


def is_circle():
    return (F.col("Type") == "Oval") & (F.col("Width").cast("double") == F.col("Height").cast("double"))


def dropped(df: DataFrame) -> DataFrame:
    """Index of regions that are no circles."""
    return df.filter(~F.coalesce(is_circle(), F.lit(False))).select("Index")


def from_imagej(df: DataFrame) -> DataFrame:
    """Regions anchored at a corner become circles by their centre."""
    r = F.col("Width").cast("double") / 2
    keep = [c for c in df.columns if c in ("ds_id",)]
    return df.filter(is_circle()).select(*keep, F.col("Index").cast("double").cast("long").alias("ID"), (F.col("X").cast("double") + r).alias("X"), (F.col("Y").cast("double") + r).alias("Y"), F.col("Width").cast("double").alias("D"), r.alias("R"))


_FROM = {"native": from_native, "legacy": from_legacy, "imagej": from_imagej}


def load(spark: SparkSession, path: str, ds_id: str | None = None, encoding: str = "UTF-8", layout: str | None = None) -> DataFrame:
    """The rows of a particle file in pixels, with ds_id (by default the name of the file's folder)."""
    df = _read(spark, path, encoding)
    kind = layout or recognise(df.columns)
    name = F.lit(ds_id) if ds_id is not None else F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return _FROM[kind](df.withColumn("ds_id", name))


def load_many(spark: SparkSession, files: dict[str, str], encoding: str = "UTF-8") -> DataFrame:
    """Rows of the particle files of several data sets (ds_id: path). Files of one layout are read together."""
    groups: dict[tuple, dict[str, str]] = {}
    for ds, path in files.items():
        columns = header(spark, path, encoding)
        groups.setdefault((recognise(columns), tuple(columns)), {})[ds] = path
    every = None
    for (kind, _), mine in groups.items():
        df = _read(spark, list(mine.values()), encoding)
        names = spark.createDataFrame([(p.replace("file://", "").replace("file:", ""), ds) for ds, p in mine.items()], "p string, ds_id string")
        path = F.url_decode(F.regexp_replace("_metadata.file_path", "^file:/*", "/"))
        rows = _FROM[kind](df.withColumn("p", path).join(F.broadcast(names), "p").drop("p"))
        rows = rows.select("ds_id", "ID", "X", "Y", "R")
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        raise ParticleCsvError("no particle files")
    return every
