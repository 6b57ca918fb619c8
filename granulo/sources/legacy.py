"""The older key-value files (`;` between) and ignore lists."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_values(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, key, value, unit) of key;value[;unit] files."""
    rows = spark.read.option("encoding", encoding).text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", ";").alias("p"))
    trimmed = lambda i: F.nullif(F.trim(F.get("p", F.lit(i))), F.lit(""))
    return rows.select("file", trimmed(0).alias("key"), trimmed(1).alias("value"), trimmed(2).alias("unit")).filter("key is not null")


def image_settings(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A row for each file: img_name, magnification, Dmin, Dmax."""
    wide = key_values(spark, path, encoding).groupBy("file").pivot("key", ["img_name", "magnification", "Dmin", "Dmax"]).agg(F.first("value"))
    return wide.select("file", "img_name", *[F.col(c).try_cast("double").alias(c) for c in ("magnification", "Dmin", "Dmax")])


def not_ignored(datasets: DataFrame, ignore: DataFrame) -> DataFrame:
    """Data sets (ds_id) whose name is part of no entry of an ignore list (name). The list is a file a person keeps; the
    join is nested because the test is for a part of a text."""
    return datasets.join(ignore, ignore["name"].contains(datasets["ds_id"]), "left_anti")


def find_datasets(folder: str | Path, ignore: bool = True, config: str = "_names.csv", formats: tuple[str, ...] = (".tif",)) -> list[Path]:
    """Folders at any depth that hold a key-value file `<name><config>` and an image; with ignore, not those whose image is
    named in an ignore.csv beside or above them. Driver-side."""
    out = []
    for d in sorted(p for p in Path(folder).rglob("*") if p.is_dir()):
        images = [p for p in sorted(d.iterdir()) if p.suffix in formats]
        if not images or not any(p.name.endswith(config) for p in d.iterdir()):
            continue
        above = [p for p in (d, *d.parents) if p == Path(folder) or Path(folder) in p.parents]
        entries = [x.strip() for p in above if (p / "ignore.csv").is_file() for x in (p / "ignore.csv").read_text(encoding="utf-8").split("\n") if x.strip()]
        if not (ignore and any(i.name in e for i in images for e in entries)):
            out.append(d)
    return out


def activate(ignore: DataFrame, names: DataFrame) -> DataFrame:
    """The ignore list without names."""
    return ignore.join(names, "name", "left_anti")


def deactivate(ignore: DataFrame, names: DataFrame) -> DataFrame:
    """The ignore list with names."""
    return ignore.select("name").unionByName(names.select("name")).distinct()
