"""Results as named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_detection(rows: DataFrame, folder: str) -> None:
    """Detected circles in pixels (ds_id, ID, X, Y, R) as CSV, a folder for each data set."""
    rows.select("ds_id", "ID", "X", "Y", "R").repartition("ds_id").sortWithinPartitions("ds_id", "ID").write.mode("overwrite").partitionBy("ds_id").option("header", True).csv(folder)


def write_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table below its name. CSV takes arrays as texts with commas."""
    for name, df in tables.items():
        if form == "csv":
            df = df.select(*[F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema])
        writer = df.write.mode("overwrite").format(form)
        (writer.option("header", True) if form == "csv" else writer).save(f"{folder}/{name}")
