"""Byte ranges of files in the shared folder, from any process; writes appear whole or not at all."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(uri: str):
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def writer(uri: str):
    """A stream whose file gets its name at the end, so a task that runs twice leaves one whole file."""
    store, path = _at(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


def make(folder: str) -> None:
    store, path = _at(folder)
    store.create_dir(path, recursive=True)


def drop(folder: str) -> None:
    """Deletes a folder, if it is there."""
    store, path = _at(folder)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def parquet(folder: str) -> pa.Table | None:
    """The rows of a folder's Parquet files, one after another; None where there is no such folder."""
    store, path = _at(folder)
    if store.get_file_info(path).type != fs.FileType.Directory:
        return None
    names = sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet"))
    return pa.concat_tables([pq.ParquetFile(store.open_input_file(x)).read() for x in names]) if names else None


def read(uri: str, offset: int, size: int) -> bytes:
    store, path = _at(uri)
    with store.open_input_file(path) as f:
        return f.read_at(size, offset)


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length) of the files of a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def blocks(files: DataFrame, size: int, tasks: int) -> DataFrame:
    """(path, block, offset, size) of files in blocks, dealt evenly."""
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("int")
    each = files.select("path", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    at = F.col("block").cast("long") * size
    return each.select("path", "block", at.alias("offset"), F.least(F.lit(size), F.col("length") - at).alias("size")).repartition(tasks, "path", "block")
