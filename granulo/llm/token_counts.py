"""Token counts by a separator scan of flat token files.

A token file is nothing but 16-bit little-endian identifiers; the end-of-document identifier stands behind each document
and there is no index. Files are read in blocks of fixed size wherever a worker is free. Each block is searched for
separators as a whole array; it knows nothing of its neighbours, so its first document may have begun blocks before. The
prefix scan over a file's blocks stitches that: the last separator before a block is a running maximum, the documents
before it a running sum.

Defined results: a null or empty text is a document of no tokens; <|endoftext|> within a text is ordinary text, as its own
identifier would part the file; equal texts are counted each for itself; tokens behind
a file's last separator are no document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, files, tokens

EOD = 50256
WIDTH = 2
BLOCK_BYTES = 8 << 20


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Writes a token file for each task; (file, ordinal, doc_id) tells where documents went."""
    common.prepare(docs.sparkSession)
    files.make(folder)
    path = vocabulary or tokens.default_path()

    def run(batches):
        task = TaskContext.get()  # a second attempt, which may meet rows in another order, writes a file of its own
        name, k = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin", 0
        with files.writer(f"{folder}/{name}") as out:
            for b in batches:
                for text in b.column(1):
                    out.write(np.array([*tokens.encode(text.as_py() or "", path), EOD], "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows, pa.string()), pa.array(np.arange(k, k + b.num_rows)), b.column(0)], ["file", "ordinal", "doc_id"])
                k += b.num_rows

    return common.cut(docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long"))


def separators(spark: SparkSession, folder: str, eod: int = EOD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, ends): token positions, within the file, of each block's separators."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            for path, block, offset, size in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids = np.frombuffer(files.read(path, offset, size), "<u2")
                ends = np.flatnonzero(ids == eod) + offset // WIDTH
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int32()), pa.array([ends], pa.list_(pa.int64()))], ["path", "block", "ends"])

    return files.blocks(files.listing(spark, folder, "*.bin"), block_bytes, tasks).mapInArrow(run, "path string, block int, ends array<long>")


def documents(found: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens) of each document, from the separators of blocks."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("path", "block", F.size("ends").cast("long").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    scan = summary.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("k0"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("open"))
    each = found.join(scan, ["path", "block"]).select("path", "k0", "open", "ends", F.posexplode("ends").alias("j", "end"))
    start = F.when(F.col("j") == 0, F.col("open")).otherwise(F.get("ends", F.col("j") - 1) + 1)
    return each.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), (F.col("k0") + F.col("j")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    folder = common.fresh_dir(spark, "tokens")
    where = write_tokens(common.table(spark, sf_dir, "documents"), folder)
    counted = documents(common.cut(separators(spark, folder)))
    return where.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
