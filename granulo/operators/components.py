"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.errors import StateError


def shared_dir(spark) -> str:
    """spark.checkpoint.dir, which a cluster's machines share. Where it is unset, a temporary folder, and only if all runs on
    this machine."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not told and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise StateError("spark.checkpoint.dir must name a folder that driver and executors share")
    return told or os.path.join(tempfile.gettempdir(), "granulo-checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without the plan that made them."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _lowest(edges: DataFrame) -> DataFrame:
    """For each node u of edges (u, v) the least of u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (u, v, of one orderable type); component is the least node that can be
    reached. Nodes without edges don't appear. Frequent nodes are only ever aggregated or joined, never collected."""
    e = edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = cut(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = _lowest(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
