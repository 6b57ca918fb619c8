"""Agglomerates: connected components of the overlap graph, within data sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: A data set with at most so many pairs is labelled in one task; a larger one by distributed rounds.
GROUPED_PAIRS = 1_000_000


def labels_grouped(pairs: DataFrame) -> DataFrame:
    """(ds_id, ID, agl) by union-find, a data set to a task."""

    def run(key, t):
        ids, at = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        root = np.arange(len(ids))
        u, v = at[: t.num_rows].copy(), at[t.num_rows :].copy()
        while True:  # hook the greater root to the lesser, then shorten paths
            ru, rv = root[u], root[v]
            open_ = ru != rv
            if not open_.any():
                break
            u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
            np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
            while (root[root] != root).any():
                root = root[root]
        return pa.table({"ds_id": pa.array([key[0].as_py()] * len(ids), pa.string()), "ID": pa.array(ids, pa.int64()), "agl": pa.array(ids[root], pa.int64())})

    return pairs.select("ds_id", "a", "b").groupBy("ds_id").applyInArrow(run, "ds_id string, ID long, agl long")


def labels_distributed(pairs: DataFrame) -> DataFrame:
    """(ds_id, ID, agl) by rounds of joins; no data set needs to fit a task."""
    node = lambda c: F.struct(F.col("ds_id").alias("ds_id"), F.col(c).alias("ID"))
    c = connected_components(pairs.select(node("a").alias("u"), node("b").alias("v")))
    return c.select("node.ds_id", "node.ID", F.col("component.ID").alias("agl"))


def components(parts: DataFrame, pairs: DataFrame, method: str = "auto", grouped_pairs: int = GROUPED_PAIRS) -> DataFrame:
    """(ds_id, ID, agl) of every particle; agl is the least ID of its agglomerate, its own if it touches nothing."""
    if method == "auto":
        size = pairs.groupBy("ds_id").agg(F.count("*").alias("n"))
        large = size.filter(F.col("n") > grouped_pairs).select("ds_id")
        if large.limit(1).count():
            found = labels_grouped(pairs.join(large, "ds_id", "left_anti")).unionByName(labels_distributed(pairs.join(large, "ds_id", "left_semi")))
        else:
            found = labels_grouped(pairs)
    else:
        found = {"grouped": labels_grouped, "distributed": labels_distributed}[method](pairs)
    return parts.select("ds_id", "ID").join(found, ["ds_id", "ID"], "left").select("ds_id", "ID", F.coalesce("agl", "ID").alias("agl"))
