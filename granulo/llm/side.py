"""Rows joined to a table at rest by a key that says where they lie, without moving the table.

A table written with monotonically_increasing_id() holds in each of its files consecutive keys, whose upper bits are the
number of the task that wrote them. What is to be joined is dealt by these bits into small sorted files of the shared folder;
a task that scans the table opens the ones that its rows name. So a list of affected rows costs a shuffle of itself, and
none of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

#: monotonically_increasing_id() counts the rows of a task in the lower bits.
LOW_BITS = 33


def deal(table: DataFrame, key: str) -> str:
    """Writes the rows of a table, by their key, for Side; gives the folder."""
    folder = common.fresh_dir(table.sparkSession, "side")
    part = common.spare("part__", table)
    with common.shuffles_freed(table.sparkSession):
        table.withColumn(part, F.shiftright(key, LOW_BITS)).repartition(part).sortWithinPartitions(part, key).write.partitionBy(part).parquet(folder)
    return f"{folder}?{part}"


class Side:
    """What was dealt, as a task looks it up."""

    def __init__(self, dealt: str, key: str):
        self.folder, self.part = dealt.rsplit("?", 1)
        self.key, self.of, self.got = key, None, None

    def rows(self, keys: np.ndarray) -> pa.Table | None:
        """The dealt rows whose keys lie among `keys`, sorted by key. Those of one writing task are held at a time."""
        out = []
        for part in np.unique(keys >> LOW_BITS).tolist():
            if part != self.of:
                self.of, self.got = part, files.parquet(f"{self.folder}/{self.part}={part}")
            if self.got is not None:
                mine = keys[keys >> LOW_BITS == part]
                at = np.searchsorted(self.got.column(self.key).to_numpy(), [mine.min(), mine.max() + 1])
                out.append(self.got.slice(at[0], at[1] - at[0]))
        return pa.concat_tables(out) if out else None


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in gone; without the key's column."""
    dealt, at = deal(gone.select(key), key), rows.columns.index(key)
    left = rows.drop(key)

    def run(batches):
        side = Side(dealt, key)
        for b in batches:
            keys = b.column(at).to_numpy()
            t = side.rows(keys)
            b = b.select([c for k, c in enumerate(b.schema.names) if k != at])
            yield b if t is None else b.filter(pa.array(~np.isin(keys, t.column(key).to_numpy())))

    return rows.mapInArrow(run, left.schema)
