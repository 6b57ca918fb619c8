"""What the operators share: sessions, shared folders, and vectorised word hashing over Arrow text."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of an Arrow batch sent to Python; texts may be long, so it is far below Spark's default.
BATCH_RECORDS = 512
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and the folder that holds this package on the Python workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_RECORDS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, and only if
    all runs on this machine."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not told:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        told = os.path.join(tempfile.gettempdir(), "granulo-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(told)
    return told


_LEFT: set[str] = set()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; sweep() deletes it, if nothing did before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    return path


def sweep() -> None:
    """Deletes what this process wrote to the shared folder. Results are lazy: store or collect them before. Runs by itself
    when the process ends."""
    from . import files

    while _LEFT:
        with contextlib.suppress(OSError):
            files.drop(_LEFT.pop())


atexit.register(sweep)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it ends, and not when the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lost executors don't make earlier work run twice."""
    spark = df.sparkSession
    path = fresh_dir(spark, "cut")
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes what cut() wrote for tables that nothing reads any more."""
    from . import files

    for t in tables:
        files.drop(t.cut_path)
        _LEFT.discard(t.cut_path)


def spare(name: str, *tables: DataFrame) -> str:
    """The name, with marks added until no table has a column that SQL would take for it."""
    have = {c.lower() for t in tables for c in t.columns}
    while name.lower() in have:
        name += "_"
    return name


#: A key with fewer rows than this isn't worth a way of its own; and so many keys with a way of their own there are at most.
HOT_ROWS, HOT_KEYS = 2000, 10_000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with table, which has one row for each key and in `count` about how many of rows have it. Keys that hold
    many rows are few by arithmetic (no more than HOT_KEYS have a HOT_KEYS-th of all): their part of table is broadcast, so
    rows of such a key stay where they are. Others are joined by a shuffle. Both are read twice: give tables at rest."""
    total, most = table.agg(F.sum(count), F.max(count)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return rows.join(table, on, how)
    hot = F.col(count) > limit
    few = table.filter(hot)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(table.filter(~hot), on, how)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- vectorised words -------------------------------------------------------------------------

_U64 = np.uint64
_SEG = 1 << 18
_BASE = _U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = _U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


def _byte_table(fold: bool, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    with np.errstate(over="ignore"):
        t = mix((np.arange(256, dtype=_U64) + _U64(1)) * _U64(factor))
    if fold:
        t[65:91] = t[97:123]
    return t


_FOLDED, _PLAIN, _OTHER = _byte_table(True), _byte_table(False), _byte_table(False, 0xA0761D6478BD642F)
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEG, 1 << int(n - 1).bit_length()) if n else _SEG
    if size not in _POWERS:
        a = np.empty(size, _U64)
        b = np.empty(size, _U64)
        with np.errstate(over="ignore"):
            a[0] = b[0] = 1
            a[1:] = _BASE
            b[1:] = _INV
            np.cumprod(a, out=a)
            np.cumprod(b, out=b)
        if size != _SEG:
            return a, b
        _POWERS[size] = a, b
    return _POWERS[size]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, apart); equal bytes give equal hashes. fold: A-Z as a-z; other:
    without folding, a second hash for those who need 128 bits."""
    t = _OTHER if other else _FOLDED if fold else _PLAIN
    out = np.empty(len(starts), _U64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _SEG, side="right"))
        j = max(j, i + 1)
        s0, e0 = int(starts[i]), int(ends[j - 1])
        p, inv = _powers(e0 - s0)
        with np.errstate(over="ignore"):
            c = np.zeros(e0 - s0 + 1, _U64)
            np.cumsum(t[buf[s0:e0]] * p[: e0 - s0], out=c[1:])
            s, e = starts[i:j] - s0, ends[i:j] - s0
            out[i:j] = (c[e] - c[s]) * inv[s] + (e - s).astype(_U64) * _U64(0xA0761D6478BD642F)
        i = j
    return mix(out)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and the offsets of its rows. A null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None else np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which `inside` holds: starts, ends, and for each row the number of runs before it (one more value than rows). Runs don't cross rows."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = inside[buf]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    full = offs[:-1] < offs[1:]
    a, b = offs[:-1][full], offs[1:][full] - 1
    first[a] = w[a]
    last[b] = w[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(col: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all rows, and for each row the number of words before it (one more value than rows)."""
    buf, offs = text_bytes(col)
    s, e, at = spans(buf, offs)
    return span_hashes(buf, s, e, fold), at


_ODD = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U64)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive values; len(h) - size + 1 of them. The order of the values counts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, _U64)
    with np.errstate(over="ignore"):
        acc = np.full(n, size, _U64)
        for j in range(size):
            acc += h[j : j + n] * _ODD[j % 8]
            if j % 8 == 7:
                acc = mix(acc)
        return mix(acc)


def shingle_sets(wh: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes; with fewer words, one for the whole sequence; none without words."""
    all_ = windows(wh, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(all_[a : b - size + 1]))
        elif b > a:
            out.append(windows(wh[a:b], b - a) ^ _U64(0x5DEECE66D))
        else:
            out.append(np.empty(0, _U64))
    return out
