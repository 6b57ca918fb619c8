"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most `capacity`. The packing itself works on the histogram of piece lengths (at
most `capacity` numbers, however large the corpus), so the driver sees no piece: it indexes the sums of one, two and
three available lengths, fills each gap exactly where availability counts allow, as many times over as they allow, and
else takes the best fit. What it decides is a short list of patterns with multiplicities. Pieces find their place by
their rank within their length, which buckets of a hash make without one task for a frequent length.

Defined results: a null or empty text is the single identifier 2; <|endoftext|> within a text is the one identifier that
the vocabulary file gives it; equal texts are packed each for itself; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 1024
#: The pieces of one length are dealt for ranking into buckets of about so many.
BUCKET_PIECES = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n tokens, and n: full pieces behind a first one that may be shorter."""
    head = n % capacity or capacity
    return [0, *range(head, n + 1, capacity)] if n else [0]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece of each document (doc_id, text)."""
    common.prepare(docs.sparkSession)
    path = vocabulary or tokens.default_path()

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), ([], [], [], [], [])
            for i, text in zip(ids, b.column(1), strict=True):
                got = np.array([*tokens.encode(text.as_py() or "", path, tokens.ADDED), tokens.EOD], "<u4")
                at = cut_points(len(got), capacity)
                for k, (s, e) in enumerate(zip(at, at[1:], strict=False)):
                    for column, v in zip(out, (i, k, s, e - s, zlib.crc32(got[s:e].tobytes())), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


class Shelf:
    """Availability of each length, and what fills a gap exactly."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, np.int64)
        for k, v in counts.items():
            self.n[k] = v
        self.capacity = capacity

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.n[gap] else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """Two available lengths that sum to gap, the longer one as long as can be (and at most `most`)."""
        top = min(gap - 1, most or gap)
        low = (gap + 1) // 2
        if top < low:
            return None
        a = np.arange(top, low - 1, -1)
        b = gap - a
        ok = (self.n[a] > 0) & (self.n[b] > (a == b))
        k = int(ok.argmax())
        return (int(a[k]), int(b[k])) if ok[k] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in np.flatnonzero(self.n[: max(0, gap - 1)])[::-1].tolist():
            if 3 * a < gap:
                break
            self.n[a] -= 1
            rest = self.pair(gap - a, a)
            self.n[a] += 1
            if rest:
                return (a, *rest)
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return (self.single(gap) or self.pair(gap) or self.triple(gap)) if gap else ()

    def best(self, gap: int) -> int:
        """The longest available length that fits, or 0."""
        fit = np.flatnonzero(self.n[1 : gap + 1])
        return int(fit[-1]) + 1 if len(fit) else 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences each makes. Every step uses up at least one length, so the
    number of patterns is bounded by the capacity and not by the number of pieces."""
    shelf, out = Shelf(counts, capacity), []
    for top in range(capacity, 0, -1):
        while shelf.n[top]:
            held, gap = [top], capacity - top
            shelf.n[top] -= 1
            while gap:
                fill = shelf.exact(gap)
                if fill is None:
                    x = shelf.best(gap)
                    fill = (x,) if x else None
                if fill is None:
                    break
                for x in fill:
                    shelf.n[x] -= 1
                    gap -= x
                held += fill
            need = Counter(held)
            times = 1 + min(int(shelf.n[x]) // k for x, k in need.items())
            for x, k in need.items():
                shelf.n[x] -= k * (times - 1)
            out.append((tuple(held), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each run of ranks within a length: its length, first rank, first sequence and offset; sorted by length and rank."""
    rank: Counter = Counter()
    rows, seq = [], 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            rows.append((x, rank[x], seq, at))
            rank[x] += times
            at += x
        seq += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) + a[:, 1], "rank": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (see pieces(); written somewhere that lasts, as they're read twice) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = places(plan(counts, capacity))
    spark = pieces.sparkSession
    wide = spark.createDataFrame([(x, -(-n // BUCKET_PIECES)) for x, n in counts.items()], "length long, buckets long")  # at most `capacity` rows
    dealt = pieces.join(F.broadcast(wide), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    base = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(base, ["length", "bucket"]).withColumn("rank", F.col("k") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            k = np.searchsorted(at["key"], (length << 48) + rank, side="right") - 1
            seq, off = at["seq"][k] + rank - at["rank"][k], at["offset"][k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Documents (doc_id, text) as pieces with their places in sequences."""
    return pack(common.cut(pieces(docs, capacity, vocabulary)), capacity)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit(common.table(spark, sf_dir, "documents"))
