"""Deletes later copies of repeated line runs.

A run is a sequence of consecutive lines (lines without words don't count and don't part runs); it is repeated if the
same sequence starts at another place, in any document. The earliest copy (least doc_id, then row, then line) of each repeated run
with at least MIN_RUN_WORDS words stays; its later copies are deleted.

Lines become identifiers. Only lines that occur twice can be part of a repeated run, so what is sorted are the suffixes of
stretches of such lines. Distributed prefix doubling ranks them: ranks by the first 2L lines come from pairs of ranks by L
lines, as a suffix's place is the start of its group plus the number of members whose second half ranks lower. Ranks are
places in the suffix array sorted by so many lines. Doubling stops at the depth that matters: a line holds a word, so
MIN_RUN_WORDS lines always suffice, and beyond the depth at which a suffix first holds enough words its order is idle.
Suffixes that agree to that depth are an interval of longest common prefixes; its name is the depth and two overlapping
ranks. Every place of an interval but the first begins a later copy. The same is done for the sequences that end at each
line. The union of these shortest qualifying sequences is exactly the union of all maximal repeated runs of enough words:
let line x lie in such a run [i, j]. If the words from x to j, or from i to x, suffice, a shortest sequence at x lies
inside the run. Else take the last s from which the words to j suffice; the shortest sequence from s ends inside the run,
and not before x, as the words from i to x don't suffice.

Defined results: a null or empty text, and one without repeated runs, stays as it is; equal documents lose all lines but
in the first; what stays keeps its line breaks; other columns stay. Each row is a document of its own, by a key written
once with the rows: a doc_id may repeat, with equal texts or not, or be null, which comes before all others. Which of the
rows of one doc_id comes first follows from how they are stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, side

MIN_RUN_WORDS = 20

_U64 = np.uint64
_NOT_NL = np.ones(256, bool)
_NOT_NL[10] = False


def sequences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lines with words: their two hashes, words and number among all \\n-split lines of their row; and per row how many came
    before."""
    s, e, _ = common.spans(buf, offs, _NOT_NL)
    ws, we, _ = common.spans(buf, offs)
    first, last = np.searchsorted(ws, s), np.searchsorted(ws, e)
    n = last - first
    s, e, first, last, n = (x[n > 0] for x in (s, e, first, last, n))
    s, e = ws[first], we[last - 1]  # without space at either end
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    row = np.searchsorted(offs, s, side="right") - 1
    return common.span_hashes(buf, s, e, fold=False), common.span_hashes(buf, s, e, other=True), n, breaks[s] - breaks[offs[row]], np.searchsorted(s, offs)


def shortest(n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the shortest sequences with enough words that start, and that end, at each line; each once."""
    c = np.concatenate([[0], np.cumsum(n)])
    s = np.arange(len(n))
    end = np.searchsorted(c, c[:-1] + least)
    ok = end <= len(n)
    fs, fe = s[ok], end[ok]
    e = np.arange(1, len(n) + 1)
    start = np.searchsorted(c, c[1:] - least, side="right") - 1
    ok = start >= 0
    pair = np.unique(np.stack([np.concatenate([fs, start[ok]]), np.concatenate([fe, e[ok]])]), axis=1)
    return pair[0], pair[1] - pair[0]


def line_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, row, k, h, g, n) of docs (doc_id, text, row): the lines with words of each row, numbered from 0; h and g name
    the line in 128 bits, n counts its words."""

    def run(batches):
        for b in batches:
            buf, offs = common.text_bytes(b.column(1))
            h, g, n, _, at = sequences(buf, offs)
            size = np.diff(at)
            k = np.arange(len(h)) - np.repeat(at[:-1], size)
            of = pa.array(np.repeat(np.arange(b.num_rows), size))
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), pa.array(k, pa.int32()), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(n, pa.int32())], ["doc_id", "row", "k", "h", "g", "n"])

    return docs.select("doc_id", "text", "row").mapInArrow(run, "doc_id long, row long, k int, h long, g long, n int")


def stretches(lines: DataFrame, least: int) -> DataFrame:
    """(doc_id, row, seg, k, n, r0): maximal stretches of lines that occur twice or more, of at least `least` words. r0 is
    the place of the line's first copy among all such lines sorted by their names."""
    count = common.cut(lines.groupBy("h", "g").agg(F.count("*").alias("c")).filter("c > 1").withColumn("part", F.shiftright("h", 54)))
    parts = count.groupBy("part").agg(F.sum("c").alias("pc"))  # at most 1024 rows
    parts = parts.withColumn("base", F.sum("pc").over(Window.orderBy("part")) - F.col("pc")).drop("pc")
    place = F.col("base") + F.sum("c").over(Window.partitionBy("part").orderBy("h", "g")) - F.col("c")
    first = common.cut(count.join(F.broadcast(parts), "part").select("h", "g", "c", place.alias("r0")))
    rows = common.join_hot(lines, first, ["h", "g"], "c").select("doc_id", "row", "k", "n", "r0")
    rows = rows.withColumn("seg", F.col("k") - F.row_number().over(Window.partitionBy("row").orderBy("k")))
    enough = F.sum("n").over(Window.partitionBy("row", "seg"))
    out = common.cut(rows.withColumn("words", enough).filter(F.col("words") >= least).drop("words"))
    common.free(count, first)
    return out


#: Parts into which the followers of a frequent beginning are dealt for ordering.
CELLS = 1024


def placed(pairs: DataFrame, r: str, up: str) -> DataFrame:
    """pairs (r, second, c) with the place `up` of their first copy among all rows sorted by (r, second): r, which is the
    place of the first with that r, and those before it within r. A beginning with many different followers is ordered in
    cells, whose sums are carried on, as no other task could hold it."""
    size = pairs.groupBy(r).agg(F.count("*").alias("m"))
    total, top = pairs.agg(F.count("*"), F.max("second")).first()
    limit = max(common.HOT_ROWS, total // common.HOT_KEYS)
    before = F.sum("c").over(Window.partitionBy(r).orderBy("second")) - F.col("c")
    few = [r, "second", "c", (F.col(r) + before).alias(up)]
    if (size.agg(F.max("m")).first()[0] or 0) <= limit:
        return pairs.select(*few)
    hot = F.broadcast(size.filter(F.col("m") > limit).select(r))  # by arithmetic no more than HOT_KEYS
    many = pairs.join(hot, r).withColumn("cell", F.floor((F.col("second") + 1) * CELLS / ((top or 0) + 2)).cast("int"))
    cells = many.groupBy(r, "cell").agg(F.sum("c").alias("base")).withColumn("base", F.sum("base").over(Window.partitionBy(r).orderBy("cell")) - F.col("base"))
    inside = F.sum("c").over(Window.partitionBy(r, "cell").orderBy("second")) - F.col("c")
    many = many.join(cells, [r, "cell"]).select(r, "second", "c", (F.col(r) + F.col("base") + inside).alias(up))
    return pairs.join(hot, r, "left_anti").select(*few).unionByName(many)


def ranked(rows: DataFrame, levels: int) -> DataFrame:
    """rows (with r0) and r1, r2, ...: places of suffixes sorted by their first 2, 4, ... lines; equal ones share the first
    place. A suffix that ends sooner sorts first. Groups are aggregated before they are ordered."""
    for j in range(levels - 1):
        r, up = f"r{j}", f"r{j + 1}"
        ahead = F.coalesce(F.lead(r, 1 << j).over(Window.partitionBy("row", "seg").orderBy("k")), F.lit(-1))
        paired = common.cut(rows.withColumn("second", ahead))
        pairs = common.cut(paired.groupBy(r, "second").agg(F.count("*").alias("c")))
        places = common.cut(placed(pairs, r, up))
        ranked_ = common.cut(common.join_hot(paired, places, [r, "second"], "c").drop("second", "c"))
        common.free(rows, paired, pairs, places)
        rows = ranked_
    return rows


def windows(docs: DataFrame, least: int = MIN_RUN_WORDS) -> DataFrame:
    """(length, head, tail, doc_id, row, start): the shortest qualifying sequences in stretches, named by their length and the
    ranks of the two longest powers of two at their ends."""
    levels = max(1, least).bit_length()
    lines = common.cut(line_ids(docs))
    found = stretches(lines, least)
    common.free(lines)
    rows = ranked(found, levels)
    fields = ["k", "n", *[f"r{j}" for j in range(levels)]]
    packed = rows.groupBy("row", "seg").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct(*fields))).alias("x"))

    def run(batches):
        for b in batches:
            offs, x = b.column(2).offsets.to_numpy(), b.column(2).flatten()
            offs = offs - offs[0]
            col = {f: x.field(f).to_numpy() for f in fields}
            out = []
            for d, (i, j) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                s, m = shortest(col["n"][i:j], least)
                if len(s):
                    out.append((np.full(len(s), d, np.int64), s + i, m))
            if not out:
                continue
            d, s, m = (np.concatenate(c) for c in zip(*out, strict=True))
            level = np.floor(np.log2(m)).astype(np.int64)
            ranks = np.stack([col[f"r{j}"] for j in range(levels)])
            head, tail = ranks[level, s], ranks[level, s + m - (1 << level)]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(head), pa.array(tail), b.column(0).take(pa.array(d)), b.column(1).take(pa.array(d)), pa.array(col["k"][s], pa.int32())], ["length", "head", "tail", "doc_id", "row", "start"])

    return packed.select("doc_id", "row", "x").mapInArrow(run, "length int, head long, tail long, doc_id long, row long, start int")


def later_copies(w: DataFrame) -> DataFrame:
    """(doc_id, row, start, length, first) of sequences of w that occur at an earlier place; first: doc_id, row and start of
    the earliest one."""
    name, place = ["length", "head", "tail"], F.struct("doc_id", "row", "start")
    first = common.cut(w.groupBy(*name).agg(F.min(place).alias("first"), F.count("*").alias("c")).filter("c > 1"))
    return common.join_hot(w, first, name, "c").filter(place > F.col("first")).select("doc_id", "row", "start", "length", "first")


def found_copies(keyed: DataFrame, least: int = MIN_RUN_WORDS) -> DataFrame:
    """later_copies() of keyed (doc_id, text, row), at rest."""
    w = common.cut(windows(keyed, least))
    out = common.cut(later_copies(w))
    common.free(w)
    return out


def maximal_runs(keyed: DataFrame, least: int = MIN_RUN_WORDS) -> DataFrame:
    """(doc_id, row, start, lines, of_doc_id, of_row, of_start): the runs of lines that are later copies, joined for as long as
    the earlier copy goes on beside them; lines with words are counted, from 0. keyed: doc_id, text, row."""
    c = found_copies(keyed, least).select("doc_id", "row", "start", (F.col("start") + F.col("length")).alias("end"), F.col("first.doc_id").alias("of_doc_id"), F.col("first.row").alias("of_row"), (F.col("start") - F.col("first.start")).alias("shift"))
    same = Window.partitionBy("row", "of_row", "shift").orderBy("start", "end")
    c = c.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    c = c.withColumn("run", F.sum("new").over(same))
    out = c.groupBy("doc_id", "row", "of_doc_id", "of_row", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select("doc_id", "row", "start", (F.col("end") - F.col("start")).alias("lines"), "of_doc_id", "of_row", (F.col("start") - F.col("shift")).alias("of_start"))


def dedup(docs: DataFrame, least: int = MIN_RUN_WORDS, counts: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """docs with later copies deleted from text, and two counts of lines with words: all, and those deleted. Their names must
    not be columns of docs. Texts are not shuffled: each task looks up the lines that go from its own rows."""
    common.prepare(docs.sparkSession)
    key = common.spare("row__", docs)
    keyed = common.cut(docs.withColumn(key, F.monotonically_increasing_id()))
    dead = side.deal(found_copies(keyed.select("doc_id", "text", F.col(key).alias("row")), least).select("row", "start", "length").distinct(), "row")
    columns, at = list(docs.columns), docs.columns.index("text")

    def run(batches):
        those = side.Side(dead, "row")
        for b in batches:
            texts, keys = b.column(at), b.column(len(columns)).to_numpy()
            buf, offs = common.text_bytes(texts)
            *_, line, first = sequences(buf, offs)
            size, gone = np.diff(first), np.zeros(b.num_rows, np.int64)
            t = those.rows(keys)
            if t is not None and t.num_rows:
                row = {k: i for i, k in enumerate(keys.tolist())}
                mine, new = np.zeros(len(line) + b.num_rows + 1, np.int64), {}
                edge = first[:-1] + np.arange(b.num_rows)  # a place behind each row's lines ends what goes to its end
                of = np.array([row.get(k, -1) for k in t.column("row").to_pylist()])
                start, length = (t.column(c).to_numpy()[of >= 0] for c in ("start", "length"))
                of = of[of >= 0]
                np.add.at(mine, edge[of] + start, 1)
                np.add.at(mine, edge[of] + start + length, -1)
                out = np.cumsum(mine) > 0
                for k in np.unique(of).tolist():
                    dropped = out[edge[k] : edge[k] + size[k]]
                    gone[k] = dropped.sum()
                    drop = set(line[first[k] : first[k + 1]][dropped].tolist())
                    new[k] = "\n".join(x for i, x in enumerate(texts[k].as_py().split("\n")) if i not in drop)
                texts = pa.array([new.get(k, x) for k, x in enumerate(texts.to_pylist())], texts.type)
            cols = [texts if k == at else b.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size), pa.array(gone)], [*columns, *counts])

    return keyed.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]]))


def clean(docs: DataFrame, least: int = MIN_RUN_WORDS) -> DataFrame:
    """The columns of docs; documents that consist of later copies alone go, as they are copies."""
    counts = common.spare("n_lines", docs), common.spare("n_deleted", docs)
    return dedup(docs, least, counts).filter(f"{counts[1]} = 0 or {counts[1]} < {counts[0]}").drop(*counts)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", "text")


#: Every run of enough words, its first place, and the lines of its later copies: the definition itself.
SQL = {"op6_line_dedup": rf"""
WITH raw AS (
  SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents
), lines AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), d AS (
  SELECT doc_id, list(line ORDER BY k) AS ls, list(n ORDER BY k) AS ns FROM lines GROUP BY doc_id
), runs AS (
  SELECT doc_id, a, b, ls[a:b] AS run FROM (SELECT doc_id, ls, ns, a, unnest(range(a, len(ls) + 1)) AS b FROM (SELECT doc_id, ls, ns, unnest(range(1, len(ls) + 1)) AS a FROM d)) WHERE list_sum(ns[a:b]) >= {MIN_RUN_WORDS}
), later AS (
  SELECT doc_id, a, b FROM (SELECT doc_id, a, b, min((doc_id, a)) OVER (PARTITION BY run) AS first FROM runs) WHERE (doc_id, a) > first
), dead AS (
  SELECT DISTINCT lines.doc_id, i FROM lines JOIN later ON lines.doc_id = later.doc_id AND lines.k BETWEEN later.a AND later.b
), kept AS (
  SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.i) AS text FROM raw LEFT JOIN dead ON raw.doc_id = dead.doc_id AND raw.i = dead.i WHERE dead.i IS NULL GROUP BY raw.doc_id
)
SELECT t.doc_id, (SELECT count(*) FROM lines l WHERE l.doc_id = t.doc_id) AS n_lines, (SELECT count(*) FROM dead x WHERE x.doc_id = t.doc_id) AS n_deleted,
  CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""}
