"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A text is the bag of byte n-grams of its distinct lower-cased words, word ends marked by what parts words; a word that
fills a text by repetition counts once. Each hashed n-gram has a
vector; their average goes through a linear softmax. Vectors and softmax learn together, so a misspelling that was
never seen still lies near its correct form, whose n-grams it shares. Training takes at most MAX_EACH labelled texts of
either label, those with the least hash of doc_id, and of a text with more than MAX_BAG different n-grams so many, picked by
their hash, with the weight of all: the driver sees counts alone, which executors make of texts, and never more than
2 * MAX_EACH * MAX_BAG of them at 8 bytes. Scores cover whole texts. A part of the sample, held back, sets the bias at which
a score of 0.5 parts the labels best: misses and false alarms count as shares of their label.

Defined results: a null or empty text has the score of an empty bag (below 0.5: nothing in it is toxic); without labels of
both kinds every score is the share of label 1, or 0; repeated labels of a text count once each; labels for missing texts
teach nothing; equal texts get equal scores; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, grams

SIZES, BITS, DIMS = (3, 4, 5, 6), 18, 8
MAX_EACH, MAX_BAG = 2500, 8192
EPOCHS, VECTOR_RATE, RATE, BATCH = 10, 2.0, 0.02, 32
#: The rarer label is shown up to so many times an epoch, as far as the other is more frequent.
REPEATS = 8
#: A clean text that is flagged weighs as much as so many toxic ones that are missed, as shares of either.
FLAGGED = 2.0
#: Averages are multiplied by it before the softmax, as a toxic word is a small part of a text.
GAIN = 100.0
#: N-grams of no meaning that every bag holds besides its own, so that a few odd ones don't decide on a short text.
PRIOR = 300
MAX_WORD = 1 << 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def distinct_words(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Folded bytes, row offsets, breaks, and start, end, row and weight of each row's distinct words at their first place.
    A word that occurs k times weighs log2(1 + k)."""
    buf, offs = common.text_bytes(col)
    s, e, _ = common.spans(buf, offs)
    long = e - s > MAX_WORD
    if long.any():  # endless words in pieces, so that memory stays bounded
        n = -(-(e - s) // MAX_WORD)
        of = np.repeat(np.arange(len(s)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s, e = s[of] + k * MAX_WORD, np.minimum(s[of] + (k + 1) * MAX_WORD, e[of])
    row = np.searchsorted(offs, s, side="right") - 1
    h = common.span_hashes(buf, s, e)
    order = np.lexsort((s, h, row))
    first = np.ones(len(s), bool)
    first[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
    at = np.flatnonzero(first)
    times = np.empty(len(s))
    times[order[first]] = np.log2(1 + np.diff(np.append(at, len(s))))
    keep = np.sort(order[first])
    br = _BREAK[buf]
    return np.where(br, np.uint8(32), _FOLD[buf]), offs, br, s[keep], e[keep], row[keep], times[keep]


def slices(s: np.ndarray, e: np.ndarray):
    """Groups of words that lie close enough together: i, j, and the symbols a to b with a mark in front of each word."""
    i = 0
    while i < len(s):
        j = max(int(np.searchsorted(e, s[i] + grams.SLICE, side="right")), i + 1)
        yield i, j, max(0, int(s[i]) - 1), int(e[j - 1])
        i = j


def sums(col: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sum of table over the n-grams of its distinct words, and their number."""
    sym, offs, br, s, e, row, weight = distinct_words(col)
    total, count = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
    for i, j, a, b in slices(s, e):
        v, k = np.zeros(b - a + 1), np.zeros(b - a + 1, np.int64)
        for n in SIZES:
            at = grams.buckets(sym, offs, a, b, n, BITS, br)
            v[1:] += table[at]
            k[1:] += at < 1 << BITS
        v, k = np.cumsum(v), np.cumsum(k)
        lo, hi = np.maximum(s[i:j] - 1, offs[row[i:j]]) - a, e[i:j] - a
        total += np.bincount(row[i:j], (v[hi] - v[lo]) * weight[i:j], len(total))
        count += np.bincount(row[i:j], (k[hi] - k[lo]) * weight[i:j], len(total))
    return total, count


def bag(one: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of the distinct words of a single text, and their weights."""
    sym, offs, br, s, e, _, weight = distinct_words(one)
    total = np.zeros((1 << BITS) + 1)
    for i, j, a, b in slices(s, e):
        step = np.zeros(b - a + 1)
        np.add.at(step, np.maximum(s[i:j] - 1, 0) - a, weight[i:j])
        np.add.at(step, e[i:j] - a, -weight[i:j])
        w = np.cumsum(step)[:-1]
        for n in SIZES:
            total += np.bincount(grams.buckets(sym, offs, a, b, n, BITS, br), w, len(total))
    k = np.flatnonzero(total[:-1] > 1e-6)
    return k, total[k]


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_EACH) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of at most `most` labelled texts of each label."""
    lab = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).distinct()
    known = [r["toxic"] for r in lab.select("toxic").distinct().collect()]
    ids = [(r[0], r[1]) for y in (1, 0) for r in lab.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if len(known) < 2:
        return [(y, np.zeros(1, np.int64), np.ones(1)) for y in known]
    few = docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")), "doc_id")

    def run(batches):
        for b in batches:
            got = [grams.bounded(*bag(b.column(1).slice(r, 1)), MAX_BAG) for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([k.astype(np.uint32).tobytes() for k, _ in got], pa.binary()), pa.array([n.astype(np.float32).tobytes() for _, n in got], pa.binary())], ["doc_id", "toxic", "k", "n"])

    t = few.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, k binary, n binary").toArrow().sort_by("doc_id")
    return [(y, np.frombuffer(k, np.uint32), np.frombuffer(n, np.float32)) for y, k, n in zip(t.column("toxic").to_pylist(), t.column("k").to_pylist(), t.column("n").to_pylist(), strict=True)]


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, softmax weights and bias. Vectors move by plain gradient steps, so that what occurs in one text alone
    stays small; softmax and bias by Adam."""
    rng = np.random.default_rng(0)
    e = rng.normal(0, 0.01, (1 << BITS, DIMS)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIMS, 2)).astype(np.float32)
    c = np.zeros(2, np.float32)
    mw, vw, mc, vc = (np.zeros_like(x) for x in (w, w, c, c))
    step = 0
    for epoch in range(EPOCHS):
        order, left = rng.permutation(len(rows)), 1 - epoch / EPOCHS
        for at in range(0, len(rows), BATCH):
            mine = [rows[i] for i in order[at : at + BATCH].tolist()]
            y = np.array([r[0] for r in mine])
            size = np.array([len(r[1]) for r in mine])
            k = np.concatenate([r[1] for r in mine]).astype(np.int64)
            x = np.concatenate([r[2] * np.float32(GAIN / (PRIOR + r[2].sum(dtype=np.float32))) for r in mine])
            m = np.add.reduceat(e[k] * x[:, None], np.cumsum(size) - size, axis=0)
            z = m @ w + c
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            g = np.repeat(p @ w.T, size, axis=0) * x[:, None]
            by = np.argsort(k, kind="stable")
            first = np.flatnonzero(np.diff(k[by], prepend=-1))
            e[k[by][first]] -= VECTOR_RATE * left * np.add.reduceat(g[by], first, axis=0)
            step += 1
            for v, a, b, d in ((w, mw, vw, m.T @ p), (c, mc, vc, p.sum(axis=0))):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                v -= RATE * left * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return e, w, c


def evened(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The rows, those of the rarer label several times."""
    one, two = ([r for r in rows if r[0] == y] for y in (0, 1))
    few, many = sorted((one, two), key=len)
    return many + few * max(1, min(REPEATS, len(many) // max(1, len(few))))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The difference of logits by bucket, and its bias; docs: doc_id, text; labels: doc_id, toxic."""
    rows = sample(docs, labels)
    table = np.zeros((1 << BITS) + 1)
    ones = sum(y for y, _, _ in rows)
    if ones in (0, len(rows)):
        return table, 30.0 if ones else -30.0
    rows = [r for r in rows if len(r[1])]
    order = np.random.default_rng(1).permutation(len(rows)).tolist()
    held = [rows[i] for i in order[: len(rows) // 6]]
    e, w, c = fit(evened([rows[i] for i in order[len(rows) // 6 :]]))
    table[:-1] = GAIN * (e @ (w[:, 1] - w[:, 0]))
    bias = float(c[1] - c[0])
    z = np.array([(table[k] * n).sum() / (PRIOR + n.sum(dtype=np.float32)) for _, k, n in held]) + bias
    y = np.array([r[0] for r in held])
    if 0 < y.sum() < len(y):
        cuts = np.sort(z)
        cuts = np.concatenate([[0.0], (cuts[1:] + cuts[:-1]) / 2])
        wrong = np.array([((z < t) & (y == 1)).sum() / y.sum() + FLAGGED * ((z >= t) & (y == 0)).sum() / (len(y) - y.sum()) for t in cuts])
        best = cuts[wrong <= wrong.min() + 1e-9]
        bias -= float(np.median(best))
    return table, min(bias, -1e-6)  # an empty bag is not toxic


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            table, bias = shared.value
            total, count = sums(b.column(1), table)
            s = 1 / (1 + np.exp(-np.clip(total / (PRIOR + count) + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    common.prepare(spark)
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
