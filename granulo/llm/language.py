"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Inverse document frequencies come from all learning documents, and so does the list of languages. The classifier is fitted
on at most MAX_EACH documents of each language, those with the least hash of doc_id, and of each at most MAX_BAG different
n-grams (8 bytes each reach the driver), by follow-the-regularised-leader with an elastic-net penalty (one learning rate for
each weight; the L1 part keeps most at zero). A part of the sample is held back to fit one temperature, by which logits
are divided, so that scores are calibrated. Executors turn texts into n-gram counts; the driver sees counts alone.

Defined results: `und` with score 0 for a null text, one without a letter, and whenever there is nothing to learn from;
ties go to the first language in order; a null or missing lang teaches nothing; equal rows get equal results; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, grams

SIZES, BITS = (1, 2, 3), 15
MAX_EACH, MAX_BAG, EPOCHS = 750, 8192, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
#: Term frequencies sum to this in each text.
SCALE = 50.0
_LETTER = re.compile(r"[^\W\d_]")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts end to end, and where each begins."""
    low = [t.lower() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of docs (text) each bucket occurs; the last value is the number of documents."""

    def run(batches):
        df = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                k, _ = grams.counts(symbols([t.as_py() or ""])[0], SIZES, BITS)
                df[k] += 1
                df[-1] += 1
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(df[k])], ["bucket", "df"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        out[r["bucket"]] = r["df"]
    return out


def sample(docs: DataFrame, most: int = MAX_EACH) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of at most `most` of docs (doc_id, text, lang) in each language, however rare it is."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [r[0] for r in docs.select("doc_id", "lang").filter("doc_id is not null").withColumn("place", place).filter(F.col("place") <= most).select("doc_id").collect()]
    few = docs.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long").distinct()), "doc_id") if ids else docs.limit(0)

    def run(batches):
        for b in batches:
            got = [grams.bounded(*grams.counts(symbols([t or ""])[0], SIZES, BITS), MAX_BAG) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([k.astype(np.int32) for k, _ in got], pa.list_(pa.int32())), pa.array([n.astype(np.float32) for _, n in got], pa.list_(pa.float32()))], ["doc_id", "lang", "k", "n"])

    t = few.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, lang string, k array<int>, n array<float>").toArrow().sort_by("doc_id")
    return [(lang, k.values.to_numpy(), n.values.to_numpy().astype(float)) for lang, k, n in zip(t.column("lang").to_pylist(), t.column("k"), t.column("n"), strict=True)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, dims: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (dims + 1, classes), the last row the bias, from rows (class, features, values)."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weights(k):
        zk = z[k]
        return np.where(np.abs(zk) <= L1, 0.0, -(zk - np.sign(zk) * L1) / ((BETA + np.sqrt(n[k])) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            y, k, x = rows[i]
            k, x = np.append(k, dims), np.append(x, 1.0)
            w = weights(k)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA
            z[k] += g - s * w
            n[k] += g * g
    return weights(np.arange(dims + 1))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits with the least loss."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, a table of weights by bucket and the bias, temperature included; docs: doc_id, text, lang."""
    docs = docs.filter("lang is not null and text is not null")
    rows = sample(docs)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    df = document_frequencies(docs)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    data = [(langs.index(lang), k, SCALE * n / n.sum() * idf[k]) for lang, k, n in rows if len(k)]
    held = max(1, len(data) // 5) if len(data) >= 10 else 0
    w = fit_ftrl(data[held:], len(langs), 1 << BITS)
    logits = np.array([x @ w[k] + w[-1] for _, k, x in data[:held]]).reshape(-1, len(langs))
    t = temperature(logits, np.array([y for y, _, _ in data[:held]], int))
    table = np.zeros(((1 << BITS) + 1, len(langs)))
    table[:-1] = w[:-1] * idf[:, None] * SCALE / t
    return langs, table, w[-1] / t


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if shared.value:
                langs, table, bias = shared.value
                total, count = grams.sums(*symbols(texts), SIZES, table, BITS)
                p = softmax(total / np.maximum(count, 1)[:, None] + bias)
                best = p.argmax(axis=1)
                for i, t in enumerate(texts):
                    if _LETTER.search(t):
                        lang[i], score[i] = langs[best[i]], p[i, best[i]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    common.prepare(spark)
    return predict(docs, train(docs.select("doc_id", "text", "lang").filter(~held_out())))
