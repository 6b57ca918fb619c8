"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: the words at its ones are hashed, those at its zeros may be anything. Training
texts and test items are hashed by the same masks and their hashes joined. Around each hit the item is laid along the text
word by word, and the best stretch (a match counts 1, a substitution costs PENALTY) is measured: a text is contaminated if
some stretch has at least MIN_MATCH equal words, or all words of a shorter item. The masks miss no such stretch (see MASKS).
Items of fewer than MIN_MATCH words are joined by a hash of all their words. A hit whose words are also equal one place
before says nothing that the hit there doesn't say, so each run of hits counts by its first alone: equal words over and over
in text and item cost as many hits as they have words, and not the product.

A test set of at most MAX_INDEX_WORDS words is a broadcast index, in which each task looks up the hashes of whole batches.
For a larger one the hashes of both sides are tables, joined by Spark; a bitmap of bounded size drops nearly all hashes of
texts before that, frequent ones are joined where they lie, and what is verified is dealt to the texts. Both give the same.

Defined results: a null or empty text is clean; items without words, and null items, match nothing; items that share an
item_id are told apart by nothing but count each; letters A-Z count as a-z, and whatever is no letter, digit or non-ASCII
character parts words; repeated rows are judged each for itself; empty tables give no rows or only clean ones;
filter_clean() returns all columns of its input unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, side

#: What seven words with two substitutions can be at the start of a best stretch. Each beginning of it scores 0 or more, else
#: the stretch without it were better: the first substitution has two equal words before it and the second four, and of the
#: first seven words five are equal. So each qualifying stretch holds a seed at its first word.
MASKS = ("1111100", "1111010", "1110110", "1101110", "1111001", "1110101", "1101101")
MIN_MATCH = 13
PENALTY = 2
MAX_INDEX_WORDS = 2_000_000
#: Hits that are looked at together.
HITS = 1 << 20
#: Bits of the bitmap that stands for the hashes of a large test set: 16 for each, but no more than 128 MB of them.
MIN_FILTER, MAX_FILTER = 1 << 20, 1 << 30

_U64 = np.uint64
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = common.text_bytes(col)
    s, e, at = common.spans(buf, offs, _INSIDE)
    return common.span_hashes(buf, s, e), at


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask.rstrip("0")) + 1
    if n <= 0:
        return np.empty(0, _U64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, _U64)
        for k, j in enumerate(i for i, c in enumerate(mask) if c == "1"):
            acc += h[j : j + n] * common._ODD[k]
    return common.mix(acc)


def item_seeds(h: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    """Where seeds of a mask begin that lie inside items of MIN_MATCH words or more."""
    n = max(0, len(h) - len(mask.rstrip("0")) + 1)
    item = np.searchsorted(at, np.arange(n), side="right") - 1
    return np.flatnonzero((np.arange(n) + len(mask.rstrip("0")) <= at[item + 1]) & (at[item + 1] - at[item] >= MIN_MATCH))


class Index:
    """Seeds of test items: for each mask a table of low hash bits, and the seeds sorted by their hash and then by the word
    before them (0 for none), both as numbers of sorted lists."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words, self.at = words(pa.array([t for _, t in items], pa.string()))
        self.known = np.unique(self.words)
        self.tables = []
        begin = np.zeros(len(self.words) + 1, bool)
        begin[self.at] = True
        for mask in MASKS:
            pos = item_seeds(self.words, self.at, mask)
            h = seed_hashes(self.words, mask)[pos]
            seeds, number = np.unique(h, return_inverse=True)
            before = np.where(begin[pos], 0, np.searchsorted(self.known, self.words[np.maximum(pos - 1, 0)]) + 1)
            key = number * (len(self.known) + 1) + before
            order = np.argsort(key, kind="stable")
            low = np.zeros(1 << 20, bool)
            low[(h & _U64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((mask, low, seeds, key[order], pos[order]))
        # shorter items must be there as a whole: each length by a hash of whole word sequences
        self.short = []
        size = np.diff(self.at)
        for n in range(1, MIN_MATCH):
            item = np.flatnonzero(size == n)
            if len(item):
                keys = common.windows(self.words, n)[self.at[item]]
                order = np.argsort(keys, kind="stable")
                self.short.append((n, keys[order], item[order]))

    def whole(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, words) of items of fewer than MIN_MATCH words that stand whole in a text."""
        out = []
        for n, keys, items in self.short:
            s = common.windows(h, n)
            lo = np.searchsorted(keys, s)
            p = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == s)
            row = np.searchsorted(at, p, side="right") - 1
            p, row = p[p + n <= at[row + 1]], row[p + n <= at[row + 1]]
            # once a row and key, however often the words stand there
            for r, k in np.unique(np.stack([row, lo[p]]), axis=1).T.tolist():
                out += [(r, i, n) for i in items[k : np.searchsorted(keys, keys[k], side="right")].tolist()]
        return out

    def hits(self, h: np.ndarray, at: np.ndarray):
        """Word positions of texts and of items at which a seed starts in both and the words before aren't equal: some at a
        time."""
        if not len(h) or not len(self.known):
            return
        wide = len(self.known) + 1
        k = np.minimum(np.searchsorted(self.known, h), wide - 2)
        before = np.append(-1, np.where(self.known[k] == h, k + 1, -1)[:-1])  # -1: no word that any item has
        before[at[:-1][at[:-1] < len(h)]] = -1
        for mask, low, seeds, keys, pos in self.tables:
            s = seed_hashes(h, mask)
            p = np.flatnonzero(low[(s & _U64((1 << 20) - 1)).astype(np.int64)])
            number = np.minimum(np.searchsorted(seeds, s[p]), max(0, len(seeds) - 1))
            p, number = (x[seeds[number] == s[p]] for x in (p, number)) if len(seeds) else (p[:0], p[:0])
            # of a seed's places those before and those behind the ones with the same word in front
            first, same = number * wide, number * wide + np.maximum(before[p], 0)
            lo, hi = np.searchsorted(keys, first), np.searchsorted(keys, first + wide)
            a, b = np.searchsorted(keys, same), np.searchsorted(keys, same + (before[p] > 0))
            lo, hi, p = np.concatenate([lo, b]), np.concatenate([a, hi]), np.concatenate([p, p])
            n = np.cumsum(hi - lo)
            i = 0
            while i < len(p):
                j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + HITS, side="right")))
                m = hi[i:j] - lo[i:j]
                if m.sum():
                    yield np.repeat(p[i:j], m), pos[np.repeat(lo[i:j] - np.cumsum(m) + m, m) + np.arange(m.sum())]
                i = j

    def diagonals(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(row, item, place of the item's first word less that of the text's): where a qualifying stretch may lie."""
        tried = []
        for p, q in self.hits(h, at):
            row, item = np.searchsorted(at, p, side="right") - 1, np.searchsorted(self.at, q, side="right") - 1
            fits = (p + MIN_MATCH <= at[row + 1]) & (q + MIN_MATCH <= self.at[item + 1])
            p, q, row, item = (x[fits] for x in (p, q, row, item))
            score = np.zeros(len(p), np.int64)
            for j in range(MIN_MATCH):  # no beginning of a best stretch scores less than 0
                score += np.where(h[p + j] == self.words[q + j], 1, -PENALTY)
                good = score >= 0
                p, q, row, item, score = (x[good] for x in (p, q, row, item, score))
            if len(p):
                tried.append(np.unique(np.stack([row, item, p - q]), axis=1))
        return np.unique(np.concatenate(tried, axis=1), axis=1).T if tried else np.empty((0, 3), np.int64)

    def scan(self, col: pa.Array) -> dict[int, dict[int, int]]:
        """For rows with a verified overlap: equal words of the best stretch by item."""
        h, at = words(col)
        found: dict[int, dict[int, int]] = {}
        for r, i, n in self.whole(h, at):
            found.setdefault(r, {})[self.ids[i]] = max(n, found.get(r, {}).get(self.ids[i], 0))
        # a text may start inside an item or end before it does: the diagonal alone says which words meet
        for r, i, d in self.diagonals(h, at).tolist():
            size, mine = int(self.at[i + 1] - self.at[i]), found.get(r, {})
            if mine.get(self.ids[i], 0) >= size:  # it can't be more
                continue
            a, b = max(int(at[r]), int(self.at[i]) + d), min(int(at[r + 1]), int(self.at[i + 1]) + d)
            if (best := stretch(h[a:b] == self.words[a - d : b - d])) >= MIN_MATCH:
                mine = found.setdefault(r, {})
                mine[self.ids[i]] = max(best, mine.get(self.ids[i], 0))
        return found


def stretch(equal: np.ndarray) -> int:
    """Equal words of the stretch with the highest score."""
    if not len(equal):
        return 0
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(total[: end + 1].argmin())
    return int(equal[start:end].sum())


def index_of(test: DataFrame, most: int | None = None):
    """A broadcast Index of items (item_id, text), or None if they have more than about `most` words."""
    items = test.select("item_id", "text").filter("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    if total > (MAX_INDEX_WORDS if most is None else most):
        return None
    return test.sparkSession.sparkContext.broadcast(Index([(r[0], r[1]) for r in items.toLocalIterator()]))


# ---- large test sets: hashes as tables ---------------------------------------------------------

_SEEDS = "kind int, h long, item long, pos int, before long"


def _item_rows(batches):
    """Items with words: item (the key), item_id, and their word hashes."""
    for b in batches:
        h, at = words(b.column(1))
        keep = [k for k in range(b.num_rows) if at[k + 1] > at[k]]
        yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(keep, pa.int64())), b.column(0).take(pa.array(keep, pa.int64())), pa.array([h[at[k] : at[k + 1]].tobytes() for k in keep], pa.binary())], ["item", "item_id", "words"])


def _seeds_of(h: np.ndarray, at: np.ndarray, short: bool):
    """(kind, hashes, places): seeds of each mask (kind 0 and on), and sequences of fewer than MIN_MATCH words (kind -n). With
    `short` only whole rows of that length count, and masks only in longer rows."""
    size, of = np.diff(at), lambda p: np.searchsorted(at, p, side="right") - 1
    for k, mask in enumerate(MASKS):
        s = seed_hashes(h, mask)
        p = item_seeds(h, at, mask) if short else np.arange(len(s))
        yield k, s[p], p
    for n in range(1, MIN_MATCH):
        s = common.windows(h, n)
        p = at[:-1][size == n] if short else np.arange(len(s))
        p = p[p + n <= at[of(p) + 1]] if len(p) else p
        yield -n, s[p], p


def _seed_rows(h: np.ndarray, at: np.ndarray, keys: np.ndarray, short: bool, bits: np.ndarray | None = None):
    before = np.append(_U64(0), h[:-1]) if len(h) else h
    before[at[:-1][at[:-1] < len(h)]] = 0
    for kind, s, p in _seeds_of(h, at, short):
        if bits is not None:
            low = s & _U64(8 * len(bits) - 1)
            good = (bits[(low >> _U64(3)).astype(np.int64)] >> (low & _U64(7)).astype(np.uint8)) & 1 > 0
            s, p = s[good], p[good]
        if len(p):
            row = np.searchsorted(at, p, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), kind, np.int32)), pa.array(s.view(np.int64)), pa.array(keys[row]), pa.array((p - at[row]).astype(np.int32)), pa.array(before[p].view(np.int64))], ["kind", "h", "item", "pos", "before"])


def hash_filter(seeds: DataFrame):
    """A broadcast bitmap with a one for the low bits of each hash."""
    bits = min(MAX_FILTER, max(MIN_FILTER, 1 << (16 * max(1, seeds.count()) - 1).bit_length()))
    parts = 64
    each = bits // 8 // parts

    def run(t: pa.Table) -> pa.Table:
        out = np.zeros(each * 8, bool)
        out[t.column("low").to_numpy() % (each * 8)] = True
        return pa.table({"part": [t.column("part")[0].as_py()], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    low = seeds.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("low")).distinct().withColumn("part", F.floor(F.col("low") / (each * 8)))
    whole = np.zeros(bits // 8, np.uint8)
    for r in low.groupBy("part").applyInArrow(run, "part long, bits binary").toLocalIterator():
        whole[r["part"] * each : (r["part"] + 1) * each] = np.frombuffer(r["bits"], np.uint8)
    return seeds.sparkSession.sparkContext.broadcast(whole)


def joined_candidates(keyed: DataFrame, test: DataFrame) -> str:
    """Deals to the rows of keyed (text, row) what is to be verified there: item_id, diagonal and word hashes of items."""
    items = test.select("item_id", "text").filter("text is not null").withColumn("item", F.monotonically_increasing_id())
    items = common.cut(items.mapInArrow(_item_rows, "item long, item_id long, words binary"))

    def of_items(batches):
        for b in batches:
            each = [np.frombuffer(x, _U64) for x in b.column(1).to_pylist()]
            yield from _seed_rows(np.concatenate([*each, np.empty(0, _U64)]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64), b.column(0).to_numpy(), True)

    seeds = common.cut(items.select("item", "words").mapInArrow(of_items, _SEEDS))
    bits = hash_filter(seeds)

    def of_texts(batches):
        for b in batches:
            yield from _seed_rows(*words(b.column(0)), b.column(1).to_numpy(), False, bits.value)

    texts = common.cut(keyed.select("text", "row").mapInArrow(of_texts, _SEEDS))
    at = ["kind", "h"]
    where = seeds.groupBy(*at).agg(F.collect_list(F.struct("item", "pos", "before")).alias("x"))
    table = common.cut(texts.groupBy(*at).agg(F.count("*").alias("c")).join(where, at))
    hits = common.join_hot(texts.select(*at, F.col("item").alias("row"), "pos", "before"), table, at, "c").select("kind", "row", "pos", "before", F.explode("x").alias("x"))
    hits = hits.filter("kind < 0 or before = 0 or x.before <> before").select("row", "x.item", (F.col("pos") - F.col("x.pos")).alias("shift")).distinct()
    hits = common.cut(hits)
    frequent = common.cut(hits.groupBy("item").agg(F.count("*").alias("c")).join(items, "item"))
    dealt = side.deal(common.join_hot(hits, frequent, ["item"], "c").select("row", "item_id", "shift", "words"), "row")
    common.free(items, seeds, texts, table, hits, frequent)
    return dealt


def judged(h: np.ndarray, t: pa.Table) -> dict[int, int]:
    """Equal words of the best stretch by item, of one text's word hashes and the rows dealt to it."""
    found: dict[int, int] = {}
    for i, d, w in zip(*[t.column(c).to_pylist() for c in ("item_id", "shift", "words")], strict=True):
        w = np.frombuffer(w, _U64)
        a, b = max(0, d), min(len(h), len(w) + d)
        best = stretch(h[a:b] == w[a - d : b - d])
        if best >= min(MIN_MATCH, len(w)):
            found[i] = max(best, found.get(i, 0))
    return found


# ---- both ways ---------------------------------------------------------------------------------


def _scanner(docs: DataFrame, test: DataFrame, most: int | None):
    """docs as the scan needs them, and scan(texts, keys) for a task: found items by row of a batch. keys: the last column."""
    index = index_of(test, most)
    if index is not None:
        return docs, None, lambda: lambda texts, keys: index.value.scan(texts)
    key = common.spare("row__", docs)
    keyed = common.cut(docs.withColumn(key, F.monotonically_increasing_id()))
    dealt = joined_candidates(keyed.select("text", F.col(key).alias("row")), test)

    def task():
        those = side.Side(dealt, "row")

        def scan(texts, keys):
            t = those.rows(keys)
            if t is None or not t.num_rows:
                return {}
            h, at = words(texts)
            of, found = t.column("row").to_numpy(), {}
            for k, key in enumerate(keys.tolist()):
                a, b = np.searchsorted(of, [key, key + 1])
                if b > a and (mine := judged(h[at[k] : at[k + 1]], t.slice(a, b - a))):
                    found[k] = mine
            return found

        return scan

    return keyed, key, task


def overlaps(docs: DataFrame, test: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted), matched (equal words of the best stretch) of each document."""
    common.prepare(docs.sparkSession)
    docs, key, task = _scanner(docs.select("doc_id", "text"), test, most)

    def run(batches):
        scan = task()
        for b in batches:
            ids, best = [[] for _ in range(b.num_rows)], [0] * b.num_rows
            for k, mine in scan(b.column(1), b.column(2).to_numpy() if key else None).items():
                ids[k], best[k] = sorted(mine), max(mine.values())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) > 0 for x in ids], pa.bool_()), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.int64())], ["doc_id", "contaminated", "item_ids", "matched"])

    return docs.mapInArrow(run, "doc_id long, contaminated boolean, item_ids array<long>, matched long")


def filter_clean(docs: DataFrame, test: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of docs (any columns beside text) without a verified overlap."""
    common.prepare(docs.sparkSession)
    at, width, schema = docs.columns.index("text"), len(docs.columns), T.StructType(docs.schema.fields)
    docs, key, task = _scanner(docs, test, most)

    def run(batches):
        scan = task()
        for b in batches:
            found = scan(b.column(at), b.column(width).to_numpy() if key else None)
            b = b.select(list(range(width)))
            yield b.filter(pa.array([k not in found for k in range(b.num_rows)], pa.bool_())) if found else b

    return docs.mapInArrow(run, schema)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
