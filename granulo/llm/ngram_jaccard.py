"""N-gram Jaccard join: which texts share enough word shingles, exactly, and the groups that such links form.

1. A single pass turns texts into sets of shingle hashes. A task deals its rows into chunks; rows of a chunk with equal sets
   are one class. What leaves the chunk are its tokens, packed, to the tokens' buckets, and a list of its rows and classes.
2. Token counts: a bucket counts in how many classes each token is and answers the chunks, only with tokens of two or more.
   A token that many classes of one chunk share is known there to be frequent: it stays, and its bucket gets one entry from
   the chunk instead of one for each class. A class of n tokens can only link if all but n - ceil(0.75 n) of its tokens
   are shared, so most classes end here. Equal sets of different chunks are found by 128-bit keys, of which one class stays.
3. Survivors order their tokens from rare to frequent. Two sets that link meet in their first n - ceil(0.75 n) + 1 tokens
   (prefix filter). A tile is one such token and one band of sizes: bands grow by 4/3, so partners lie in the same or the
   next band, and a class enters the tiles of its own band and, as a guest, of the next.
4. In a tile every class is first held against the tile's centre, a linear number of pairs. Classes already connected
   need no further pair, so what is left are pairs of a tile that lie in different components: first as many as would
   connect these, so again a linear number, and in the end all that still lie apart.
5. All of these are bounded from above by bit counts: bits of A's bitmap that B's lacks stand for at least as many tokens
   of A outside B. Tiles are compared as bit matrices and give out only pairs whose bound suffices.
6. Those pairs' sorted arrays are intersected exactly.

Hash width is 48 bits for tokens and 128 for sets; within a pair a false common token has odds of about n**2 / 2**48.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own group; with fewer
words than a shingle the whole sequence is the shingle; equal rows are linked; rows that repeat a doc_id count as rows; a
null doc_id is never the least of its group; other columns don't matter; an empty table gives no rows. The rows are read
once, and a task that runs again must meet them in the same order: give tables at rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulo.operators.components import connected_components

from . import common, side

WORDS = 5
#: The least similarity, 3/4, in whole numbers.
NUM, DEN = 3, 4
#: Bits of bitmaps; with four for each token, few tokens share one, and the bound is close.
MIN_BITS, MAX_BITS = 256, 1 << 16
#: Classes of a tile that are compared in one task.
TILE_ROWS = 2048
#: Tokens and classes of a chunk.
CHUNK_TOKENS, CHUNK_CLASSES = 1 << 19, 1 << 16
#: Classes of a chunk that make a token frequent, and the count that all frequent tokens get.
OFTEN, FREQUENT = 64, 65535
#: Characters of text whose tokens share a bucket, on average.
BUCKET_CHARS = 16 << 20

_U64 = np.uint64
_M48 = _U64((1 << 48) - 1)


def least_own(n):
    """Common tokens that a set of n needs with any partner: the union has n or more."""
    return -(-NUM * n // DEN)


def linked(common_, a, b):
    """DEN * |A & B| >= NUM * |A | B|."""
    return DEN * common_ >= NUM * (a + b - common_)


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(1, _U64)])
    end, out = np.cumsum(size), []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, _U64), np.cumsum(common.mix(flat ^ _U64(salt)))])
            out.append(common.mix(total[end] - total[end - size] + size.astype(_U64) * _U64(0x9E3779B97F4A7C15)).view(np.int64))
    return out[0], out[1]


def _sets(b: pa.RecordBatch, at: int = 1) -> list[np.ndarray]:
    sets = common.shingle_sets(*common.word_hashes(b.column(at)), WORDS)
    return [np.unique(s & _M48) for s in sets]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, behind their lengths."""
    return b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *[np.ascontiguousarray(x).tobytes() for x in arrays]])


def _unpack(x, *kinds) -> list[np.ndarray]:
    x = memoryview(x)
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(x[:at], np.int64).tolist(), strict=True):
        end = at + n * np.dtype(kind).itemsize
        out.append(np.frombuffer(x[at:end], kind))
        at = end
    return out


def _halves(tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in four bytes and two."""
    return (tok & _U64(0xFFFFFFFF)).astype(np.uint32), (tok >> _U64(32)).astype(np.uint16)


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(_U64) | (high.astype(_U64) << _U64(32))


def _steps(of: np.ndarray) -> np.ndarray:
    """A rising sequence as differences, in one byte each where they fit."""
    d = np.diff(of, prepend=0)
    return d.astype(np.uint8 if not len(d) or d.max() < 256 else np.uint16)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else [], [len(x)]]).astype(np.int64)


def _rows(out: list, names: tuple[str, ...] = ("to", "own", "payload")) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], list(names))


PACKED = "to long, own boolean, payload binary"


def _flush(chunk: int, docs: list, keys: list, sets: list, buckets: int, share: int) -> pa.RecordBatch:
    """A chunk's rows: for each bucket its tokens, and for the chunk itself its documents, the sizes of its classes and its
    frequent tokens. docs: (doc_id, n, place in keys or -1); keys: pairs of keys; sets: the tokens of each."""
    n = np.array([len(s) for s in sets], np.int64)
    tok = np.concatenate([*sets, np.empty(0, _U64)])
    of = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tok, kind="stable")
    run = _runs(tok[order])
    many = np.zeros(len(tok), bool)
    many[order] = np.repeat(np.diff(run) >= share, np.diff(run))
    often = tok[order][run[:-1]][np.diff(run) >= share]
    out = []
    place = lambda t: (t.astype(np.float64) * (buckets / 2**48)).astype(np.int64)
    t, o = tok[~many], of[~many]
    to = place(t)
    order = np.argsort(to, kind="stable")
    t, o, to = t[order], o[order], to[order]
    ends = np.searchsorted(to, np.arange(buckets + 1))
    hot = np.searchsorted(place(often), np.arange(buckets + 1))
    for k in np.flatnonzero((np.diff(ends) > 0) | (np.diff(hot) > 0)).tolist():
        a, b, c, d = ends[k], ends[k + 1], hot[k], hot[k + 1]
        step = _steps(o[a:b])
        out.append((k, False, _pack(np.array([chunk, step.itemsize]), step.view(np.uint8), *_halves(t[a:b]), *_halves(often[c:d]))))
    ids = np.array([d[0] or 0 for d in docs], np.int64)
    known = np.array([d[0] is not None for d in docs], np.uint8)
    own = _pack(np.array([chunk]), ids, known, np.array([d[1] for d in docs], np.int64), np.array([d[2] for d in docs], np.int32), np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), n, of[many].astype(np.uint16), *_halves(tok[many]))
    out.append((-1 - chunk % buckets, True, own))
    return _rows(out)


_OWN = (np.int64, np.int64, np.uint8, np.int64, np.int32, np.int64, np.int64, np.int64, np.uint16, np.uint32, np.uint16)


def token_chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """PACKED rows of all chunks: tokens to their buckets (to >= 0), and what a chunk keeps (own)."""
    share = OFTEN

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        rows: list = []
        at: dict = {}
        sets: list = []
        held = 0
        for b in batches:
            got = _sets(b)
            pairs = list(zip(*[x.tolist() for x in _keys(got)], strict=True))
            for i, s, pair in zip(b.column(0).to_pylist(), got, pairs, strict=True):
                if len(s) and pair not in at:
                    at[pair] = len(at)
                    sets.append(s)
                    held += len(s)
                rows.append((i, len(s), at[pair] if len(s) else -1))
                if held >= CHUNK_TOKENS or len(at) >= CHUNK_CLASSES or len(rows) >= 4 * CHUNK_CLASSES:
                    yield _flush((part << 24) + k, rows, list(at), sets, buckets, share)
                    rows, at, sets, held, k = [], {}, [], 0, k + 1
        if rows:
            yield _flush((part << 24) + k, rows, list(at), sets, buckets, share)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def shared_tokens(chunks: DataFrame) -> DataFrame:
    """PACKED rows for chunks (to): what they keep, and the tokens that two or more classes have, with their number."""

    def run(t: pa.Table) -> pa.Table:
        if t.column("own")[0].as_py():
            to = [int(_unpack(x, *_OWN)[0][0]) for x in t.column("payload").to_pylist()]
            return pa.table([pa.array(to, pa.int64()), t.column("own"), t.column("payload")], t.column_names)
        ids, ofs, toks, hots = [], [], [], []
        for x in t.column("payload").to_pylist():
            (chunk, wide), step, low, high, hl, hh = _unpack(x, np.int64, np.uint8, np.uint32, np.uint16, np.uint32, np.uint16)
            ids.append(int(chunk))
            ofs.append(np.cumsum(step.view(np.uint8 if wide == 1 else np.uint16), dtype=np.int64))
            toks.append(_whole(low, high))
            hots.append(_whole(hl, hh))
        size = np.array([len(x) for x in toks], np.int64)
        tok, hot = np.concatenate(toks), np.unique(np.concatenate(hots))
        order = np.argsort(tok, kind="stable")
        run_ = _runs(tok[order])
        count = np.empty(len(tok), np.int64)
        count[order] = np.repeat(np.diff(run_), np.diff(run_))
        if len(hot) and len(tok):
            at = np.minimum(np.searchsorted(hot, tok), len(hot) - 1)
            count[hot[at] == tok] = FREQUENT
        good = count > 1
        edge = np.concatenate([[0], np.cumsum(size)])
        out = []
        for k, chunk in enumerate(ids):
            g = good[edge[k] : edge[k + 1]]
            if g.any():
                x = tok[edge[k] : edge[k + 1]][g]
                out.append((chunk, False, _pack(ofs[k][g].astype(np.uint16), *_halves(x), np.minimum(count[edge[k] : edge[k + 1]][g], FREQUENT).astype(np.uint16))))
        return pa.Table.from_batches([_rows(out)])

    return chunks.groupBy("to").applyInArrow(run, PACKED)


def documents(shared: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, cls) of every row; a row without words has no class. The two keys name its set."""

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                (chunk,), ids, known, n, of, k1, k2, *_ = _unpack(x, *_OWN)
                none = of < 0
                k1, k2 = (np.append(k, 0)[of] for k in (k1, k2))
                cls = (int(chunk) << 16) + of.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(n), *[pa.array(k, mask=none) for k in (k1, k2, cls)]], ["doc_id", "n_shingles", "k1", "k2", "cls"])

    return shared.filter("own").select("payload").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, cls long")


def survivors(shared: DataFrame) -> DataFrame:
    """(cls, n, held, tokens, prefix, bits): classes that can link, the number and the sorted array of their shared tokens,
    the shared ones of their prefix, and a bitmap of the shared ones."""

    def run(t: pa.Table) -> pa.Table:
        ofs, toks, dfs = [], [], []
        for own, x in zip(t.column("own").to_pylist(), t.column("payload").to_pylist(), strict=True):
            if own:
                (chunk,), *_, n, of, low, high = _unpack(x, *_OWN)
                df = np.full(len(of), FREQUENT, np.uint16)
            else:
                of, low, high, df = _unpack(x, np.uint16, np.uint32, np.uint16, np.uint16)
            ofs.append(of)
            toks.append(_whole(low, high))
            dfs.append(df)
        of, tok, df = np.concatenate(ofs), np.concatenate(toks), np.concatenate(dfs)
        order = np.lexsort((tok, df, of))
        of, tok = of[order], tok[order]
        start = _runs(of)
        start, held = start[:-1], np.diff(start)
        size = n[of[start]]
        more = size - least_own(size) + 1 - (size - held)  # the prefix without tokens that nobody shares
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for a, h, s, m in zip(start.tolist(), held.tolist(), size.tolist(), more.tolist(), strict=True):
            if m > 0:
                out[0].append((int(chunk) << 16) + int(of[a]))
                out[1].append(s)
                out[2].append(h)
                out[3].append(np.sort(tok[a : a + h]).tobytes())
                out[4].append(tok[a : a + m].view(np.int64))
                out[5].append(bitmap(tok[a : a + h], bits_for(s)).tobytes())
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.binary())], ["cls", "n", "held", "tokens", "prefix", "bits"])

    return shared.groupBy("to").applyInArrow(run, "cls long, n long, held long, tokens binary, prefix array<long>, bits binary")


def bits_for(n: int) -> int:
    """Bits of a set's bitmap: a power of two of four for each token or more."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (4 * max(1, n) - 1).bit_length()))


def bitmap(tok: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(common.mix(tok) & _U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(_U64)


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as it would be with fewer bits."""
    while len(x) > words:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def least_common(a, b):
    """Common tokens without which sets of a and b can't link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def bound(x: np.ndarray, y: np.ndarray, hx: int, hy: int) -> int:
    """At most so many tokens have two sets of hx and hy tokens in common, by their bitmaps."""
    words = min(len(x), len(y))
    x, y = fold(x, words), fold(y, words)
    return min(hx - int(np.bitwise_count(x & ~y).sum()), hy - int(np.bitwise_count(y & ~x).sum()))


def verify(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """Those pairs (u, v) of classes that link: the bound by bitmaps first, then the exact intersection of sorted arrays."""
    one = live.select("cls", "n", "bits", "tokens")
    both = pairs.join(one.withColumnsRenamed({"cls": "u", "n": "nu", "bits": "bu", "tokens": "tu"}), "u").join(one.withColumnsRenamed({"cls": "v", "n": "nv", "bits": "bv", "tokens": "tv"}), "v")

    def run(batches):
        for b in batches:
            u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            nu, nv = b.column(2).to_numpy(), b.column(5).to_numpy()
            keep = []
            for k in range(b.num_rows):
                p, x, q, y = (np.frombuffer(b.column(c)[k].as_buffer(), _U64) for c in (3, 4, 6, 7))
                need = least_common(int(nu[k]), int(nv[k]))
                if min(len(x), len(y)) >= need and bound(p, q, len(x), len(y)) >= need and linked(len(np.intersect1d(x, y, assume_unique=True)), int(nu[k]), int(nv[k])):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return both.select("u", "v", "nu", "bu", "tu", "nv", "bv", "tv").mapInArrow(run, "u long, v long")


def tiles(live: DataFrame) -> DataFrame:
    """(token, tile, cls, n, own): each class in the tiles of its prefix tokens, for its own band of sizes and the next."""
    b = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM)) + 1e-9).cast("int")
    rows = live.select("cls", "n", b.alias("band"), F.explode("prefix").alias("token"))
    return rows.select("token", F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("own")), F.struct((F.col("band") + 1).alias("tile"), F.lit(False).alias("own")))).alias("t"), "cls", "n").select("token", "t.*", "cls", "n")


def _sized(pairs: DataFrame) -> DataFrame:
    return pairs.filter(f"u <> v and {DEN} * least(nu, nv) >= {NUM} * greatest(nu, nv)").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def centres(rows: DataFrame) -> DataFrame:
    """(token, tile, k, c): tiles of two classes or more, how many they are, and an own class picked by hash."""
    pick = F.struct(F.xxhash64("cls").alias("h"), F.col("cls").alias("v"), F.col("n").alias("nv"))
    return rows.groupBy("token", "tile").agg(F.min(F.when(F.col("own"), pick)).alias("c"), F.count("*").alias("k")).filter("k > 1 and c is not null")


def star_pairs(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Each class of a tile with the tile's centre."""
    return _sized(common.join_hot(rows, centre, ["token", "tile"], "k").select(F.col("cls").alias("u"), F.col("n").alias("nu"), "c.v", "c.nv"))


def forest(i: np.ndarray, j: np.ndarray, slack: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs between components enough to connect what all of them would, if all link: in turns, each component takes
    the pair whose bound leaves most room, and components that meet become one."""
    _, at = np.unique(comp, return_inverse=True)
    out = []
    while len(i):
        u, v = at[i], at[j]
        order = np.argsort(-slack, kind="stable")
        best = np.unique(np.concatenate([order[np.unique(x[order], return_index=True)[1]] for x in (u, v)]))
        out.append((i[best], j[best]))
        a, b = u[best], v[best]
        root = np.arange(int(at.max()) + 1)
        while True:  # hook the greater root to the lesser, then shorten paths
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            np.minimum.at(root, np.maximum(ra[open_], rb[open_]), np.minimum(ra[open_], rb[open_]))
            while (root[root] != root).any():
                root = root[root]
        at = root[at]
        left = at[i] != at[j]
        i, j, slack = i[left], j[left], slack[left]
    if not out:
        return i, j
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def near(n, held, comp, own, side, maps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile's rows, in different components, whose bitmaps don't rule out a link, and how many tokens more than
    they need the bound leaves them. Rows of side 0 meet all that come later, or, where there is a side 1, all of that."""
    words = min(len(m) for m in maps)
    m = np.stack([fold(x, words) for x in maps])
    a_rows, b_rows = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    one = not len(b_rows)
    if one:
        b_rows = a_rows
    out: list[tuple] = []
    step = max(1, (1 << 21) // max(1, words * len(b_rows)))
    for k in range(0, len(a_rows), step):
        i = a_rows[k : k + step]
        need = least_common(n[i][:, None], n[b_rows][None])
        ok = (comp[i][:, None] != comp[b_rows][None]) & (own[i][:, None] | own[b_rows][None])
        ok &= (held[i][:, None] >= need) & (held[b_rows][None] >= need)
        if one:
            ok &= b_rows[None] > i[:, None]
        p, q = np.nonzero(ok)
        if not len(p):
            continue
        for c in range(0, len(p), max(1, (1 << 20) // words)):
            x, y = p[c : c + max(1, (1 << 20) // words)], q[c : c + max(1, (1 << 20) // words)]
            mx, my = m[i[x]], m[b_rows[y]]
            most = np.minimum(held[i[x]] - np.bitwise_count(mx & ~my).sum(axis=1, dtype=np.int64), held[b_rows[y]] - np.bitwise_count(my & ~mx).sum(axis=1, dtype=np.int64))
            good = most >= need[x, y]
            out.append((i[x][good], b_rows[y][good], (most - need[x, y])[good]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def mixed_rows(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows of tiles with several components, with their component and the number of blocks of their tile."""
    rows = common.cut(rows.join(label.withColumnsRenamed({"node": "cls", "component": "comp"}), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    mixed = common.cut(rows.groupBy("token", "tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).filter("lo <> hi").select("token", "tile", "k", F.ceil(F.col("k") / TILE_ROWS).cast("int").alias("nb")))
    return common.join_hot(rows, mixed, ["token", "tile"], "k").drop("k")


def open_pairs(rows: DataFrame, live: DataFrame, few: bool) -> DataFrame:
    """Pairs of a tile (rows of mixed_rows) whose components differ and whose bitmaps leave a link open. A tile is compared
    in one task, as bit matrices, and gives out no other pair; one of more than TILE_ROWS classes is split into blocks by
    hash, and each pair of blocks is compared for itself. few: of a tile's pairs only a forest() is given out."""
    rows = rows.withColumn("b", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    # block pairs (i, j) with i <= j: in (b, j) the class is on side 0, in (i, b) on side 1
    own = F.transform(F.sequence(F.col("b"), F.col("nb") - 1), lambda j: F.struct(F.col("b").alias("bi"), j.alias("bj"), F.lit(0).alias("side")))
    other = F.when(F.col("b") > 0, F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda i: F.struct(i.alias("bi"), F.col("b").alias("bj"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<bi:int,bj:int,side:int>>"))
    rows = rows.withColumn("t", F.explode(F.concat(own, other))).select("token", "tile", "t.*", "cls", "comp", "own")
    rows = rows.join(live.select("cls", "n", "held", "bits"), "cls")
    keys = ["token", "tile", "bi", "bj"]
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "cls").select(*keys, "side", "cls", "comp", "own", "n", "held", "bits")

    def tile(t: pa.Table):
        cls, comp, n, held = (t.column(k).to_numpy() for k in (5, 6, 8, 9))
        own, side = t.column(7).to_numpy(), t.column(4).to_numpy()
        maps = [np.frombuffer(x, _U64) for x in t.column(10).to_pylist()]
        i, j, slack = near(n, held, comp, own, side, maps)
        if few:
            i, j = forest(i, j, slack, comp)
        return np.maximum(cls[i], cls[j]), np.minimum(cls[i], cls[j])

    def run(batches):
        left: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*left, b])
            k = [t.column(c).to_numpy() for c in range(4)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            edges = [0, *new.tolist()]
            got = [tile(t.slice(x, y - x)) for x, y in zip(edges, edges[1:], strict=False)]
            left = t.slice(edges[-1]).to_batches()
            yield from links(got)
        if left:
            yield from links([tile(pa.Table.from_batches(left))])

    def links(got):
        u, v = (np.concatenate([g[k] for g in got]) if got else np.empty(0, np.int64) for k in (0, 1))
        if len(u):
            pair = np.unique(np.stack([u, v]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def class_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (see documents()); links between classes (u, v), enough of them to connect whatever links connect; and
    component labels (node, component)."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(chars) // BUCKET_CHARS))
    shared = common.cut(shared_tokens(token_chunks(docs, buckets)))
    every, live = common.cut(documents(shared)), common.cut(survivors(shared))
    common.free(shared)
    sets = every.filter("cls is not null").select("k1", "k2", "cls").distinct()
    first = sets.groupBy("k1", "k2").agg(F.min("cls").alias("first"), F.count("*").alias("c")).filter("c > 1")
    copies = sets.join(first, ["k1", "k2"]).filter("cls <> first").select("cls")  # equal sets of other chunks
    rows = common.cut(tiles(live.select("cls", "n", "prefix").join(copies, "cls", "left_anti")))
    centre = common.cut(centres(rows))
    found = [common.cut(verify(star_pairs(rows, centre), live))]
    common.free(centre)
    # Pairs that link mostly share many tiles, and most pairs that the bound leaves do link. So an eighth of the tiles, and
    # then all of them, give out a forest each; what is still apart after that is compared in full.
    eighth = F.pmod(F.xxhash64("token"), F.lit(8)) == 0
    for some, few in ((eighth, True), (F.lit(True), True), (F.lit(True), False)):
        label = common.cut(connected_components(_all(found)))
        mixed = common.cut(mixed_rows(rows.filter(some), label))
        found.append(common.cut(verify(open_pairs(mixed, live, few), live)))
        common.free(label, mixed)
    label = common.cut(connected_components(_all(found)))
    common.free(rows, live)
    return every, _all(found), label


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of each row of docs (doc_id, text)."""
    common.prepare(docs.sparkSession)
    every, _, label = class_links(docs)
    sets = every.filter("cls is not null").groupBy("k1", "k2").agg(F.min("cls").alias("cls"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    sets = common.cut(sets.join(label.withColumnsRenamed({"node": "cls", "component": "root"}), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    roots = common.cut(sets.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")))
    sets = common.cut(common.join_hot(sets, roots, ["root"], "sets").select("k1", "k2", "copies", "component_id"))
    full = common.join_hot(every.filter("cls is not null"), sets, ["k1", "k2"], "copies").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.unionByName(every.filter("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each group of docs (any columns beside doc_id and text): that of least doc_id, and of several with it the
    first as they are stored. Each row is a document of its own, by a key written once with the rows; rows without a
    doc_id come last in their group, and stay where no other row is linked to them."""
    key, group = common.spare("row__", docs), common.spare("group__", docs)
    keyed = common.cut(docs.withColumn(key, F.monotonically_increasing_id()))
    groups = common.cut(components(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("component_id").alias(group)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)
    first = keyed.select(key, "doc_id").join(groups, key).groupBy(group).agg(F.min(place).alias("first")).select(F.col(f"first.{key}").alias(key))
    # rows that go are fewer than rows that stay
    gone = common.cut(groups.select(key).join(first, key, "left_anti"))
    return side.without(keyed, gone, key)


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return components(common.table(spark, sf_dir, "documents"))


SQL = {"op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, ws[i:i + 4] AS sh FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
    UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON r.doc_id = e.u)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""}
