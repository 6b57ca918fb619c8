"""Which circles hang together and which lie inside another, without a list of all pairs that touch.

Where circles are dense, pairs grow with the square of their number. Components need no more than a forest of them, and a
circle is inside another as soon as one is found. So circles are dealt to square tiles, once for each size class that their
data set has at or above their own, with a rim of circles of that class around each tile. Within a tile circles of a class that
share a cell narrower than half of the least of them touch for certain and are taken together; groups are compared by their
bounds, and circles one by one only where bounds leave it open and nothing has joined the groups yet.

Results are those of overlap.overlap_pairs(): circles and bounds are compared by the same sums, whose rounding keeps the order
of lengths, so a bound never says what a comparison of circles would not. Circles without a finite place and size touch nothing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlap import LEVELS, gridded

#: Cells of a size class along the side of its tiles.
TILE = 4
#: Rows of whole tiles that are worked on at once, and pairs compared at once.
BATCH, CHUNK = 150_000, 2_000_000
#: Share of a class's cell within which its circles touch for certain: a diagonal of 0.495 against a least diameter of 0.5.
CLIQUE = 0.35
#: Up to so many data sets a row for each is broadcast, so that circles of one needn't meet in a task.
SETS = 10_000
#: Widens searches against rounding.
SLACK = 1e-6
#: What names a tile.
KEY = ["ds_id", "at", "tx", "ty"]
#: Radii of search for what contains a circle fall into this many classes, each of half the size of the one before.
RADII = 12


def nodes(parts: DataFrame, inside: bool = True) -> DataFrame:
    """(ds_id, ID, root, idj), several rows for a circle or none. Each row with ID <> root says that these hang together, and all
    of them together say everything that does; idj says that the circle is inside another. A number of rows in proportion to
    circles, however many pairs there are. Without inside only links are looked for, and idj is null."""
    return _dealt(parts).mapInArrow(partial(_worked, inside=inside), "ds_id string, ID long, root long, idj boolean")


def _dealt(parts: DataFrame) -> DataFrame:
    """Circles with their tiles, one tile after another: in order of a hash, which Spark sorts faster than four columns."""
    finite = [F.abs(F.col(c)) < F.lit(float("inf")) for c in ("X", "Y", "D")]
    few = parts.select("ds_id").distinct().limit(SETS + 1).count() <= SETS
    g = gridded(parts.filter(finite[0] & finite[1] & finite[2]), few)
    levels = g.groupBy("ds_id").agg(F.collect_set("level").alias("levels"))
    j = g.join(F.broadcast(levels) if few else levels, "ds_id").select("ds_id", "ID", "X", "Y", "D", "cell0", "level", F.explode(F.filter("levels", lambda k: k <= F.col("level"))).alias("at"))
    j = j.withColumn("cell", F.col("cell0") / F.pow(F.lit(2.0), F.col("at").cast("double"))).drop("cell0")
    tile = lambda v: F.floor(v / (F.col("cell") * TILE))
    for x, t in (("X", "tx"), ("Y", "ty")):
        rim = F.when(F.col("level") == F.col("at"), F.col("cell") * (1 + SLACK)).otherwise(F.lit(0.0))
        j = j.withColumn(f"own_{t}", tile(F.col(x))).withColumn(t, F.explode(F.sequence(tile(F.col(x) - rim), tile(F.col(x) + rim))))
    j = j.select(F.xxhash64(*KEY).alias("tile"), *KEY, "ID", "X", "Y", "D", "level", "cell", ((F.col("own_tx") == F.col("tx")) & (F.col("own_ty") == F.col("ty"))).alias("own"))
    return j.repartition("tile").sortWithinPartitions("tile")


def links(nodes: DataFrame) -> DataFrame:
    """(ds_id, a, b): a forest for each tile, which has the components of all pairs."""
    return nodes.filter("ID <> root").select("ds_id", F.col("ID").alias("a"), F.col("root").alias("b"))


def flag_contained(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """parts with the boolean idj."""
    inside = nodes.filter("idj").select("ds_id", "ID").distinct().withColumn("in__", F.lit(True))
    return parts.join(inside, ["ds_id", "ID"], "left").withColumn("idj", F.coalesce("in__", F.lit(False))).drop("in__")


# ---- on the workers ---------------------------------------------------------------------------


def _worked(batches: Iterator[pa.RecordBatch], inside: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows of a tile's hash come together; whole tiles are gathered to about BATCH rows."""
    held, rows, enough = [], 0, BATCH
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < enough:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        start = np.flatnonzero(_changes(t.column("tile").to_numpy()))[-1]
        if start:
            yield from _told(t.slice(0, start), inside)
        t = t.slice(start)
        held, rows = t.to_batches(), t.num_rows
        enough = max(BATCH, 2 * rows)
    if rows:
        yield from _told(pa.Table.from_batches(held), inside)


def _starts(t: pa.Table) -> np.ndarray:
    """Where a row is the first of its tile, if tiles aren't mixed."""
    ds = pc.dictionary_encode(t.column("ds_id").combine_chunks())
    ds = (ds.combine_chunks() if isinstance(ds, pa.ChunkedArray) else ds).indices.to_numpy(zero_copy_only=False)
    return _changes(ds, *[t.column(c).to_numpy() for c in KEY[1:]])


def _told(t: pa.Table, within: bool = True) -> Iterator[pa.RecordBatch]:
    start = _starts(t)
    if (start > _changes(t.column("tile").to_numpy())).any():  # tiles of one hash
        t = t.sort_by([(k, "ascending") for k in ("tile", *KEY)])
        start = _starts(t)
    c = {n: t.column(n).to_numpy(zero_copy_only=False) for n in ("at", "ID", "X", "Y", "D", "level", "cell", "own")}
    root, own_class, inside = tiled(np.cumsum(start) - 1, **c, within=within)
    say = np.flatnonzero((own_class & (root != np.arange(len(root)))) | inside)
    out = pa.table({"ds_id": t.column("ds_id").take(pa.array(say)), "ID": c["ID"][say], "root": np.where(own_class, c["ID"][root], c["ID"])[say], "idj": pa.array(inside[say]) if within else pa.nulls(len(say), pa.bool_())})
    yield from out.to_batches()


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Takes u and v together: hooks the greater root to the lesser, then shortens paths."""
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            return
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root[:] = root[root]


def _spread(start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, element) for the elements start, start + 1, ... of each slot; some CHUNK of them at once, or one slot."""
    ends = np.cumsum(count)
    i = 0
    while i < len(count):
        done = ends[i - 1] if i else 0
        k = max(i + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n = count[i:k]
        slot = np.repeat(np.arange(i, k), n)
        yield slot, start[slot] + np.arange(len(slot)) - np.repeat(ends[i:k] - n - done, n)
        i = k


def tiled(t, at, ID, X, Y, D, level, cell, own, within=True):
    """For rows of whole tiles (t: their number, ascending): the row that stands for all that hang together with it, whether a row
    says so (any of its own class in its own tile; of others one for each group), and whether it is inside another (within;
    else not looked for, and false)."""
    coarse = level == at
    n = len(t)
    # Groups: circles of a class in one cell, the largest first (the same one in every tile that has the whole cell).
    alone = (level >= LEVELS) | ~(D > 0)
    w = cell * np.exp2((at - level).astype(float)) * CLIQUE
    while True:
        gx, gy = np.where(alone, np.arange(n), np.floor(X / w)), np.where(alone, 0.0, np.floor(Y / w))
        order = np.lexsort((ID, -D, gy, gx, alone, level, t))
        first = np.flatnonzero(_changes(*[c[order] for c in (t, level, alone, gx, gy)]))
        group = np.empty(n, int)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        head = order[first]
        some = lambda f, c: f.reduceat(c[order], first)  # noqa: B023, E731
        g = {"lx": some(np.minimum, X), "hx": some(np.maximum, X), "ly": some(np.minimum, Y), "hy": some(np.maximum, Y), "lD": some(np.minimum, D), "hD": D[head], "t": t[head], "own": some(np.logical_or, own), "at": at[head], "level": level[head]}
        wide = (_length(g["hx"] - g["lx"], g["hy"] - g["ly"]) > g["lD"])[group] & ~alone  # only where places are too large to tell cells apart
        if not wide.any():
            break
        alone |= wide
    root = np.arange(len(first))
    # Members that matter for links: of those at one place the largest.
    o = np.lexsort((-D, Y, X, group))
    kept = o[_changes(*[c[o] for c in (group, X, Y)])]
    kept_count = np.bincount(group[kept], minlength=len(first))
    kept_start = np.cumsum(kept_count) - kept_count
    for a, b in _candidates(g, cell[head], coarse[head]):
        _linked(root, a, b, g, X, Y, D, kept, kept_start, kept_count, head)
    own_class = own & coarse
    own_class[head] = True
    return head[root[group]], own_class, _inside(t, X, Y, D, cell, coarse, own) if within else np.zeros(n, bool)


def _candidates(g: dict, cell: np.ndarray, coarse: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of groups, the second of the tile's own class, that may touch by where they are."""
    side = cell * CLIQUE
    b = np.flatnonzero(coarse)
    bx, by = np.floor(g["lx"] / side), np.floor(g["ly"] / side)
    # Places within the tile are small numbers.
    tiles = g["t"][-1] + 1 if len(b) else 0
    ox, oy, far = np.full(tiles, np.inf), np.full(tiles, np.inf), np.zeros(tiles)
    np.minimum.at(ox, g["t"][b], bx[b])
    np.minimum.at(oy, g["t"][b], by[b])
    np.maximum.at(far, g["t"][b], g["hD"][b])
    a = np.flatnonzero(g["own"] & np.isfinite(ox[g["t"]])) if len(b) else b
    if not len(a):
        return
    at = lambda v, o, side, t: np.clip(np.floor(v / side) - o[t], -1, 1023).astype(np.int64)
    key = (g["t"][b] * 1024 + at(g["lx"][b], ox, side[b], g["t"][b])) * 1024 + at(g["ly"][b], oy, side[b], g["t"][b])
    sort = np.argsort(key, kind="stable")
    b, key = b[sort], key[sort]
    ta, sa = g["t"][a], side[a]
    reach = (g["hD"][a] + far[ta]) / 2 * (1 + SLACK)
    x0, x1 = np.maximum(at(g["lx"][a] - reach, ox, sa, ta), 0), at(g["hx"][a] + reach, ox, sa, ta)
    y0, y1 = np.maximum(at(g["ly"][a] - reach, oy, sa, ta), 0), at(g["hy"][a] + reach, oy, sa, ta)
    for slot, x in _spread(x0, np.where(y1 >= y0, np.maximum(x1 - x0 + 1, 0), 0)):
        base = (ta[slot] * 1024 + x) * 1024
        lo, hi = np.searchsorted(key, base + y0[slot], "left"), np.searchsorted(key, base + y1[slot], "right")
        for s, e in _spread(lo, hi - lo):
            left, right = a[slot[s]], b[e]
            once = (g["level"][left] > g["at"][left]) | (left < right) | ~g["own"][right]
            once &= left != right
            yield left[once], right[once]


def _linked(root, a, b, g, X, Y, D, kept, start, count, head) -> None:
    """Takes groups together that touch. Bounds first, then the largest of each, then all that may."""
    near = _length(_gap(g["lx"][a], g["hx"][a], g["lx"][b], g["hx"][b]), _gap(g["ly"][a], g["hy"][a], g["ly"][b], g["hy"][b])) <= (g["hD"][a] + g["hD"][b]) / 2
    a, b = a[near], b[near]
    far = _length(np.maximum(g["hx"][a] - g["lx"][b], g["hx"][b] - g["lx"][a]), np.maximum(g["hy"][a] - g["ly"][b], g["hy"][b] - g["ly"][a]))
    sure = far <= (g["lD"][a] + g["lD"][b]) / 2
    _joined(root, a[sure], b[sure])
    open_ = root[a] != root[b]
    a, b = a[open_], b[open_]
    one = _touch(X, Y, D, head[a], head[b])
    _joined(root, a[one], b[one])
    open_ = root[a] != root[b]
    a, b = a[open_], b[open_]
    for slot, e in _spread(start[a], count[a]):  # a member of one group and the other group
        i, to, of = kept[e], b[slot], a[slot]
        may = (root[of] != root[to]) & (_length(_gap(X[i], X[i], g["lx"][to], g["hx"][to]), _gap(Y[i], Y[i], g["ly"][to], g["hy"][to])) <= (D[i] + g["hD"][to]) / 2)
        i, to, of = i[may], to[may], of[may]
        for s, f in _spread(start[to], count[to]):
            hit = _touch(X, Y, D, i[s], kept[f])
            _joined(root, of[s[hit]], to[s[hit]])


def _gap(la, ha, lb, hb):
    """Between two ranges; 0 where they meet."""
    return np.maximum(np.maximum(la - hb, lb - ha), 0.0)


def _length(dx, dy):
    """As geometry.distance() has it."""
    return np.sqrt(dx * dx + dy * dy)


def _touch(X, Y, D, i, j):
    return _length(X[i] - X[j], Y[i] - Y[j]) <= (D[i] + D[j]) / 2


def _inside(t, X, Y, D, cell, coarse, own) -> np.ndarray:
    """Rows of the tile itself that a circle of its class contains. Of those at one place only the largest can be needed; to be
    inside one of them, a circle must be nearer than its radius of search, (the tile's largest D - its own D) / 2, and
    so must be half of what the other lacks to the largest. Both fall into classes."""
    inside = np.zeros(len(t), bool)
    b = np.flatnonzero(coarse)
    if not len(b):
        return inside
    b = b[np.lexsort((-D[b], Y[b], X[b], t[b]))]
    new = _changes(t[b], X[b], Y[b])
    best = b[new]
    twin = np.flatnonzero(new[:-1] & ~new[1:])
    twin = twin[(D[b[twin]] == D[b[twin + 1]]) & (D[b[twin]] >= 0)]
    inside[b[twin]] = own[b[twin]]  # two of equal size at one place contain each other
    tiles = t[-1] + 1
    top, ox, oy = np.full(tiles, -np.inf), np.full(tiles, np.inf), np.full(tiles, np.inf)
    np.maximum.at(top, t[b], D[b])
    np.minimum.at(ox, t[b], X[b])
    np.minimum.at(oy, t[b], Y[b])
    widest = cell / 2 * (1 + SLACK)
    radius = np.minimum((top[t] - D) / 2, widest)
    a = np.flatnonzero(own & (radius >= 0) & ~inside)
    lacks = (top[t[best]] - D[best]) / 2
    with np.errstate(divide="ignore"):
        kind = np.clip(np.floor(np.log2(widest[a] / radius[a])), 0, RADII).astype(int)
    low = -(1 << 18)
    for k in np.unique(kind):
        width = widest * 2.0**-k * (1 + SLACK)
        at = lambda v, o, i: np.clip(np.floor((v[i] - o[t[i]]) / width[i]), low, 1 - low).astype(np.int64)  # noqa: B023, E731
        have = best[lacks <= width[best]]
        hx, hy = at(X, ox, have), at(Y, oy, have)
        place = lambda i, x, y: (t[i] * (1 << 20) + x - low) * (1 << 20) + y - low  # noqa: B023, E731
        key = place(have, hx, hy)
        sort = np.lexsort((-D[have], key))
        have, key = have[sort], key[sort]
        mine = a[kind == k]
        mx, my = at(X, ox, mine), at(Y, oy, mine)
        for dx in (0, -1, 1):
            left = np.flatnonzero(~inside[mine])
            lo = np.searchsorted(key, place(mine[left], mx[left] + dx, my[left] - 1), "left")
            hi = np.searchsorted(key, place(mine[left], mx[left] + dx, my[left] + 1), "right")
            who, step = mine[left], 8
            while True:  # a few at first, more for those that none of them contains
                go = (lo < hi) & ~inside[who]
                who, lo, hi = who[go], lo[go], hi[go]
                if not len(who):
                    break
                take = np.minimum(hi - lo, step)
                for s, e in _spread(lo, take):
                    i, j = who[s], have[e]
                    hit = (i != j) & (_length(X[i] - X[j], Y[i] - Y[j]) <= (D[j] - D[i]) / 2) & ((D[i] >= 0) | _touch(X, Y, D, i, j))
                    inside[i[hit]] = True
                lo, step = lo + take, step * 4
    return inside
