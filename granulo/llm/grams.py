"""Hashed n-grams of symbol sequences, in slices of bounded memory, for linear scores and for sparse counts."""

from __future__ import annotations

import numpy as np

from . import common

SLICE = 1 << 19
_U64 = np.uint64


def buckets(sym: np.ndarray, offs: np.ndarray, a: int, b: int, n: int, bits: int, breaks: np.ndarray | None = None) -> np.ndarray:
    """Buckets of the n-grams that begin at symbols a to b; 1 << bits where one would leave its row, or hold a break inside.
    offs: where rows begin and end. breaks: which symbols (such as spaces) may stand only at an n-gram's ends."""
    seg = sym[a : b + n - 1].astype(_U64)
    m = b - a
    if len(seg) < b - a + n - 1:
        seg = np.concatenate([seg, np.zeros(b - a + n - 1 - len(seg), _U64)])
    with np.errstate(over="ignore"):
        h = np.full(m, n, _U64)
        for j in range(n):
            h = (h ^ seg[j : j + m]) * _U64(0x9E3779B97F4A7C15)
            h ^= h >> _U64(29)
        out = ((h * _U64(0xBF58476D1CE4E5B9)) >> _U64(64 - bits)).astype(np.int64)
    ends = offs[1:][(offs[1:] > a) & (offs[1:] < b + n)]
    for j in range(1, n):
        at = ends - j - a
        out[at[(at >= 0) & (at < m)]] = 1 << bits
    if breaks is not None:
        br = breaks[a : b + n - 1]
        br = np.concatenate([br, np.ones(b - a + n - 1 - len(br), bool)])
        for j in range(1, n - 1):
            out[br[j : j + m]] = 1 << bits
    return out


def sums(sym: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...], table: np.ndarray, bits: int, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sum of the table's rows over its n-grams, and their number. table: (1 << bits) + 1 rows, the last zero."""
    total = np.zeros((len(offs) - 1, table.shape[1]))
    count = np.zeros(len(offs) - 1)
    for a in range(0, len(sym), SLICE):
        b = min(a + SLICE, len(sym))
        lo, hi = np.clip(offs[:-1], a, b) - a, np.clip(offs[1:], a, b) - a
        for n in sizes:
            k = buckets(sym, offs, a, b, n, bits, breaks)
            c = np.zeros((b - a + 1, table.shape[1]))
            np.cumsum(table[k], axis=0, out=c[1:])
            total += c[hi] - c[lo]
            c = np.concatenate([[0], np.cumsum(k < 1 << bits)])
            count += c[hi] - c[lo]
    return total, count


def counts(sym: np.ndarray, sizes: tuple[int, ...], bits: int, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one row's n-grams, in order, and how often each occurs."""
    total = np.zeros((1 << bits) + 1, np.int64)
    offs = np.array([0, len(sym)])
    for a in range(0, len(sym), SLICE):
        b = min(a + SLICE, len(sym))
        for n in sizes:
            total += np.bincount(buckets(sym, offs, a, b, n, bits, breaks), minlength=len(total))
    k = np.flatnonzero(total[:-1])
    return k, total[k]


def bounded(k: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights, of at most so many buckets, picked by their hash; the total weight stays."""
    if len(k) > most:
        pick = np.sort(np.argsort(common.mix(k.astype(_U64)), kind="stable")[:most])
        k, n = k[pick], n[pick] * (n.sum() / n[pick].sum())
    return k, n
