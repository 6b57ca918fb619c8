"""Circles on grey images: crop, median, and detection by gradient voting, all numpy inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granulo.functions.values import zip_parameters
from granulo.sources.images import pixels


#: Share of a circle's length on which edge points must lie.
MIN_ARC = 0.35


def crop(image: np.ndarray, ratio: float) -> np.ndarray:
    """Without the lowest part; ratio of the height."""
    if not 0 <= ratio < 1:
        raise ValueError(f"crop ratio {ratio} is not in [0, 1)")
    return image[: int((1 - ratio) * image.shape[0])]


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, size // 2, mode="edge"), (size, size))


def median_blur(image: np.ndarray, size: int | None) -> np.ndarray:
    if not size or size < 2:
        return image
    return np.median(_windows(image, size).reshape(*image.shape, -1), axis=2).astype(image.dtype)


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(image.astype(float), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return gx, gy


def edges(image: np.ndarray, high: float, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge mask and gradients: maxima across the gradient, strong ones and what is joined to them."""
    gx, gy = gradients(image)
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    ax, ay = np.abs(gx), np.abs(gy)
    horizontal, vertical = ay <= 0.4142 * ax, ax <= 0.4142 * ay
    diagonal = np.where(gx * gy > 0, 1, 2)
    c = p[1:-1, 1:-1]
    peak = np.select(
        [horizontal, vertical, diagonal == 1],
        [(c > p[1:-1, :-2]) & (c >= p[1:-1, 2:]), (c > p[:-2, 1:-1]) & (c >= p[2:, 1:-1]), (c > p[:-2, :-2]) & (c >= p[2:, 2:])],
        (c > p[:-2, 2:]) & (c >= p[2:, :-2]),
    )
    weak, out = peak & (m > low), peak & (m > high)
    while True:
        grown = weak & _windows(out, 3).any(axis=(2, 3))
        if (grown == out).all():
            return out, gx, gy
        out = grown


def hough_circles(image: np.ndarray, d_min: float, d_max: float, dist2R: float = 0.4, param1: float = 200, param2: float = 15) -> np.ndarray:
    """Rows (X, Y, R), best first. Edge points vote along their gradient for centres at any radius allowed; a centre needs
    more than param2 votes, the place of most votes around, and dist2R * d_max / 2 of distance to better ones; its radius
    is the one at which most of its edge points lie, for its length; they must be more than param2 and cover MIN_ARC."""
    r_min, r_max = max(1, int(d_min / 2)), int(d_max / 2)
    mask, gx, gy = edges(image, param1, param1 / 2)
    y, x = np.nonzero(mask)
    if not len(x) or r_max < r_min:
        return np.empty((0, 3))
    g = np.hypot(gx[y, x], gy[y, x])
    ux, uy = gx[y, x] / g, gy[y, x] / g
    h, w = image.shape
    votes = np.zeros(h * w)
    for r in range(r_min, r_max + 1):
        for s in (-r, r):
            cx, cy = np.rint(x + s * ux).astype(int), np.rint(y + s * uy).astype(int)
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            votes += np.bincount(cy[ok] * w + cx[ok], minlength=h * w)
    smooth = _windows(votes.reshape(h, w), 3).sum(axis=(2, 3))
    top = (votes.reshape(h, w) > 0) & (smooth > param2) & (smooth >= _windows(smooth, 5).max(axis=(2, 3)))
    cy, cx = np.nonzero(top)
    found: list[tuple[float, float, float]] = []
    least = dist2R * d_max / 2
    for k in np.argsort(-smooth[cy, cx], kind="stable").tolist():
        a, b = float(cx[k]), float(cy[k])
        if any((a - p) ** 2 + (b - q) ** 2 < least * least for p, q, _ in found):
            continue
        d = np.hypot(x - a, y - b)
        d = d[(d >= r_min - 0.5) & (d < r_max + 0.5)]
        if not len(d):
            continue
        n = np.bincount(np.rint(d).astype(int), minlength=r_max + 2).astype(float)
        near = n + 0.5 * np.concatenate([[0], n[:-1]]) + 0.5 * np.concatenate([n[1:], [0]])
        r = int((near[r_min : r_max + 1] / np.arange(r_min, r_max + 1)).argmax()) + r_min
        if near[r] > max(param2, MIN_ARC * 2 * np.pi * r):
            found.append((a, b, float(d[np.abs(d - r) <= 1.5].mean())))
    return np.array(found).reshape(-1, 3)


def detect(images: DataFrame, d_min, d_max, dist2R=0.5, param1=200, param2=15, crop_ratio: float = 0.0, median: int | None = 3) -> DataFrame:
    """(ds_id, ID, X, Y, R) in pixels of all passes over images (ds_id, content): a pass for each parameter tuple, nothing
    merged, IDs from 0 by pass and place. Each image and pass is a row of its own, so passes run side by side."""
    passes = zip_parameters(d_min=d_min, d_max=d_max, dist2R=dist2R, param1=param1, param2=param2)
    if any(v is None for p in passes for v in p.values()):
        raise ValueError("detection needs all of its parameters")
    numbers = F.array(*[F.lit(k) for k in range(len(passes))])

    def run(batches):
        for b in batches:
            for ds, content, k in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found = hough_circles(median_blur(crop(pixels(content), crop_ratio), median), **passes[k])
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([ds] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array(np.arange(n)), *[pa.array(found[:, c], pa.float64()) for c in range(3)]], ["ds_id", "pass", "place", "X", "Y", "R"])

    rows = images.select("ds_id", "content", F.explode(numbers).alias("pass")).mapInArrow(run, "ds_id string, pass int, place long, X double, Y double, R double")
    return rows.withColumn("ID", (F.row_number().over(Window.partitionBy("ds_id").orderBy("pass", "place")) - 1).cast("long")).select("ds_id", "ID", "X", "Y", "R")
