"""Operators on whole images, a row an image: smoothing, regions, masks, contours, local histogram equalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def each_image(images: DataFrame, f: Callable[[np.ndarray], np.ndarray], height: int, width: int) -> DataFrame:
    """``image_id, pixels`` with f applied to each image."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"image_id": b["image_id"], "pixels": [f(np.asarray(p, np.float64).reshape(height, width)).astype(np.float64).ravel() for p in b["pixels"]]})

    return images.select("image_id", "pixels").mapInPandas(work, "image_id long, pixels array<double>")


def gaussian(im: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian to four deviations, reflected at the edges."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        n = im.shape[axis]
        at = np.abs((np.arange(-r, n + r) + n * 2 * (r // n + 1)) % (2 * n))
        at = np.where(at >= n, 2 * n - 1 - at, at)
        padded = np.take(im, at, axis)
        im = sum(w * np.take(padded, np.arange(j, j + n), axis) for j, w in enumerate(k))
    return im


def neighbours(mask: np.ndarray) -> list[np.ndarray]:
    p = np.pad(mask, 1)
    return [p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]


def dilate(mask: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([mask, *neighbours(mask)])


def erode(mask: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([mask, *neighbours(mask)])


def spread(seed: np.ndarray, within: np.ndarray) -> np.ndarray:
    while True:
        new = dilate(seed) & within
        if (new == seed).all():
            return seed
        seed = new


def fill_holes(mask: np.ndarray) -> np.ndarray:
    edge = np.zeros_like(mask)
    edge[[0, -1]], edge[:, [0, -1]] = True, True
    return ~spread(edge & ~mask, ~mask)


def label_regions(mask: np.ndarray) -> np.ndarray:
    """Four-connected regions numbered from 1 in the order of their first pixels. Runs of pixels along rows are the nodes; runs of rows one above the
    other that overlap are joined, all of them at once, until none changes."""
    h, w = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    stop = np.nonzero(edges == -1)[1]
    # runs of one row and the next overlap where each starts before the other stops: a range of neighbours for each run
    key = w + 2
    low = np.searchsorted(row * key + stop, (row + 1) * key + start, "right")
    high = np.searchsorted(row * key + start, (row + 1) * key + stop, "left")
    n = np.maximum(0, high - low)
    i = np.repeat(np.arange(len(row)), n)
    j = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    root = np.arange(len(row))
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]
    number = np.cumsum(root == np.arange(len(row)))[root] if len(row) else root
    out = np.zeros(h * w + 1, np.int64)  # a run's number is added where it starts and taken off where it stops
    np.add.at(out, row * w + start, number)
    np.add.at(out, row * w + stop, -number)
    return np.cumsum(out[:-1]).reshape(h, w)


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    labels = label_regions(mask)
    return (np.bincount(labels.ravel())[labels] >= least) & mask


def std_mask(std: np.ndarray, sigma: float = 10.0, percentile: float = 60.0, least: int = 5000) -> np.ndarray:
    """The bright part of a deviation image: smoothed, over a percentile, eroded, without small regions and holes."""
    s = gaussian(std, sigma)
    return fill_holes(drop_small(erode(s > np.percentile(s, percentile)), least))


def contour_mask(y: np.ndarray, x: np.ndarray, height: int, width: int, samples: int = 2000) -> np.ndarray:
    """The filled contour: resampled, drawn, closed by a dilation, filled, eroded; the border is off."""
    at = np.linspace(0, len(x) - 1, samples)
    k = np.arange(len(x))
    im = np.zeros((height, width), bool)
    im[np.clip(np.floor(np.interp(at, k, y)).astype(int), 0, height - 1), np.clip(np.floor(np.interp(at, k, x)).astype(int), 0, width - 1)] = True
    im = erode(fill_holes(dilate(im)))
    im[[0, -1]], im[:, [0, -1]] = False, False
    return im


def outline(mask: np.ndarray) -> np.ndarray:
    """(n, 2) boundary pixels (y, x) of a mask, in the order of their angle about its centre."""
    y, x = np.nonzero(mask & ~erode(mask))
    order = np.argsort(np.arctan2(y - y.mean(), x - x.mean()), kind="stable") if len(y) else []
    return np.stack([y[order], x[order]], 1)


def largest_regions(labels: np.ndarray) -> np.ndarray:
    """Each label's largest connected region; other pixels are 0."""
    out = np.zeros_like(labels)
    for v in np.unique(labels[labels > 0]):
        r = label_regions(labels == v)
        out[r == np.bincount(r.ravel())[1:].argmax() + 1] = v
    return out


def adapt_histogram(im: np.ndarray, tiles: int = 8, clip: float = 2.0, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation: each tile's clipped cumulative histogram, bilinear between tiles; 0..1."""
    lo, hi = float(im.min()), float(im.max())
    q = np.clip(((im - lo) / max(hi - lo, 1e-12) * (bins - 1)).astype(int), 0, bins - 1)
    h, w = im.shape
    ty, tx = min(tiles, h), min(tiles, w)
    ys, xs = np.linspace(0, h, ty + 1).astype(int), np.linspace(0, w, tx + 1).astype(int)
    maps = np.zeros((ty, tx, bins))
    for i in range(ty):
        for j in range(tx):
            c = np.bincount(q[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].ravel(), minlength=bins).astype(float)
            limit = max(1.0, clip * c.sum() / bins)
            c = np.minimum(c, limit) + np.maximum(c - limit, 0).sum() / bins
            maps[i, j] = np.cumsum(c) / c.sum()
    cy = np.clip((np.arange(h) + 0.5) / h * ty - 0.5, 0, ty - 1)[:, None]
    cx = np.clip((np.arange(w) + 0.5) / w * tx - 0.5, 0, tx - 1)[None, :]
    i, j = np.minimum(cy.astype(int), max(ty - 2, 0)), np.minimum(cx.astype(int), max(tx - 2, 0))
    i1, j1, fy, fx = np.minimum(i + 1, ty - 1), np.minimum(j + 1, tx - 1), cy - i, cx - j
    return (1 - fy) * ((1 - fx) * maps[i, j, q] + fx * maps[i, j1, q]) + fy * ((1 - fx) * maps[i1, j, q] + fx * maps[i1, j1, q])
