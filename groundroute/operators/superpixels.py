"""Superpixels of regions: clusters over place and colour, whole rows of regions at a time.

The published idea (seeds on a grid, assignment to the nearest centre of those within twice the seed distance, a fixed number of rounds, small
pieces joined to a neighbour), not any library's result. A group is a row of one image's regions; regions of one shape are one array, and every
step is taken for all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .integral import CELL

#: Distances that a task holds together.
TOGETHER = 1 << 19


def seeds(n: int, segments: int) -> np.ndarray:
    """Places of the seeds along a side of n pixels."""
    return np.unique(np.linspace(0, n - 1, min(max(1, int(round(np.sqrt(segments)))), n)).round()).astype(np.int64)


def spacing(h: int, w: int, segments: int) -> float:
    """The seed distance: the side of a segment's share of the region."""
    return max(1.0, float(np.sqrt(h * w / segments)))


def blurred(rgb: np.ndarray, sigma: float) -> np.ndarray:
    """Of regions (n, h, w, 3): a Gaussian along both sides, four sigma wide, mirrored at the borders with the border pixel repeated."""
    if not sigma:
        return rgb
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (1, 2):
        n = rgb.shape[axis]
        at = np.mod(np.arange(-reach, n + reach), 2 * n)
        at = np.where(at < n, at, 2 * n - 1 - at)
        mix = np.zeros((n, n))  # out of each place into each
        for k, weight in enumerate(weights):
            np.add.at(mix, (np.arange(n), at[k : k + n]), weight)
        rgb = np.moveaxis(np.tensordot(rgb, mix, axes=(axis, 1)), -1, axis)
    return rgb


def assign(rgb: np.ndarray, colours: np.ndarray, places: np.ndarray, weight: float, reach: float | None) -> np.ndarray:
    """The nearest centre of each pixel of regions (n, h, w, 3): by squared colour distance and weight times squared distance. colours (n, c, 3) and
    places (n, c, 2) of the centres; reach: only centres within it along both sides count, where there is one."""
    n, h, w, _ = rgb.shape
    y, x = (v.reshape(1, -1, 1) for v in np.meshgrid(np.arange(float(h)), np.arange(float(w)), indexing="ij"))
    cy, cx = places[:, None, :, 0], places[:, None, :, 1]
    d, part = (np.empty((n, h * w, places.shape[1])) for _ in range(2))

    def squared(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> np.ndarray:
        return np.square(np.subtract(a, b, out=out), out=out)

    squared(y, cy, d)
    d += squared(x, cx, part)
    d *= weight
    for c in range(3):
        d += squared(rgb[..., c].reshape(n, -1, 1), colours[:, None, :, c], part)
    if reach is not None:
        far = (np.abs(y - cy) > reach) | (np.abs(x - cx) > reach)
        far &= ~far.all(axis=2, keepdims=True)
        d[far] = np.inf
    return d.argmin(axis=2)


def _means(values: np.ndarray, label: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean (n, count, c) of values (n, p, c) by label (n, p), and how many there are of each."""
    n, _, c = values.shape
    index = (label + np.arange(n)[:, None] * count).ravel()
    size = np.bincount(index, minlength=n * count)
    sums = np.stack([np.bincount(index, values[..., k].ravel(), n * count) for k in range(c)], axis=1)
    return (sums / np.maximum(size, 1)[:, None]).reshape(n, count, c), size.reshape(n, count)


def joined(label: np.ndarray, least: float) -> np.ndarray:
    """Segments of regions (n, h, w) of labels: connected by sides, numbered by their first pixel; one of fewer than ``least`` pixels joins the segment before its
    first pixel (left of it, or above)."""
    n, h, w = label.shape
    own = np.broadcast_to(np.arange(h * w).reshape(1, h, w), label.shape).copy()
    later, sooner = slice(1, None), slice(None, -1)
    steps = [(np.s_[:, a], np.s_[:, b]) for a, b in ((later, sooner), (sooner, later))] + [(np.s_[:, :, a], np.s_[:, :, b]) for a, b in ((later, sooner), (sooner, later))]
    alike = [label[to] == label[of] for to, of in steps]
    while True:
        before = own.copy()
        for (to, of), same in zip(steps, alike):
            own[to] = np.where(same, np.minimum(own[to], own[of]), own[to])
        flat = own.reshape(n, -1)
        own = np.take_along_axis(flat, flat, axis=1).reshape(label.shape)
        if (own == before).all():
            break
    flat = own.reshape(n, -1)
    size = np.bincount((flat + np.arange(n)[:, None] * h * w).ravel(), minlength=n * h * w).reshape(n, -1)
    places = np.arange(h * w)
    beside = np.where(places % w > 0, places - 1, places - w)
    small = (size > 0) & (size < least) & (places[None] > 0)
    to = np.where(small, np.take_along_axis(flat, np.broadcast_to(np.maximum(beside, 0), flat.shape), axis=1), places[None])
    while True:  # each joins one whose first pixel comes earlier, so this ends
        further = np.take_along_axis(to, to, axis=1)
        if (further == to).all():
            return np.take_along_axis(to, flat, axis=1).reshape(label.shape)
        to = further


def segmented(rgb: np.ndarray, segments: int, rounds: int, compactness: float, sigma: float, window: float | None, least: float) -> np.ndarray:
    """Segment numbers (n, h, w) of regions (n, h, w, 3)."""
    n, h, w, _ = rgb.shape
    smooth, side = blurred(rgb.astype(float), sigma), spacing(h, w, segments)
    sy, sx = (v.ravel() for v in np.meshgrid(seeds(h, segments), seeds(w, segments), indexing="ij"))
    colours = smooth[:, sy, sx]
    places = np.broadcast_to(np.stack([sy, sx], axis=1).astype(float), (n, len(sy), 2))
    at = np.stack([v.ravel() for v in np.meshgrid(np.arange(h), np.arange(w), indexing="ij")], axis=1).astype(float)
    data = np.concatenate([smooth.reshape(n, -1, 3), np.broadcast_to(at, (n, h * w, 2))], axis=2)
    label = np.zeros((n, h * w), dtype=np.int64)
    for _ in range(rounds):
        label = assign(smooth, colours, places, (compactness / side) ** 2, None if window is None else window * side)
        mean, size = _means(data, label, len(sy))
        kept = (size > 0)[..., None]
        colours, places = np.where(kept, mean[..., :3], colours), np.where(kept, mean[..., 3:], places)
    label = label.reshape(n, h, w)
    return joined(label, least * h * w / segments) if least else label


def spread(rgb: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Of regions: the variance of their segments' mean colours, summed over channels."""
    n = len(rgb)
    mean, size = _means(rgb.reshape(n, -1, 3).astype(float), segment.reshape(n, -1), int(segment.max()) + 1)
    there = (size > 0)[..., None]
    count = there.sum(axis=1)
    middle = (mean * there).sum(axis=1) / count
    return ((((mean - middle[:, None]) * there) ** 2).sum(axis=1) / count).sum(axis=1)


def _arrays(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Regions of a row by shape: rows of pdf where each begins, its first pixel's place, colours (n, h, w, 3)."""
    pdf = pdf.sort_values(["k", "y", "x"])
    k = pdf["k"].to_numpy()
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    y, x, rgb = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf[["r_", "g", "b"]].to_numpy()
    last = np.r_[first[1:], len(k)] - 1
    shape = np.stack([y[last] - y[first] + 1, x[last] - x[first] + 1], axis=1)
    for h, w in np.unique(shape, axis=0).tolist():
        mine = np.flatnonzero((shape == (h, w)).all(axis=1))
        for low in range(0, len(mine), step := max(1, TOGETHER // (h * w * 40))):
            at = first[mine[low : low + step]]
            yield pdf.index.to_numpy()[at], np.stack([y[at], x[at]], axis=1), rgb[at[:, None] + np.arange(h * w)].reshape(-1, h, w, 3)


def tf_superpixel(cells: DataFrame, segments: int = 32, rounds: int = 10, compactness: float = 10.0, sigma: float = 0.0, window: float | None = None, least: float = 0.0) -> DataFrame:
    """1, or min(1, 3 / variance of the mean colours of a region's superpixels). As they are by default, superpixels are k-means clusters from seeds on a
    grid; with sigma the region is smoothed before, with window only centres within so many seed distances count, with least
    segments are connected, and those of less than such a part of an even share join a neighbour. SLIC has all three."""

    def row(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, _, rgb in _arrays(pdf):
            v = spread(rgb, segmented(rgb, segments, rounds, compactness, sigma, window, least))
            out.append(pdf.loc[rows, CELL].assign(t=np.where(v == 0, 1.0, np.minimum(1.0, 3 / np.where(v == 0, 1.0, v)))))
        return pd.concat(out)

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    return cells.select(*CELL, "y", "x", "r_", "g", "b").groupBy("image", "r", "i").applyInPandas(row, ", ".join(f"{c} {types[c]}" for c in CELL) + ", t double")


#: The superpixel estimator of the sweeps: smoothed, in windows of twice the seed distance, connected.
SLIC = {"sigma": 5.0, "window": 2.0, "least": 0.5}


def superpixel_rows(cells: DataFrame, segments: int = 32, rounds: int = 10, compactness: float = 10.0, sigma: float = 0.0, window: float | None = None, least: float = 0.0) -> DataFrame:
    """image, r, k, y, x, segment of every pixel: the segments that tf_superpixel takes means of. After one round without smoothing and joining, it is the
    number of the nearest seed."""

    def row(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, place, rgb in _arrays(pdf):
            n, h, w, _ = rgb.shape
            segment = segmented(rgb, segments, rounds, compactness, sigma, window, least)
            y, x = (place[:, c, None, None] + v for c, v in zip((0, 1), np.meshgrid(np.arange(h), np.arange(w), indexing="ij")))
            keys = pdf.loc[np.repeat(rows, h * w), ["image", "r", "k"]]
            out.append(keys.assign(y=y.ravel(), x=x.ravel(), segment=segment.ravel()))
        return pd.concat(out)

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    return cells.select(*CELL, "y", "x", "r_", "g", "b").groupBy("image", "r", "i").applyInPandas(row, f"image {types['image']}, r {types['r']}, k {types['k']}, y long, x long, segment long")
