"""Sums over regions from summed-area tables, made where an image's bytes are.

Bands (image, h, w, top, rows, data: see sources.images) come in; each gets one exact integer table, from which the sums of every region
size and overlap are read as four corners a region. What leaves a task are sums of regions, no pixels; a region that
crosses bands has a row in each, and these add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["image", "r", "i", "j", "k"]
TERMS = [f"{kind}_{c}" for c in ("gray", "r_", "g", "b") for kind in ("s", "ss")]
#: Rows that a task gathers before it passes them on.
GATHERED = 100_000


def table(a: np.ndarray) -> np.ndarray:
    """The summed-area table of (rows, columns): a row and a column larger, zeros first."""
    out = np.zeros((a.shape[0] + 1, a.shape[1] + 1), dtype=np.int64)
    np.cumsum(np.cumsum(a, axis=0, dtype=np.int64), axis=1, out=out[1:, 1:])
    return out


def read(s: np.ndarray, y1: np.ndarray, y2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Sums of all rectangles [y1, y2) x [x1, x2): a row for each y1, a column for each x1."""
    down = s[y2] - s[y1]
    return down[:, x2] - down[:, x1]


def axis(n: int, r: int, ov: int) -> tuple[np.ndarray, np.ndarray]:
    """First pixel and end of each region along one side of n pixels, as operators.grid has them."""
    if not 0 < r <= n:
        raise ValueError("a region must be larger than zero and no larger than its image")
    first = ((n % r) // 2 + np.arange(n // r * ov) * r) // ov
    return first, np.minimum(first + r, n)


def gray_of(a: np.ndarray) -> np.ndarray:
    """functions.gray of BGR pixels."""
    b, g, r = (a[..., c].astype(np.int64) for c in range(3))
    return (3735 * r + 19235 * g + 9798 * b + 16384) // 32768


def over_bands(bands: DataFrame, sums: Callable[[np.ndarray, int, int, int], Iterator[dict[str, np.ndarray]]], names: list[str]) -> DataFrame:
    """image and the columns of sums(pixels of a band, its top, h, w) of every band; they are whole numbers, r among them."""

    def task(batches):
        held, gathered = [], 0
        for batch in batches:
            images = batch.column(0)
            for n, (h, w, top, rows, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)))):
                for part in sums(np.frombuffer(data, dtype=np.uint8).reshape(rows, w, -1), top, h, w):
                    size = len(part["k"])
                    columns = [images.take(pa.array(np.full(size, n))), *(pa.array(np.asarray(part[c], dtype=np.int64)) for c in names)]
                    held.append(pa.RecordBatch.from_arrays(columns, names=["image", *names]))
                    gathered += size
                    if gathered >= GATHERED:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held, gathered = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    kind = bands.schema["image"].dataType.simpleString()
    found = bands.select("image", "h", "w", "top", "rows", "data").mapInArrow(task, f"image {kind}, " + ", ".join(f"{c} long" for c in names))
    return found.withColumn("r", F.col("r").cast("int"))


def region_sums(bands: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """image, r, i, j, k, n and integer sums of grey, red, green and blue and of their squares, of every region of every size."""
    sizes = [int(r) for r in sizes]

    def sums(a, top, h, w):
        shape = []
        for r in sizes:
            (y1, y2), (x1, x2) = axis(h, r, ov), axis(w, r, ov)
            i = np.flatnonzero((y1 < top + len(a)) & (y2 > top))
            shape.append((r, i, len(x1), np.maximum(y1[i] - top, 0), np.minimum(y2[i] - top, len(a)), x1, x2))
        found = [{"r": np.full(len(i) * cols, r), "i": np.repeat(i, cols), "j": np.tile(np.arange(cols), len(i)), "k": (i[:, None] * cols + np.arange(cols)).ravel(), "n": ((y2 - y1)[:, None] * (x2 - x1)).ravel()} for r, i, cols, y1, y2, x1, x2 in shape]
        for c, values in zip(("gray", "r_", "g", "b"), (gray_of(a), *(a[..., k].astype(np.int64) for k in (2, 1, 0)))):
            for kind, of in (("s", values), ("ss", values * values)):
                s = table(of)
                for part, (_, _, _, y1, y2, x1, x2) in zip(found, shape):
                    part[f"{kind}_{c}"] = read(s, y1, y2, x1, x2).ravel()
        return found

    parts = over_bands(bands, sums, ["r", "i", "j", "k", "n", *TERMS])
    return parts.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in ["n", *TERMS]))


def least_means(bands: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """image, r, i, j, k, t: the least mean of a region's sub-blocks in bands of one channel, or of the grey of three. A sub-block's side is half the region's height;
    they are cropped evenly, as regions are in an image. Regions too small for one get null."""
    sizes = [int(r) for r in sizes]

    def split(n: np.ndarray, first: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Which region each sub-block is of, and where it begins."""
        count = n // q
        of = np.repeat(np.arange(len(n)), count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        return of, first[of] + (n[of] % q) // 2 + within * q

    def sums(a, top, h, w):
        s, bottom = table(a[..., 0] if a.shape[2] == 1 else gray_of(a)), top + len(a)
        for r in sizes:
            (y1, y2), (x1, x2) = axis(h, r, ov), axis(w, r, ov)
            cols, known, rows = len(x1), {}, []
            for i in np.flatnonzero((y1 < bottom) & (y2 > top)).tolist():
                q = int(y2[i] - y1[i]) // 2
                if q not in known:
                    known[q] = split(x2 - x1, x1, q) if q else (np.empty(0, dtype=np.int64),) * 2
                of, left = known[q]
                none = np.setdiff1d(np.arange(cols), of)
                rows.append((i, none, -1, 0, np.zeros(len(none), dtype=np.int64)))
                if not len(of):
                    continue
                low = split(y2[i : i + 1] - y1[i : i + 1], y1[i : i + 1], q)[1]
                held = low[(low < bottom) & (low + q > top)]
                got = read(s, np.maximum(held - top, 0), np.minimum(held + q - top, len(a)), left, left + q)
                if low[0] >= top and low[-1] + q <= bottom:  # whole in this band: all sub-blocks have q * q pixels
                    met = np.unique(of, return_index=True)
                    rows.append((i, met[0], -1, q * q, np.minimum.reduceat(got.min(axis=0), met[1])))
                    continue
                for n, y in enumerate(held.tolist()):
                    inside = min(y + q, bottom) - max(y, top)
                    rows.append((i, of, y * (w + 1) + left, inside * q, got[n]))
            if not rows:  # a band of the image's cropped border
                continue
            sizes_ = [len(j) for _, j, *_ in rows]
            i, j = np.repeat([x[0] for x in rows], sizes_), np.concatenate([x[1] for x in rows])
            sub, n = np.concatenate([np.broadcast_to(x[2], len(x[1])) for x in rows]), np.repeat([x[3] for x in rows], sizes_)
            yield {"r": np.full(len(j), r), "i": i, "j": j, "k": i * cols + j, "sub": sub, "n": n, "s": np.concatenate([x[4] for x in rows])}

    parts = over_bands(bands, sums, ["r", "i", "j", "k", "sub", "n", "s"])
    means = parts.groupBy(*CELL, "sub").agg((F.sum("s").cast("double") / F.nullif(F.sum("n"), F.lit(0).cast("long"))).alias("mean"))
    return means.groupBy(*CELL).agg(F.min("mean").alias("t"))
