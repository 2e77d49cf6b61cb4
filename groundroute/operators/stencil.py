"""Edge-preserving smoothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.images import from_pixels


def disc(diameter: int) -> list[tuple[int, int, int]]:
    """Offsets and squared distances of the taps within the radius."""
    n = diameter // 2
    return [(dy, dx, dy * dy + dx * dx) for dy in range(-n, n + 1) for dx in range(-n, n + 1) if dy * dy + dx * dx <= n * n]


def smooth_block(block: np.ndarray, halo: int, diameter: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    """block: (h, w, 3) with a halo on every side; the smoothed inside."""
    h, w = block.shape[0] - 2 * halo, block.shape[1] - 2 * halo
    centre = block[halo : halo + h, halo : halo + w]
    total, weight = np.zeros((h, w, 3)), np.zeros((h, w))
    for dy, dx, d2 in disc(diameter):
        near = block[halo + dy : halo + dy + h, halo + dx : halo + dx + w]
        apart = np.abs(near - centre).sum(axis=2)
        k = np.exp(-d2 / (2 * sigma_space**2)) * np.exp(-(apart**2) / (2 * sigma_color**2))
        total += near * k[..., None]
        weight += k
    return np.rint(total / weight[..., None]).astype(np.int64)


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places on a line of n, mirrored at its ends without repeating them."""
    if n == 1:
        return np.zeros_like(at)
    m = np.mod(at, 2 * n - 2)
    return np.where(m < n, m, 2 * n - 2 - m)


def _smoothed(data: bytes, h: int, w: int, channels: int, diameter: int, sigma_color: float, sigma_space: float, block: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(top, left, smoothed RGB) of the blocks of one image, row by row of blocks."""
    halo = diameter // 2
    a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels)[..., [min(c, channels - 1) for c in (2, 1, 0)]]
    for top in range(0, h, block):
        ys = np.arange(top - halo, min(top + block, h) + halo)
        for left in range(0, w, block):
            xs = np.arange(left - halo, min(left + block, w) + halo)
            part = a[mirrored(ys, h)][:, mirrored(xs, w)].astype(float)
            yield top, left, smooth_block(part, halo, diameter, sigma_color, sigma_space)


def bilateral_images(images: DataFrame, diameter: int = 15, sigma_color: float = 75.0, sigma_space: float = 75.0, block: int = 256) -> DataFrame:
    """image, y, x, r, g, b of images (image, h, w, channels, data: BGR bytes) smoothed by distance and by colour difference (sum over
    channels), the image mirrored at its borders without repeating the border pixel, results rounded.

    Blocks with their halo are cut where the image's bytes are: no pixel is shuffled, and a batch of rows is one block."""
    key = images.schema["image"].dataType.simpleString()

    def smooth(batches):
        for pdf in batches:
            for image, h, w, channels, data in pdf[["image", "h", "w", "channels", "data"]].itertuples(index=False):
                for top, left, out in _smoothed(data, h, w, channels, diameter, sigma_color, sigma_space, block):
                    yy, xx = np.meshgrid(np.arange(top, top + out.shape[0]), np.arange(left, left + out.shape[1]), indexing="ij")
                    yield pd.DataFrame({"image": image, "y": yy.ravel(), "x": xx.ravel(), "r": out[..., 0].ravel(), "g": out[..., 1].ravel(), "b": out[..., 2].ravel()})

    return images.mapInPandas(smooth, f"image {key}, y long, x long, r long, g long, b long")


def smooth_bands(images: DataFrame, diameter: int = 15, sigma_color: float = 75.0, sigma_space: float = 75.0, block: int = 256) -> DataFrame:
    """Bands (as sources.images.to_bands gives them) of the images smoothed as bilateral_images does: bytes in, bytes out."""
    key = images.schema["image"].dataType.simpleString()

    def smooth(batches):
        for pdf in batches:
            for image, h, w, channels, data in pdf[["image", "h", "w", "channels", "data"]].itertuples(index=False):
                parts = _smoothed(data, h, w, channels, diameter, sigma_color, sigma_space, block)
                for top in range(0, h, block):
                    band = np.concatenate([next(parts)[2] for _ in range(0, w, block)], axis=1)[..., ::-1].astype(np.uint8)
                    yield pd.DataFrame({"image": [image], "h": h, "w": w, "top": top, "rows": len(band), "data": [band.tobytes()]})

    return images.mapInPandas(smooth, f"image {key}, h long, w long, top long, rows long, data binary")


def bilateral(pixels: DataFrame, shapes: DataFrame | None = None, diameter: int = 15, sigma_color: float = 75.0, sigma_space: float = 75.0, block: int = 256) -> DataFrame:
    """bilateral_images over images that are there as pixel rows: packed by line, then by image, first (shapes isn't needed)."""
    return bilateral_images(from_pixels(pixels), diameter, sigma_color, sigma_space, block)
