"""Traversability of regions: estimators, normalisation, equalisation, scales, ground truth."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binarize, capped_inverse, div, gray, variance_terms
from ..shared import shuffled, small
from ..sources.images import band_pixels, from_pixels, pack_bands, to_bands
from .grid import _geometry, assign_cells, grid
from .integral import CELL, least_means, region_sums
from .stencil import smooth_bands
from .superpixels import SLIC, tf_superpixel

SCALES = (6, 8, 10, 12, 14, 16, 18, 20, 22, 24)


def sums(cells: DataFrame) -> DataFrame:
    """Integer sums of each cell's grey and colours: one shuffle, combined map-side, serves every
    dispersion estimator and region size at once."""
    g = cells.withColumn("gray", gray(F.col("r_"), F.col("g"), F.col("b")))
    terms = [F.count(F.lit(1)).alias("n")]
    for c in ("gray", "r_", "g", "b"):
        terms += [F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}")]
    return g.groupBy(*CELL).agg(*terms)


def regions(pixels: DataFrame, shapes: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """Pixels in cells; the red channel is r_ (r is the region size)."""
    return assign_cells(pixels.withColumnRenamed("r", "r_"), shapes, sizes, ov)


def _var(c: str) -> Column:
    return variance_terms(F.col("n"), F.col(f"s_{c}"), F.col(f"ss_{c}"))


def tf_gray(cell_sums: DataFrame) -> DataFrame:
    """1 for a flat region, else min(1, 1 / standard deviation of grey)."""
    return cell_sums.select(*CELL, capped_inverse(F.sqrt(_var("gray")) / F.col("n"), 1.0).alias("t"))


def tf_rgb(cell_sums: DataFrame) -> DataFrame:
    """1 for a flat region, else min(1, 3 / sum of the channels' variances)."""
    n2 = (F.col("n") * F.col("n")).cast("double")
    return cell_sums.select(*CELL, capped_inverse((_var("r_") + _var("g") + _var("b")) / n2, 3.0).alias("t"))


def tf_random(cells: DataFrame, seed: int = 0) -> DataFrame:
    """0 to 1 (excluded) by a digest of the seed and the cell, so that a rerun gives the same values however rows are dealt out."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("image").cast("string"), F.col("r").cast("string"), F.col("k").cast("string")))
    return cells.select(*CELL).distinct().select(*CELL, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("t"))


def label_bands(labels: DataFrame, shapes: DataFrame) -> DataFrame:
    """labels as bands: as they are, from images (their grey counts), or from rows (image, y, x, lab)."""
    if "rows" in labels.columns:
        return labels
    return to_bands(labels) if "data" in labels.columns else pack_bands(labels, shapes, ("lab",))


def tf_label(labels: DataFrame, shapes: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """The least mean label of a region's sub-blocks, whose side is half the region's height
    (cropped evenly, as in the grid). Regions too small for a sub-block get null."""
    return least_means(label_bands(labels, shapes), sizes, ov)


def estimate(cells: DataFrame, tf: Callable[[pd.Series, pd.Series, pd.Series], float] | Callable[..., Column], series: bool | None = None) -> DataFrame:
    """A caller's own estimator: a function of three pandas Series (a region's channels) to a float,
    or of three columns to an aggregate Column (preferred: it stays in the JVM). series tells which; without it that shows when it is given
    columns: a function of Series stumbles over their type. Its own errors come up when it runs, and with series=False at once."""
    channels, value = [F.col(c) for c in ("r_", "g", "b")], None
    if not series:
        try:
            value = tf(*channels)
        except (TypeError, ValueError, AttributeError):
            if series is False:
                raise
    if series is False and not isinstance(value, Column):
        raise TypeError("the estimator gave no Column")
    if not isinstance(value, Column):
        def apply(r: pd.Series, g: pd.Series, b: pd.Series) -> float:
            return float(tf(r, g, b))

        value = F.pandas_udf(apply, "double")(*channels)
    return cells.groupBy(*CELL).agg(value.cast("double").alias("t"))


def normalize_max(matrix: DataFrame) -> DataFrame:
    """t over its maximum in the image (null if that is 0)."""
    return matrix.withColumn("t", F.col("t") / F.nullif(F.max("t").over(Window.partitionBy("image", "r")), F.lit(0.0)))


def resize_bilinear(matrix: DataFrame, target: DataFrame) -> DataFrame:
    """matrix (image, r, i, j, t) resampled to target (image, rows, cols), four taps a cell,
    edges repeated, no smoothing first: image, r, i, j, t."""
    size = matrix.groupBy("image", "r").agg((F.max("i") + 1).alias("src_rows"), (F.max("j") + 1).alias("src_cols"))
    both = size.join(shuffled(target.select("image", "rows", "cols")), "image")
    for n, index in (("rows", "i"), ("cols", "j")):
        both = both.withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
        at = (F.col(index) + 0.5) * (F.col(f"src_{n}").cast("double") / F.col(n)) - 0.5
        low = F.floor(at)
        clip = lambda v, n=n: F.greatest(F.lit(0).cast("long"), F.least(v, F.col(f"src_{n}") - 1))
        both = both.withColumn(f"tap_{index}", F.explode(F.array(F.struct(clip(low).alias("at"), (1 - (at - low)).alias("weight")), F.struct(clip(low + 1).alias("at"), (at - low).alias("weight")))))
    taps = both.select("image", "r", "i", "j", F.col("tap_i.at").alias("si"), F.col("tap_j.at").alias("sj"), (F.col("tap_i.weight") * F.col("tap_j.weight")).alias("weight"))
    source = matrix.select("image", "r", F.col("i").alias("si"), F.col("j").alias("sj"), "t")
    return taps.join(shuffled(source), ["image", "r", "si", "sj"]).groupBy("image", "r", "i", "j").agg(F.sum(F.col("weight") * F.col("t")).alias("t"))


def clahe(matrix: DataFrame, clip: float = 3.0, tiles: int = 3, scale: str = "unit") -> DataFrame:
    """Contrast-limited adaptive equalisation of floor(255 t) over tiles x tiles tiles of each matrix.

    A matrix that the tiles don't divide is padded at its bottom and right by mirroring, both
    sides then; histograms are clipped, the excess spread evenly and its rest at even steps; a
    cell blends the tables of the four nearest tiles. scale: "unit" gives 0 to 1, "u8" 0 to 255.
    """
    key = ["image", "r"]
    size = matrix.groupBy(*key).agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))
    even = (F.col("rows") % tiles == 0) & (F.col("cols") % tiles == 0)
    pad = lambda n: F.when(even, F.lit(0)).otherwise(tiles - F.col(n) % tiles)
    size = size.withColumn("pr", pad("rows")).withColumn("pc", pad("cols"))
    size = size.select(*key, "rows", "cols", "pr", "pc", div(F.col("rows") + F.col("pr"), tiles).alias("th"), div(F.col("cols") + F.col("pc"), tiles).alias("tw"))
    cells = matrix.select(*key, "i", "j", "k", F.floor(F.col("t") * 255).cast("long").alias("v")).join(shuffled(size), key)

    def mirrored(index: str, n: str, p: str) -> Column:
        # a cell at n-2-m is also met at n+m
        again = 2 * F.col(n) - 2 - F.col(index)
        return F.explode(F.when((again >= F.col(n)) & (again < F.col(n) + F.col(p)), F.array(F.col(index), again)).otherwise(F.array(F.col(index))))

    padded = cells.withColumn("pi", mirrored("i", "rows", "pr")).withColumn("pj", mirrored("j", "cols", "pc"))
    bins = padded.groupBy(*key, div(F.col("pi"), F.col("th")).alias("ty"), div(F.col("pj"), F.col("tw")).alias("tx"), "v", "th", "tw").agg(F.count(F.lit(1)).alias("n"))
    area = F.col("th") * F.col("tw")
    limit = F.greatest(F.lit(1).cast("long"), F.floor(clip * area / 256).cast("long"))
    tile = Window.partitionBy(*key, "ty", "tx")
    # a table needs only the values that occur in its matrix: how much redistribution lies below a value is arithmetic
    bins = bins.withColumn("limit", limit).withColumn("over", F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0))).over(tile))
    clipped = bins.select(*key, "ty", "tx", "v", F.least("n", "limit").alias("n"), "over", area.alias("area"))
    tables = clipped.select(*key, "ty", "tx", "over", "area").distinct().join(shuffled(cells.select(*key, "v").distinct()), key)
    below = clipped.select(*key, "ty", "tx", F.col("v").alias("u"), "n")
    rest = F.col("over") % 256
    step = F.greatest(div(F.lit(256), F.nullif(rest, F.lit(0).cast("long"))), F.lit(1).cast("long"))
    spread = (F.col("v") + 1) * div(F.col("over"), 256) + F.when(rest > 0, F.least(rest, div(F.col("v"), step) + 1)).otherwise(0)
    # per tile and value: clipped counts at or below it, by a running sum over the union of both
    marks = below.select(*key, "ty", "tx", F.col("u").alias("v"), "n", F.lit(0).alias("asked"), F.lit(None).cast("long").alias("over"), F.lit(None).cast("long").alias("area")).unionByName(
        tables.select(*key, "ty", "tx", "v", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked"), "over", "area")
    )
    running = marks.withColumn("cum", F.sum("n").over(tile.orderBy("v").rangeBetween(Window.unboundedPreceding, 0))).where("asked = 1")
    lut = running.select(*key, "ty", "tx", "v", F.least(F.lit(255), F.bround((F.col("cum") + spread) * (F.lit(255.0) / F.col("area")))).cast("double").alias("out"))
    for index, n, side in (("i", "th", "y"), ("j", "tw", "x")):
        at = F.col(index) / F.col(n).cast("double") - 0.5
        low = F.floor(at)
        clipped_ = lambda v: F.greatest(F.lit(0).cast("long"), F.least(v, F.lit(tiles - 1).cast("long")))
        cells = cells.withColumn(f"tap_{side}", F.explode(F.array(F.struct(clipped_(low).alias("at"), (1 - (at - low)).alias("weight")), F.struct(clipped_(low + 1).alias("at"), (at - low).alias("weight")))))
    taps = cells.select(*key, "i", "j", "k", "v", F.col("tap_y.at").alias("ty"), F.col("tap_x.at").alias("tx"), (F.col("tap_y.weight") * F.col("tap_x.weight")).alias("weight"))
    # blends are rounded at six places first, so that the order of the four terms can't tip a half
    blended = taps.join(shuffled(lut), [*key, "ty", "tx", "v"]).groupBy(*key, "i", "j", "k").agg(F.bround(F.round(F.sum(F.col("weight") * F.col("out")), 6)).alias("t"))
    return blended if scale == "u8" else blended.withColumn("t", F.col("t") / 255)


ESTIMATORS = {"tf_grayhist": tf_gray, "tf_rgbhist": tf_rgb}


def image_bands(pixels: DataFrame, shapes: DataFrame, smooth: bool, images: DataFrame | None = None) -> DataFrame:
    """Bands of the images as read, if they are given, else packed from the pixel rows; smoothed or as they are."""
    if smooth:
        return smooth_bands(from_pixels(pixels) if images is None else images)
    return pack_bands(pixels, shapes) if images is None else to_bands(images)


def estimates(bands: DataFrame, shapes: DataFrame, sizes: Sequence[int], tf: str = "tf_grayhist", ov: int = 1) -> DataFrame:
    """image, r, i, j, k, t of a named estimator over all region sizes, before any division."""
    if tf in ESTIMATORS:
        return ESTIMATORS[tf](region_sums(bands, sizes, ov))
    if tf == "tf_random":
        return tf_random(grid(shapes, sizes, ov))
    if tf == "tf_superpixels":
        return tf_superpixel(regions(band_pixels(bands, sides=True), shapes, sizes, ov), **SLIC)
    raise ValueError(f"no estimator named {tf}: {[*ESTIMATORS, 'tf_random', 'tf_superpixels']}")


def traversability(pixels: DataFrame, shapes: DataFrame, sizes: Sequence[int], tf: str = "tf_grayhist", ov: int = 1, smooth: bool = True, threshold: float | None = None, normalize: bool = True, scale: str = "unit", images: DataFrame | None = None) -> DataFrame:
    """image, r, i, j, k, t: smoothing, grid, estimator, division by the maximum, optional binary
    threshold, optional equalisation. images: the same images as read, from which sums are taken without a row a pixel."""
    matrix = estimates(image_bands(pixels, shapes, smooth, images), shapes, sizes, tf, ov)
    return _finish(normalize_max(matrix), threshold, normalize, scale)


def _finish(matrix: DataFrame, threshold: float | None, normalize: bool, scale: str) -> DataFrame:
    if threshold is not None:
        matrix = matrix.withColumn("t", binarize(F.col("t"), threshold))
    if normalize:
        matrix = clahe(matrix, scale=scale)
    return matrix


def scales_of(sizes: Sequence[int], scales: Sequence[int] | None = None) -> list[int]:
    """The scales that sizes are blended from: those given, else SCALES and, where sizes lie below all of these, such sizes too.
    Every size must be one of them, as its grid is the one that graphs and points are on."""
    used = sorted(set(scales) if scales is not None else {*SCALES, *(s for s in sizes if s < min(SCALES))})
    if missing := [s for s in sizes if s not in used]:
        raise ValueError(f"region sizes {missing} are not among the scales {used}")
    return used


def blended(one: DataFrame, shapes: DataFrame, top: int, ov: int = 1, threshold: float | None = None, normalize: bool = True) -> DataFrame:
    """one (matrices of scales, each over its own maximum) up to the scale ``top``: this one as it is, smaller ones resized to it
    and weighted by their size, then over the maximum."""
    target = _geometry(shapes, [top], ov).select("image", "rows", "cols")
    resized = resize_bilinear(one.where(F.col("r") < top), target)
    parts = one.where(F.col("r") == top).select("image", "i", "j", "t").unionByName(resized.select("image", "i", "j", (F.col("r") * F.col("t")).alias("t")))
    # rounded at 12 places: the order of the sum mustn't show in a later threshold
    total = parts.groupBy("image", "i", "j").agg(F.round(F.sum("t"), 12).alias("t")).join(small(target), "image")
    matrix = total.select("image", F.lit(top).alias("r"), "i", "j", (F.col("i") * F.col("cols") + F.col("j")).alias("k"), "t")
    return _finish(normalize_max(matrix), threshold, normalize, "unit")


def traversability_multiscale(pixels: DataFrame, shapes: DataFrame, size: int, tf: str = "tf_grayhist", ov: int = 1, smooth: bool = True, scales: Sequence[int] = SCALES, threshold: float | None = None, normalize: bool = True, images: DataFrame | None = None) -> DataFrame:
    """The matrices of all scales up to ``size``: the largest as it is, smaller ones resized to it
    and weighted by their size, then over the maximum. r is the largest scale."""
    used = sorted(s for s in scales if s <= size)
    if not used:
        raise ValueError(f"no scale of {sorted(scales)} is as small as the region size {size}")
    one = traversability(pixels, shapes, used, tf, ov, smooth, None, False, images=images)
    return blended(one, shapes, used[-1], ov, threshold, normalize)


def ground_truth(labels: DataFrame, shapes: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """image, r, i, j, k, t: the label estimator over its maximum."""
    return normalize_max(tf_label(labels, shapes, sizes, ov))


def matrix_histogram(matrix: DataFrame) -> DataFrame:
    """image, r, bin (0 to 9; 1 belongs to the last), frequency of t in tenths."""
    binned = matrix.where("t is not null").groupBy("image", "r", F.least(F.floor(F.col("t") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return binned.select("image", "r", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("image", "r"))).alias("frequency"))
