"""Region grids over images, pixel-to-region assignment, and painting regions back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import div
from ..shared import small


def _geometry(shapes: DataFrame, sizes: Sequence[int], ov: int, keep: Sequence[str] = ()) -> DataFrame:
    """image, r, ov, rows, cols, and the crop's offsets, of each image at each region size (and columns to keep)."""
    rs = F.explode(F.array(*[F.lit(int(r)) for r in sizes])).alias("r")
    geo = shapes.select("image", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"), *keep, rs)
    fits = (F.col("r") > 0) & (F.col("r") <= F.col("h")) & (F.col("r") <= F.col("w"))
    checked = F.when(fits, F.col("r")).otherwise(F.raise_error(F.lit("a region must be larger than zero and no larger than its image")).cast("int"))
    return geo.withColumn("r", checked).select(
        "image", "r", F.lit(int(ov)).alias("ov"), "h", "w", *keep,
        (div(F.col("h"), F.col("r")) * ov).alias("rows"), (div(F.col("w"), F.col("r")) * ov).alias("cols"),
        div(F.col("h") % F.col("r"), 2).alias("ey"), div(F.col("w") % F.col("r"), 2).alias("ex"),
    )


def _corner(edge: str, index: str) -> Column:
    return div(F.col(edge) + F.col(index) * F.col("r"), F.col("ov"))


def grid(shapes: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """Cells of every image at every region size: image, r, ov, i, j, k (row-major), tly, tlx.

    Images that r doesn't divide are cropped evenly to whole regions. ov is the whole part of
    1/overlap: corners lie r/ov apart (0.5 gives 2), and the last ones may reach past the image."""
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cells = _geometry(shapes, sizes, ov).withColumn("i", to("rows")).withColumn("j", to("cols"))
    return cells.select("image", "r", "ov", "i", "j", (F.col("i") * F.col("cols") + F.col("j")).alias("k"), _corner("ey", "i").alias("tly"), _corner("ex", "j").alias("tlx"))


def _covering(at: str, edge: str, count: str, ov: int) -> Column:
    """Indices of the cells that may cover a pixel, along one axis."""
    if ov == 1:
        index = div(F.col(at) - F.col(edge), F.col("r"))
        return F.array(index)
    low = F.floor(((F.col(at) - F.col("r") + 1) * ov - F.col(edge)) / F.col("r"))
    high = F.floor(((F.col(at) + 1) * ov - F.col(edge)) / F.col("r"))
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.col(count) - 1)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def assign_cells(pixels: DataFrame, shapes: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """pixels with r, ov, i, j, k of each cell that covers them: one cell without overlap (pixels
    cropped away have none), several with it. Arithmetic only: shapes (a row an image, broadcast
    if its size allows) is the one thing joined, and where pixels have their image's sides (h, w) nothing is."""
    if {"h", "w"} <= set(pixels.columns):
        p = _geometry(pixels, sizes, ov, [c for c in pixels.columns if c not in ("image", "h", "w")])
    else:
        p = pixels.join(small(_geometry(shapes, sizes, ov)), "image")
    if ov == 1:
        p = p.where((F.col("y") >= F.col("ey")) & (F.col("y") < F.col("ey") + F.col("rows") * F.col("r")) & (F.col("x") >= F.col("ex")) & (F.col("x") < F.col("ex") + F.col("cols") * F.col("r")))
        p = p.withColumn("i", div(F.col("y") - F.col("ey"), F.col("r"))).withColumn("j", div(F.col("x") - F.col("ex"), F.col("r")))
    else:
        for at, edge, count, index in (("y", "ey", "rows", "i"), ("x", "ex", "cols", "j")):
            p = p.withColumn(index, F.explode(_covering(at, edge, count, ov)))
            p = p.where((_corner(edge, index) <= F.col(at)) & (F.col(at) < _corner(edge, index) + F.col("r")))
    return p.withColumn("k", F.col("i") * F.col("cols") + F.col("j")).drop("h", "w", "rows", "cols", "ey", "ex")


def paint_bands(matrix: DataFrame, shapes: DataFrame, sizes: Sequence[int], ov: int = 1, rows: int = 256) -> DataFrame:
    """image, r, h, w, top, rows, data (one channel): floor(255 t) of the last cell that covers a pixel, 1 where none does, as bytes of
    runs of an image's rows. Cells go to the bands they touch and are painted there in order; no pixel is a row."""
    geo = _geometry(shapes, sizes, ov)
    line = lambda c: F.floor(c / rows).cast("long")
    first, left = _corner("ey", "i"), _corner("ex", "j")
    cells = matrix.where("t is not null").select("image", F.col("r").cast("int").alias("r"), "i", "j", "k", F.floor(F.col("t") * 255).cast("int").alias("v")).join(small(geo), ["image", "r"])
    # an empty row for each band, so that bands without cells are there too
    spans = F.explode(F.sequence(F.lit(0).cast("long"), line(F.col("h") - 1))).alias("band")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    blank = geo.select("image", "r", "h", "w", spans, none("long", "k"), none("long", "y"), none("long", "x"), none("int", "v"))
    last = F.least(first + F.col("r"), F.col("h")) - 1
    marked = cells.select("image", "r", "h", "w", F.explode(F.sequence(line(first), line(last))).alias("band"), "k", first.alias("y"), left.alias("x"), "v")
    kind = shapes.schema["image"].dataType.simpleString()

    def draw(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, r, band = at
        h, w, top = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0]), int(band) * rows
        a = np.ones((min(rows, h - top), w), dtype=np.uint8)
        for y, x, v in pdf.dropna(subset="k").sort_values("k")[["y", "x", "v"]].astype(np.int64).itertuples(index=False):
            a[max(y - top, 0) : max(y + r - top, 0), x : x + r] = v
        return pd.DataFrame({"image": [image], "r": r, "h": h, "w": w, "top": top, "rows": len(a), "data": [a.tobytes()]})

    return marked.unionByName(blank).groupBy("image", "r", "band").applyInPandas(draw, f"image {kind}, r int, h long, w long, top long, rows long, data binary")


def paint(matrix: DataFrame, shapes: DataFrame, pixels: DataFrame | None, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """image, r, y, x, v: floor(255 t) of the last cell that covers a pixel; 1 where none does. pixels isn't needed (shapes tell
    which there are): bands are painted as bytes, and unpacked where they are."""
    kind = shapes.schema["image"].dataType.simpleString()

    def unpack(batches):
        for pdf in batches:
            for image, r, w, top, n, data in pdf[["image", "r", "w", "top", "rows", "data"]].itertuples(index=False):
                yield pd.DataFrame({"image": image, "r": r, "y": np.repeat(np.arange(top, top + n), w), "x": np.tile(np.arange(w), n), "v": np.frombuffer(data, dtype=np.uint8).astype(np.int64)})

    return paint_bands(matrix, shapes, sizes, ov).mapInPandas(unpack, f"image {kind}, r int, y long, x long, v long")
