"""Images as pixel rows."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import div
from ..shared import small

PIXELS = "image string, y long, x long, r long, g long, b long"
SIDES = ", h long, w long"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image (file name), h, w, channels, data (BGR bytes, row 0 first) of every readable image file."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(F.regexp_extract("image.origin", r"([^/]+)$", 1).alias("image"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def to_pixels(images: DataFrame, band_rows: int = 256, sides: bool = False) -> DataFrame:
    """One row a pixel (sides: with the image's h and w). A large image is cut into bands of rows inside its own task, so that no
    batch of pixels exceeds a band; no shuffle."""
    key = images.schema["image"].dataType.simpleString()

    def pixels(batches):
        for pdf in batches:
            for image, h, w, channels, data in pdf[["image", "h", "w", "channels", "data"]].itertuples(index=False):
                a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels)
                for top in range(0, h, band_rows):
                    part = a[top : top + band_rows].astype(np.int64)
                    b, g, r = (part[..., min(c, channels - 1)].ravel() for c in range(3))
                    yield pd.DataFrame({"image": image, "y": np.repeat(np.arange(top, top + len(part)), w), "x": np.tile(np.arange(w), len(part)), "r": r, "g": g, "b": b} | ({"h": h, "w": w} if sides else {}))

    return images.mapInPandas(pixels, PIXELS.replace("image string", f"image {key}") + SIDES * sides)


#: Pixels of a band, about.
BAND = 1 << 20


def to_bands(images: DataFrame, pixels: int = BAND) -> DataFrame:
    """Images as runs of their rows: image, h, w, top, rows, data (three channels, BGR, or one). Bands are cut where an image's bytes are: no shuffle."""
    key = images.schema["image"].dataType.simpleString()

    def cut(batches):
        for pdf in batches:
            for image, h, w, channels, data in pdf[["image", "h", "w", "channels", "data"]].itertuples(index=False):
                a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels)
                a = a[..., :3] if channels >= 3 else a[..., :1]
                step = max(1, pixels // w)
                for top in range(0, h, step):
                    part = a[top : top + step]
                    yield pd.DataFrame({"image": [image], "h": h, "w": w, "top": top, "rows": len(part), "data": [part.tobytes()]})

    return images.mapInPandas(cut, f"image {key}, h long, w long, top long, rows long, data binary")


def pack_bands(pixels: DataFrame, shapes: DataFrame | tuple[int, int], channels: tuple[str, ...] = ("b", "g", "r"), rows: int = 256) -> DataFrame:
    """Bands, as to_bands gives them, from pixel rows (every pixel of an image once): the one time that pixels are shuffled, by band and not by image. shapes:
    image, h, w, or the height and width that all images have."""
    value = lambda p: F.concat(*[F.lpad(F.hex(p[c].cast("long")), 2, "0") for c in channels])
    line = F.floor(F.col("y") / rows).cast("long")
    packed = pixels.groupBy("image", line.alias("band")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", *channels))), value), "")).alias("data"), (F.max("y") - F.min("y") + 1).alias("rows"))
    if isinstance(shapes, tuple):
        sized = packed.withColumns({c: F.lit(n).cast("long") for c, n in zip("hw", shapes)})
    else:
        sized = packed.join(small(shapes.select("image", F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"))), "image")
    whole = F.octet_length("data") == F.col("rows") * F.col("w") * len(channels)
    data = F.when(whole, F.col("data")).otherwise(F.raise_error(F.lit("an image lacks pixels, or has some twice")).cast("binary"))
    return sized.select("image", "h", "w", (F.col("band") * rows).alias("top"), F.col("rows").cast("long").alias("rows"), data.alias("data"))


def band_pixels(bands: DataFrame, sides: bool = False) -> DataFrame:
    """Pixel rows (image, y, x, r, g, b; sides: with the image's h and w) of bands."""
    key = bands.schema["image"].dataType.simpleString()

    def pixels(batches):
        for pdf in batches:
            for image, h, w, top, rows, data in pdf[["image", "h", "w", "top", "rows", "data"]].itertuples(index=False):
                b, g, r = (np.frombuffer(data, dtype=np.uint8).reshape(rows * w, -1)[:, [0, 1, 2] if len(data) > rows * w else [0, 0, 0]]).T.astype(np.int64)
                yield pd.DataFrame({"image": image, "y": np.repeat(np.arange(top, top + rows), w), "x": np.tile(np.arange(w), rows), "r": r, "g": g, "b": b} | ({"h": h, "w": w} if sides else {}))

    return bands.mapInPandas(pixels, PIXELS.replace("image string", f"image {key}") + SIDES * sides)


def from_bands(bands: DataFrame, *more: str) -> DataFrame:
    """Images (as read_images gives them) of bands: an image's bytes come together only here. more: columns that tell images of one name apart; they
    become part of it, after a dash."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("top", F.hex("data").alias("hex")))), lambda x: x["hex"])
    name = F.concat_ws("-", F.col("image").cast("string"), *(F.col(c).cast("string") for c in more)).alias("image") if more else F.col("image")
    whole = bands.groupBy(name, "h", "w").agg(F.unhex(F.array_join(line, "")).alias("data"))
    return whole.select("image", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), div(F.octet_length("data"), F.col("h") * F.col("w")).cast("int").alias("channels"), "data")


def from_pixels(pixels: DataFrame) -> DataFrame:
    """Images (as read_images gives them) from pixel rows: lines are packed first, then joined in order."""
    value = lambda p: F.concat(*[F.lpad(F.hex(p[c]), 2, "0") for c in "bgr"])
    rows = pixels.groupBy("image", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "b", "g", "r"))), value).alias("px"))
    rows = rows.select("image", "y", F.size("px").alias("w"), F.array_join("px", "").alias("row"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("y", "row"))), lambda x: x["row"])
    return rows.groupBy("image").agg(F.count(F.lit(1)).cast("int").alias("h"), F.max("w").alias("w"), F.lit(3).alias("channels"), F.unhex(F.array_join(line, "")).alias("data"))


def bitmap(a: np.ndarray) -> bytes:
    """An uncompressed bitmap file of an image (h, w, 3: BGR): header, then rows from the last up, each filled to four bytes."""
    h, w = a.shape[:2]
    rows = b"".join(line.tobytes() + b"\0" * (-3 * w % 4) for line in a[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """A bitmap file of each image (as read_images gives them; one channel becomes three) in a folder that all executors reach; gives
    the names. A task that runs again writes the same file again."""

    def write(batches):
        for pdf in batches:
            fs, path = FileSystem.from_uri(folder)
            fs.create_dir(path, recursive=True)
            names = []
            for image, h, w, data in pdf[["image", "h", "w", "data"]].itertuples(index=False):
                names.append(f"{image}.bmp")
                a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, -1)
                with fs.open_output_stream(f"{path}/{names[-1]}") as out:
                    out.write(bitmap(np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[..., :3]))
            yield pd.DataFrame({"file": names})

    return images.mapInPandas(write, "file string")


def select_images(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names that are both present and wanted, sorted; an empty wish means all."""
    picked = names.select("image").distinct()
    return (picked.join(wanted.select("image").distinct(), "image", "left_semi") if wanted.limit(1).count() else picked).orderBy("image")


def shapes(pixels: DataFrame) -> DataFrame:
    """image, h, w from pixel rows."""
    return pixels.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
