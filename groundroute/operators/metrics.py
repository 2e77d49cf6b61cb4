"""Route scores and error measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div
from ..shared import shuffled, small, written
from .routes import PATH

PENALTY, PASSABLE = 0.03, 0.5


#: Side of a label tile.
SIDE = 256
#: Label values that a task looks at together.
TOGETHER = 1 << 22


def label_tiles(labels: DataFrame, side: int = SIDE) -> DataFrame:
    """image, ty, tx, rows, data: the bytes of square tiles of label images (image, h, w, channels, data: the first channel; cut where the
    bytes are) or of label rows (image, y, x, lab: shuffled by tile, the one time that pixels are)."""
    if "data" in labels.columns:
        key = labels.schema["image"].dataType.simpleString()

        def cut(batches):
            for pdf in batches:
                for image, h, w, channels, data in pdf[["image", "h", "w", "channels", "data"]].itertuples(index=False):
                    a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels)[..., 0]
                    for top in range(0, h, side):
                        parts = [(left // side, a[top : top + side, left : left + side]) for left in range(0, w, side)]
                        yield pd.DataFrame({"image": image, "ty": top // side, "tx": [x for x, _ in parts], "rows": [len(p) for _, p in parts], "data": [p.tobytes() for _, p in parts]})

        return labels.mapInPandas(cut, f"image {key}, ty long, tx long, rows long, data binary")
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    values = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "lab"))), lambda p: F.lpad(F.hex(p["lab"].cast("long")), 2, "0"))
    rows, cols = (F.max(c) - F.min(c) + 1 for c in "yx")
    packed = labels.groupBy("image", at("y").alias("ty"), at("x").alias("tx")).agg(rows.cast("long").alias("rows"), cols.alias("cols"), F.unhex(F.array_join(values, "")).alias("data"))
    whole = F.octet_length("data") == F.col("rows") * F.col("cols")
    return packed.select("image", "ty", "tx", "rows", F.when(whole, F.col("data")).otherwise(F.raise_error(F.lit("a label image lacks pixels, or has some twice")).cast("binary")).alias("data"))


def sliding_least(v: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The least of each window from k // 2 before a place to k - 1 - k // 2 after it, cut off at the ends, along an axis:
    running minima from both sides of blocks of k, so three steps a value whatever k is."""
    v = np.moveaxis(v, axis, -1)
    n = v.shape[-1]
    padded = np.full((*v.shape[:-1], -(-(n + k - 1) // k) * k), 255, dtype=np.uint8)
    padded[..., k // 2 : k // 2 + n] = v
    blocks = padded.reshape(*v.shape[:-1], -1, k)
    ahead = np.minimum.accumulate(blocks, axis=-1).reshape(padded.shape)
    behind = np.minimum.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(padded.shape)
    return np.moveaxis(np.minimum(behind[..., :n], ahead[..., k - 1 : k - 1 + n]), -1, axis)


def _eroded_means(patches: np.ndarray, k: int) -> np.ndarray:
    """Of equal patches (n, rows, columns): mean after erosion inside the patch, as a share of 255."""
    if k > 1:
        patches = sliding_least(sliding_least(patches, k, 1), k, 2)
    return patches.sum(axis=(1, 2), dtype=np.int64) / (255.0 * patches.shape[1] * patches.shape[2])


def _alike(pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(half, rows, columns, places in pdf) of points whose patches are alike, so many at a time."""
    for (half, h, w), at in pdf.groupby([pdf["half"], pdf["b"] - pdf["a"] + 1, pdf["f"] - pdf["e"] + 1]).indices.items():
        step = max(1, TOGETHER // int(h * w))
        for low in range(0, len(at), step):
            yield int(half), int(h), int(w), at[low : low + step]


def patch_values(points: DataFrame, labels: DataFrame, shapes: DataFrame, side: int = SIDE) -> DataFrame:
    """t of each distinct (image, r, row, col): mean of the label patch around it (ends exclusive,
    never the image's last row or column) after erosion by a square of half the region size inside the patch;
    no row for an empty patch.

    Points go to the label tiles that their patches touch (one, mostly; up to four while a patch is no larger than a tile). A patch inside
    a tile is valued there; the pieces of others meet once more, as bytes. No row a pixel of a patch."""
    key = ["image", "r", "row", "col"]
    p = points.select(*key).distinct().join(small(shapes.select("image", "h", "w")), "image")
    half = div(F.col("r"), 2)
    p = p.withColumn("half", half).withColumn("a", F.greatest(F.lit(0), F.col("row") - half)).withColumn("b", F.least(F.col("h") - 1, F.col("row") + half) - 1).withColumn("e", F.greatest(F.lit(0), F.col("col") - half)).withColumn("f", F.least(F.col("w") - 1, F.col("col") + half) - 1)
    bounds = ["half", "a", "b", "e", "f"]
    p = p.where("a <= b and e <= f").select("image", F.col("r").cast("int").alias("r"), *(F.col(c).cast("long").alias(c) for c in ["row", "col", *bounds]))
    tile = ["image", "ty", "tx"]
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side).cast("long"), F.floor(F.col(high) / side).cast("long")))
    sent = p.withColumn("ty", span("a", "b")).withColumn("tx", span("e", "f"))
    kind = points.schema["image"].dataType.simpleString()
    schema = f"image {kind}, r int, row long, col long, half long, a long, b long, e long, f long, ty long, tx long, piece binary, t double"
    names = [*key, *bounds, "ty", "tx", "piece", "t"]

    def cut(at, points: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(tiles):
            return pd.DataFrame(columns=names)
        a = np.frombuffer(tiles["data"].iloc[0], dtype=np.uint8).reshape(int(tiles["rows"].iloc[0]), -1)
        top, left = int(at[1]) * side, int(at[2]) * side
        inside = (points["a"] >= top) & (points["b"] < top + a.shape[0]) & (points["e"] >= left) & (points["f"] < left + a.shape[1])
        whole, parted = points[inside].assign(piece=None), points[~inside].assign(t=np.nan)
        t = np.empty(len(whole))
        y, x = whole["a"].to_numpy() - top, whole["e"].to_numpy() - left
        for half, h, w, n in _alike(whole):
            t[n] = _eroded_means(sliding_window_view(a, (h, w))[y[n], x[n]], half)
        low = lambda v, first: np.maximum(v.to_numpy() - first, 0)
        pieces = [a[y1:y2, x1:x2].tobytes() for y1, y2, x1, x2 in zip(low(parted["a"], top), low(parted["b"] + 1, top), low(parted["e"], left), low(parted["f"] + 1, left))]
        return pd.concat([whole.assign(t=t)[names], parted.assign(piece=pieces)[names]])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        each = pdf.drop_duplicates(key).reset_index(drop=True)
        place = {k: n for n, k in enumerate(zip(each["r"], each["row"], each["col"]))}
        held = [np.full((b - a + 1, f - e + 1), 255, dtype=np.uint8) for a, b, e, f in each[["a", "b", "e", "f"]].itertuples(index=False)]
        for r, row, col, a, b, e, f, ty, tx, piece in pdf[["r", "row", "col", "a", "b", "e", "f", "ty", "tx", "piece"]].itertuples(index=False):
            y, x = max(ty * side, a), max(tx * side, e)
            h, w = min((ty + 1) * side, b + 1) - y, min((tx + 1) * side, f + 1) - x
            held[place[r, row, col]][y - a : y - a + h, x - e : x - e + w] = np.frombuffer(piece, dtype=np.uint8).reshape(h, w)
        t = np.empty(len(each))
        for half, _, _, n in _alike(each):
            t[n] = _eroded_means(np.stack([held[k] for k in n]), half)
        return each.assign(t=t)[[*key, "t"]]

    tiles = label_tiles(labels, side)
    tiles = tiles.select(*(F.col(c).alias(c) for c in tiles.columns))  # columns of its own for the cogroup
    found = written(sent.groupBy(*tile).cogroup(tiles.groupBy(*tile)).applyInPandas(cut, schema), "patches")
    origin = [F.floor(F.col(c) / side).alias(f"{c}_tile") for c in ("a", "e")]
    joined = found.where("piece is not null").groupBy("image", *origin).applyInPandas(join, f"image {kind}, r int, row long, col long, t double")
    return found.where("piece is null").select(*key, "t").unionByName(joined)


def score_paths(paths: DataFrame, labels: DataFrame, shapes: DataFrame) -> DataFrame:
    """image, r, c, s, t, score: 1 less 0.03 (1 - t) for each inner point whose t is below a half, 0 at least.
    Points are valued once, however many routes pass them."""
    values = patch_values(paths, labels, shapes).withColumnRenamed("t", "value")
    order = Window.partitionBy(*PATH)
    inner = paths.withColumn("inner", (F.col("seq") > F.min("seq").over(order)) & (F.col("seq") < F.max("seq").over(order)))
    met = inner.join(shuffled(values), ["image", "r", "row", "col"], "left")
    lost = F.sum(F.when(F.col("inner") & (F.col("value") < PASSABLE), 1 - F.col("value")))
    return met.groupBy(*PATH).agg(F.greatest(F.lit(0.0), 1 - PENALTY * F.coalesce(lost, F.lit(0.0))).alias("score"))


def _a() -> Column:
    return F.col("a")


def _b() -> Column:
    return F.col("b")


def _rmse() -> Column:
    return F.sqrt(F.avg((_a() - _b()) * (_a() - _b())))


def errors(data_range: float = 1.0) -> dict[str, Column]:
    """Aggregates over a (estimate) and b (truth)."""
    mse = F.avg((_a() - _b()) * (_a() - _b()))
    return {
        "corr": F.corr("a", "b"),
        "jaccard": F.sum(F.least("a", "b")) / F.nullif(F.sum(F.greatest("a", "b")), F.lit(0.0)),
        "rmse": _rmse(),
        "nrmse": F.try_divide(_rmse(), F.avg("b")),
        "psnr": F.when(mse > 0, 10 * F.log10(F.lit(data_range * data_range) / mse)),
        "nmae": F.avg(F.abs(_a() - _b())) / 255,
    }


def compare(matrix: DataFrame, truth: DataFrame) -> DataFrame:
    """image, r, i, j, a (estimate), b (truth)."""
    return matrix.select("image", "r", "i", "j", F.col("t").alias("a")).join(truth.select("image", "r", "i", "j", F.col("t").alias("b")), ["image", "r", "i", "j"])


def error(pairs: DataFrame, measure: str, data_range: float = 1.0) -> DataFrame:
    """image, r, value of one measure: corr, jaccard, rmse, nrmse, psnr, nmae or ssim."""
    if measure == "ssim":
        return ssim(pairs, data_range)
    return pairs.groupBy("image", "r").agg(errors(data_range)[measure].alias("value"))


def ssim(pairs: DataFrame, data_range: float = 1.0, side: int = 7) -> DataFrame:
    """Mean structural similarity over the inside: uniform windows, sample covariance, constants
    0.01 and 0.03. Box sums are two passes of windows, along rows and then columns."""
    m, n = side // 2, side * side
    terms = {"sa": _a(), "sb": _b(), "saa": _a() * _a(), "sbb": _b() * _b(), "sab": _a() * _b()}
    along = Window.partitionBy("image", "r", "i").orderBy("j").rowsBetween(-m, m)
    down = Window.partitionBy("image", "r", "j").orderBy("i").rowsBetween(-m, m)
    v = pairs.select("image", "r", "i", "j", *[e.alias(k) for k, e in terms.items()])
    v = v.select("image", "r", "i", "j", *[F.sum(k).over(along).alias(k) for k in terms]).select("image", "r", "i", "j", *[F.sum(k).over(down).alias(k) for k in terms])
    size = Window.partitionBy("image", "r")
    v = v.withColumn("rows", F.max("i").over(size) + 1).withColumn("cols", F.max("j").over(size) + 1).where((F.col("i") >= m) & (F.col("i") < F.col("rows") - m) & (F.col("j") >= m) & (F.col("j") < F.col("cols") - m))
    ma, mb = F.col("sa") / n, F.col("sb") / n
    norm = n / (n - 1)
    va, vb, cov = norm * (F.col("saa") / n - ma * ma), norm * (F.col("sbb") / n - mb * mb), norm * (F.col("sab") / n - ma * mb)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    each = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return v.groupBy("image", "r").agg(F.avg(each).alias("value"))


def mse_resized(matrix: DataFrame, resized_labels: DataFrame) -> DataFrame:
    """image, r, value: mean squared difference of t from the label image resized to the matrix (0 to 255)."""
    met = matrix.join(resized_labels.select("image", "r", "i", "j", F.col("t").alias("lab")), ["image", "r", "i", "j"])
    d = F.col("t") - F.col("lab") / 255
    return met.groupBy("image", "r").agg(F.avg(d * d).alias("value"))
