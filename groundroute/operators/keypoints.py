"""Marked points: blobs, the cells they fall in, and their pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import components, in_groups, shuffled, small, written
from .grid import _covering, _geometry
from ..functions import div

#: Fixed limits of the blob filter.
LEAST_AREA, LEAST_CIRCULARITY, LEAST_CONVEXITY, LEAST_INERTIA = 20, 0.1, 0.5, 0.5


#: Side of a tile whose bright pixels one task joins.
SIDE = 256
#: What a row of blob_runs is: a run of pixels; a pixel at its tile's edge; a pixel of another tile beside it.
RUN, EDGE, BESIDE = 0, 1, 2


def _join_runs(y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """The number of the first run of each run's component (runs by y, then x1; 8-connected), by union-find."""
    root = list(range(len(y)))

    def find(n: int) -> int:
        while root[n] != n:
            root[n] = n = root[root[n]]
        return n

    first = np.searchsorted(y, y - 1).tolist()
    rows, left, right = y.tolist(), x1.tolist(), x2.tolist()
    above = 0
    for n in range(len(rows)):
        if n and rows[n] == rows[n - 1]:
            above = max(above - 1, first[n])  # a run above may touch this one as well
        else:
            above = first[n]
        while above < n and rows[above] == rows[n] - 1 and left[above] <= right[n] + 1:
            if right[above] >= left[n] - 1:
                a, b = find(above), find(n)
                root[max(a, b)] = min(a, b)
            above += 1
    return np.array([find(n) for n in range(len(rows))], dtype=np.int64)


def blob_runs(bright: DataFrame, side: int = SIDE) -> DataFrame:
    """image, kind, y, x1, x2, sides (of its pixels that no bright pixel shares), label of the runs of bright (image, kind, y, x) pixels: label is the
    smallest (y, x) of the 8-connected component, as one number.

    A task joins the runs of one tile by union-find, with the neighbouring tiles' edge pixels around it. Components of tiles that touch
    across an edge are joined by components() of these links alone; a row is a run, not a pixel."""
    key = ["image", "kind"]
    near = lambda c: F.explode(F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor((F.col(c) + d) / side).cast("long"))))
    sent = bright.select(*key, "y", "x").distinct().withColumn("ty", near("y")).withColumn("tx", near("x"))
    types = {f.name: f.dataType.simpleString() for f in bright.schema}
    names = [*key, "what", "y", "x1", "x2", "sides", "label"]

    def label(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(at[2]) * side, int(at[3]) * side
        lit = np.zeros((side + 2, side + 2), dtype=bool)  # with a pixel of the neighbours around
        lit[pdf["y"].to_numpy() - top + 1, pdf["x"].to_numpy() - left + 1] = True
        own = lit[1:-1, 1:-1]
        turns = np.diff(np.pad(own, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (y, x1), x2 = np.nonzero(turns == 1), np.nonzero(turns == -1)[1] - 1
        if not len(y):
            return pd.DataFrame(columns=names)
        root = _join_runs(y, x1, x2)
        free = (own & ~lit[:-2, 1:-1]).astype(np.int64) + (own & ~lit[2:, 1:-1]) + (own & ~lit[1:-1, :-2]) + (own & ~lit[1:-1, 2:])
        before = np.pad(np.cumsum(free, axis=1), ((0, 0), (1, 0)))
        mark = ((y[root] + top) << 31) + x1[root] + left
        of = np.full(lit.shape, -1, dtype=np.int64)
        cells = np.repeat(np.arange(len(y)), x2 - x1 + 1)
        of[y[cells] + 1, x1[cells] + 1 + np.arange(len(cells)) - np.repeat(np.cumsum(x2 - x1 + 1) - (x2 - x1 + 1), x2 - x1 + 1)] = mark[cells]
        runs = pd.DataFrame({"what": RUN, "y": y + top, "x1": x1 + left, "x2": x2 + left, "sides": before[y, x2 + 1] - before[y, x1], "label": mark})
        inner = np.zeros(lit.shape, dtype=bool)
        inner[2:-2, 2:-2] = True
        ey, ex = np.nonzero((of >= 0) & ~inner)
        parts = [runs, pd.DataFrame({"what": EDGE, "y": ey - 1 + top, "x1": ex - 1 + left, "label": of[ey, ex]})]
        outside = np.ones(lit.shape, dtype=bool)
        outside[1:-1, 1:-1] = False
        by, bx = np.nonzero(lit & outside)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                ny, nx = by + dy, bx + dx
                fits = (ny >= 1) & (ny <= side) & (nx >= 1) & (nx <= side)
                met = of[ny[fits], nx[fits]]
                parts.append(pd.DataFrame({"what": BESIDE, "y": by[fits] - 1 + top, "x1": bx[fits] - 1 + left, "label": met})[met >= 0])
        out = pd.concat(parts).drop_duplicates().assign(image=at[0], kind=at[1])
        return out.assign(**{c: out[c].astype("Int64") for c in ("x2", "sides")})[names]

    schema = f"image {types['image']}, kind {types['kind']}, what int, y long, x1 long, x2 long, sides long, label long"
    found = written(sent.groupBy(*key, "ty", "tx").applyInPandas(label, schema), "blob-runs")
    edge, beside = (found.where(F.col("what") == w).select(*key, "y", "x1", F.col("label").alias(c)) for w, c in ((EDGE, "a"), (BESIDE, "b")))
    links = edge.join(beside, [*key, "y", "x1"]).where("a <> b").select(*key, "a", "b").distinct()
    root = components(links, key).withColumnsRenamed({"node": "label"})
    runs = found.where(F.col("what") == RUN).drop("what").join(small(root), [*key, "label"], "left")
    return runs.select(*key, "y", "x1", "x2", "sides", F.coalesce("root", "label").alias("label"))


def label_blobs(bright: DataFrame, side: int = SIDE) -> DataFrame:
    """bright (image, kind, y, x) with label: the smallest (y, x) of its 8-connected component, as one number."""
    return blob_runs(bright, side).select("image", "kind", "y", F.explode(F.sequence("x1", "x2")).alias("x"), "label")


def _hull_area_perimeter(pts: np.ndarray) -> tuple[float, np.ndarray]:
    pts = np.unique(pts, axis=0)

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    hull = np.array(half(list(pts))[:-1] + half(list(pts[::-1]))[:-1], dtype=float)
    y, x = hull[:, 0], hull[:, 1]
    return 0.5 * abs(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))), hull


def find_blobs(markers: DataFrame, threshold: int = 127, most_area: int | None = None) -> DataFrame:
    """image, kind, ord (from 0, by place), y, x of bright marks: 8-connected pixels above the
    threshold whose area, circularity, convexity and inertia pass the limits; the place is the
    centroid, cut to whole pixels. One threshold stands for a detector's ladder of them. most_area, if given, leaves out
    larger blobs. A blob's shape comes from sums and from the ends of its rows of pixels: no task holds a blob's pixels."""
    runs = blob_runs(markers.where(F.col("gray") > threshold).select("image", "kind", "y", "x"))
    key = ["image", "kind", "label"]
    n, low, high = F.col("x2") - F.col("x1") + 1, F.col("x1"), F.col("x2")
    x, xx = div((low + high) * n, 2), div(high * (high + 1) * (2 * high + 1), 6) - div((low - 1) * low * (2 * low - 1), 6)
    stats = runs.groupBy(*key).agg(
        F.sum(n).alias("area"), F.sum(F.col("y") * n).alias("sy"), F.sum(x).alias("sx"), F.sum(F.col("y") * F.col("y") * n).alias("syy"), F.sum(xx).alias("sxx"), F.sum(F.col("y") * x).alias("sxy"), F.sum("sides").alias("edge"),
    )
    sized = stats.where((F.col("area") >= LEAST_AREA) & (F.lit(most_area is None) | (F.col("area") <= F.lit(most_area or 0))))
    ends = runs.groupBy(*key, "y").agg(F.min("x1").alias("low"), F.max("x2").alias("high")).join(sized, key)

    def shape(table: pa.Table, first: np.ndarray) -> Iterator[pa.Table]:
        area, edge, sy, sx, syy, sxx, sxy = (table[c].to_numpy()[first] for c in ("area", "edge", "sy", "sx", "syy", "sxx", "sxy"))
        y, *sides = (table[c].to_numpy().astype(float) for c in ("y", "low", "high"))
        hull_area = np.empty(len(first))
        for n, (a, b) in enumerate(zip(first, [*first[1:], len(y)])):
            hull_area[n], _ = _hull_area_perimeter(np.concatenate([np.c_[y[a:b] + dy, side[a:b] + dx] for side, dx in zip(sides, (-0.5, 0.5)) for dy in (-0.5, 0.5)]))
        vy, vx, vxy = syy - sy.astype(float) ** 2 / area, sxx - sx.astype(float) ** 2 / area, sxy - sy.astype(float) * sx / area
        spread = np.hypot(vy - vx, 2 * vxy)
        low, high = (vy + vx - spread) / 2, (vy + vx + spread) / 2
        even = low / np.where(high > 0, high, 1) >= LEAST_INERTIA
        ok = (4 * np.pi * area / edge.astype(float) ** 2 >= LEAST_CIRCULARITY) & (area / hull_area >= LEAST_CONVEXITY) & ((high <= 0) | even)
        named = table.select(["image", "kind"]).take(pa.array(first[ok]))
        yield pa.table([*named.columns, (sy // area)[ok], (sx // area)[ok]], names=["image", "kind", "y", "x"])

    kind = markers.schema["image"].dataType.simpleString()
    found = in_groups(ends, key, shape, f"image {kind}, kind string, y long, x long")
    return found.select("image", "kind", (F.row_number().over(Window.partitionBy("image", "kind").orderBy("y", "x")) - 1).alias("ord"), "y", "x")


def keypoint_cells(keypoints: DataFrame, shapes: DataFrame, sizes: Sequence[int], ov: int = 1) -> DataFrame:
    """image, kind, r, ord, k: the cells whose leading r/ov square holds the point (both borders
    half open). Points outside the grid are dropped; with overlap and odd r a point may have
    two cells an axis, and ord then tells them apart (by point, then cell)."""
    p = keypoints.join(shuffled(_geometry(shapes, sizes, ov)), "image")
    for at, edge, count, index in (("y", "ey", "rows", "i"), ("x", "ex", "cols", "j")):
        if ov == 1:
            p = p.withColumn(index, F.floor((F.col(at) - F.col(edge)) / F.col("r"))).where((F.col(index) >= 0) & (F.col(index) < F.col(count)))
        else:
            corner = div(F.col(edge) + F.col(index) * F.col("r"), F.col("ov"))
            p = p.withColumn(index, F.explode(_covering(at, edge, count, ov))).where((corner <= F.col(at)) & (F.col(at) < corner + F.col("r") / F.col("ov")))
    p = p.select("image", "kind", "r", F.col("ord").alias("point"), (F.col("i") * F.col("cols") + F.col("j")).alias("k"))
    return p.select("image", "kind", "r", (F.row_number().over(Window.partitionBy("image", "kind", "r").orderBy("point", "k")) - 1).alias("ord"), "k")


def keypoint_pairs(cells: DataFrame) -> DataFrame:
    """image, kind, r, o1, o2, s, t: unordered pairs by list position."""
    key = ["image", "kind", "r"]
    a, b = cells.select(*key, F.col("ord").alias("o1"), F.col("k").alias("s")), cells.select(*key, F.col("ord").alias("o2"), F.col("k").alias("t"))
    return a.join(shuffled(b), key).where("o1 < o2")


def sample_pair(keypoints: DataFrame, seed: int = 0) -> DataFrame:
    """Two keypoints of each image at random (fewer, if it has fewer): those with the smallest digests of seed, image and point."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("image").cast("string"), "kind", F.col("ord").cast("string")))
    order = Window.partitionBy("image").orderBy(digest, "kind", "ord")
    return keypoints.withColumn("pick", F.row_number().over(order)).where("pick <= 2")
