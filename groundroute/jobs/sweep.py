"""The whole way from images to scored routes, over sets of parameters."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import outcome_score
from ..operators.graph import graph_edges
from ..operators.grid import grid
from ..operators.keypoints import keypoint_cells, keypoint_pairs
from ..operators.metrics import score_paths
from ..operators.routes import GRAPH, PATH, pack_paths, path_centers, predecessors, resample_paths, routes, shortest_tree, simplify_paths, smooth_paths, trace_paths, unfound_paths
from ..operators.traversability import blended, ground_truth, scales_of, traversability
from ..shared import shuffled, small, written
from ..sources.images import shapes as shapes_of


def matrices(pixels: DataFrame, labels: DataFrame | None, shapes: DataFrame, tf: str, sizes: Sequence[int], ov: int, multiscale: bool, smooth: bool, normalize: bool, images: DataFrame | None = None, scales: Sequence[int] | None = None) -> DataFrame:
    """The matrix to route on; tf "reference" takes the labels' own. With multiscale the matrices of all scales are made once, for all sizes."""
    if tf == "reference":
        return ground_truth(labels, shapes, sizes, ov)
    if not multiscale:
        return traversability(pixels, shapes, sizes, tf, ov, smooth=smooth, normalize=normalize, images=images)
    used = [s for s in scales_of(sizes, scales) if s <= max(sizes)]
    one = written(traversability(pixels, shapes, used, tf, ov, smooth, None, False, images=images), "scales")
    return reduce(DataFrame.unionByName, [blended(one, shapes, r, ov, normalize=normalize) for r in sizes])


class Clock:
    """Seconds that a sweep's stages took, and how they are shared out: a stage makes all graphs (or routes) together, and each bears the part of it that
    its rows are of all rows."""

    def __init__(self):
        self.took: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.took[name] = self.took.get(name, 0.0) + time.perf_counter() - began

    def shared(self, rows: DataFrame, key: list[str], stage: str, column: str) -> DataFrame:
        """key and the seconds of each key's rows, of a stage whose rows these are."""
        n = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "shares")
        total = n.agg(F.sum("n")).first()[0] or 1
        return n.select(*key, (F.col("n") * (self.took.get(stage, 0.0) / total)).alias(column))


TIMES = ("matrix_build_time", "graph_build_time", "path_build_time")


def search(matrix: DataFrame, cells: DataFrame, cuts: Sequence[float], reach: int = 1, clock: Clock | None = None, preds: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with dist and found; edges; distances from every distinct source. clock: gets the time of the graphs and of the routes. preds: see shortest_tree."""
    clock = clock or Clock()
    cs = F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("c")
    pairs = keypoint_pairs(cells).select("*", cs)
    with clock.stage("graph"):
        edges = written(graph_edges(matrix, cuts, reach), "graph-edges")
    with clock.stage("path"):
        tree = shortest_tree(edges, pairs.select(*GRAPH, "s"), kept=True, preds=preds)
    # a cut cell is no end of a route, not even of one to itself
    kept = matrix.select("image", "r", F.col("k").alias("s"), F.col("t").alias("ts"))
    open_ = pairs.join(kept, ["image", "r", "s"], "left").withColumn("open", F.coalesce(F.col("ts") >= F.col("c"), F.lit(False))).drop("ts")
    met = routes(open_, tree.drop("pred")).withColumn("found", F.col("found") & F.col("open")).withColumn("dist", F.when(F.col("found"), F.col("dist"))).drop("open")
    return met, edges, tree


def shaped(pairs: DataFrame, edges: DataFrame, tree: DataFrame, cells: DataFrame) -> DataFrame:
    """image, r, c, s, t, seq, row, col: found routes simplified, resampled and smoothed; for pairs
    without one the two cells' centres."""
    found = path_centers(trace_paths(pairs, predecessors(edges, tree)), cells)
    curve = smooth_paths(resample_paths(simplify_paths(found)))
    ends = path_centers(unfound_paths(pairs), cells).select(*PATH, "seq", "row", "col")
    return curve.unionByName(ends.distinct())


def run_sweep(pixels: DataFrame, labels: DataFrame | None, keypoints: DataFrame, functions: Sequence[str], sizes: Sequence[int], cuts: Sequence[float], ov: int = 1, multiscale: bool = False, smooth: bool = True, normalize: bool = True, images: DataFrame | None = None, scales: Sequence[int] | None = None) -> DataFrame:
    """Result records for every image, function, region size, cut and keypoint pair: existence (which
    set the pair is of), found, score, coordinates, length, dist. Without labels the score is null.
    ov 2 is an overlap of a half; graphs then reach two cells. scales: what multiscale blends (see scales_of).

    matrix_build_time, graph_build_time and path_build_time (seconds, never null): Spark makes the matrices of all images, the graphs of all cuts and the
    routes of all pairs together, so each record bears its part of what the stage took: by cells, by edges, and by points of the route."""
    shapes = written(shapes_of(pixels), "shapes")
    cells = grid(shapes, sizes, ov)
    points = keypoint_cells(keypoints, shapes, sizes, ov)
    out = None
    for tf in functions:
        clock = Clock()
        with clock.stage("matrix"):
            matrix = written(matrices(pixels, labels, shapes, tf, sizes, ov, multiscale, smooth, normalize, images, scales), "matrix")
        pairs, edges, tree = search(matrix, points, cuts, 2 if ov > 1 else 1, clock, preds=True)
        with clock.stage("path"):
            pairs = written(pairs, "pairs")
            curve = written(shaped(pairs, edges, tree, cells), "curves")
        rows = pairs.join(pack_paths(curve), PATH, "left")
        if labels is not None:
            scored = score_paths(curve.join(shuffled(pairs.where("found").select(*PATH).distinct()), PATH), labels, shapes)
            rows = rows.join(shuffled(scored), PATH, "left")
        else:
            rows = rows.withColumn("score", F.lit(None).cast("double"))
        for table, key, stage in ((matrix, ["image", "r"], "matrix"), (edges, GRAPH, "graph"), (curve, PATH, "path")):
            took = clock.shared(table, key, stage, f"{stage}_build_time")
            rows = rows.join(took if key == PATH else small(took), key, "left")  # a row a path: both sides are dealt out by path already
        existence = F.col("kind") == "reachable"
        score = outcome_score(existence, F.col("found"), F.col("score")) if labels is not None else F.lit(None).cast("double")
        rows = rows.select(
            "image", F.lit(tf).alias("traversability_function"), F.col("r").alias("region_size"), F.col("c").alias("cut_threshold"), existence.alias("path_existence"),
            *(F.coalesce(t, F.lit(0.0)).alias(t) for t in TIMES), F.col("found").alias("path_found"), score.alias("path_score"), "path_coordinates", "path_length", "s", "t", "o1", "o2", "dist",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def route_all(pixels: DataFrame, keypoints: DataFrame, tf: str, size: int, cut: float, labels: DataFrame | None = None, **options) -> DataFrame:
    """Routes between all keypoint pairs of one image set, with or without labels."""
    return run_sweep(pixels, labels, keypoints, [tf], [size], [cut], **options)
