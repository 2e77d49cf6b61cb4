"""Analytics of sweep results: detection rates, heatmaps, times."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import small
from .metrics import compare, errors, ssim

MEASURES = ("corr", "jaccard", "rmse", "nrmse", "psnr", "nmae", "ssim")
TIMES = ("matrix_build_time", "graph_build_time", "path_build_time")


def filter_results(results: DataFrame, images: Sequence[str] | None = None, functions: Sequence[str] | None = None, sizes: Sequence[int] | None = None, cuts: Sequence[float] | None = None) -> DataFrame:
    for column, wanted in (("image", images), ("traversability_function", functions), ("region_size", sizes), ("cut_threshold", cuts)):
        if wanted is not None:
            results = results.where(F.col(column).isin(list(wanted)))
    return results


def _counts() -> dict[str, Column]:
    e, f = F.col("path_existence"), F.col("path_found")
    return {"tp": F.count_if(e & f), "tn": F.count_if(~e & ~f), "fp": F.count_if(~e & f), "fn": F.count_if(e & ~f)}


def confusion(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(*[c.alias(n) for n, c in _counts().items()])


def detection_rates(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, and the feasible, infeasible and overall detection rates (null where nothing counts)."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rate = lambda a, b: F.try_divide(a.cast("double"), b)
    return confusion(results, by).select(
        *by, rate(tp + tn, tp + tn + fp + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
        rate(tp, tp + fn).alias("frdr"), rate(tn, tn + fp).alias("irdr"), rate(tp + tn, tp + tn + fp + fn).alias("fdr"),
    )


def time_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of matrix, graph, mapping, route and total time."""
    m, g, p = (F.col(c) for c in TIMES)
    terms = {"matrix": m, "graph": g, "mapping": m + g, "route": p, "total": m + g + p}
    return results.groupBy(*by).agg(*[x for n, e in terms.items() for x in (F.avg(e).alias(f"{n}_mean"), F.stddev_pop(e).alias(f"{n}_std"))])


def good_path_length(results: DataFrame, by: Sequence[str] = (), least: float = 0.7) -> DataFrame:
    good = F.col("path_existence") & F.col("path_found") & (F.col("path_score") > least)
    return results.groupBy(*by).agg(F.bround(F.avg(F.when(good, F.col("path_length")))).cast("long").alias("length"))


def quality_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by).agg(F.avg("path_score").alias("score_mean"), F.stddev_pop("path_score").alias("score_std"))


def _spine(spark: SparkSession, sizes: Sequence[int], cuts: Sequence[float]) -> DataFrame:
    rows = F.explode(F.array(*map(F.lit, map(int, sizes))))
    return spark.range(1).select(rows.alias("region_size")).select("region_size", F.explode(F.array(*map(F.lit, map(float, cuts)))).alias("cut_threshold"))


def heatmap(results: DataFrame, kind: str, sizes: Sequence[int], cuts: Sequence[float], smoothing: int = 1) -> DataFrame:
    """region_size, cut_threshold, value over every combination. kind: quality (mean score of found
    routes; -1 without any), feasible, infeasible or feasibility (hit rates). smoothing is added
    to the divisor."""
    e, f = F.col("path_existence"), F.col("path_found")
    hit, counted = {"quality": (F.when(f, F.col("path_score")), f), "feasible": (F.when(e & f, 1.0), e), "infeasible": (F.when(~e & ~f, 1.0), ~e), "feasibility": (F.when(e == f, 1.0), F.lit(True))}[kind]
    sums = results.groupBy("region_size", "cut_threshold").agg(F.sum(hit).alias("hits"), F.count_if(counted).alias("n"))
    empty = F.lit(-1.0) if kind == "quality" else F.lit(0.0)
    value = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, empty / F.lit(float(max(smoothing, 1)))).otherwise(F.coalesce("hits", F.lit(0.0)) / (F.col("n") + smoothing))
    return _spine(results.sparkSession, sizes, cuts).join(sums, ["region_size", "cut_threshold"], "left").select("region_size", "cut_threshold", value.alias("value"))


def pivoted(heat: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """A heatmap with one column a cut threshold."""
    return heat.groupBy("region_size").pivot("cut_threshold", [float(c) for c in cuts]).agg(F.first("value"))


def _long(results: DataFrame) -> DataFrame:
    total = F.col(TIMES[0]) + F.col(TIMES[1]) + F.col(TIMES[2])
    return results.withColumn("total_time", total).unpivot(["region_size", "cut_threshold"], [*TIMES, "total_time"], "variable", "v")


def time_series(results: DataFrame) -> DataFrame:
    """variable, cut_threshold, region_size, mean."""
    return _long(results).groupBy("variable", "cut_threshold", "region_size").agg(F.avg("v").alias("mean"))


def time_spread(results: DataFrame) -> DataFrame:
    """variable, cut_threshold, region_size, mean, up, down: how far the values at or above the
    mean, and those below, lie from it on average. Means come from a small aggregate joined back, so
    no group meets in one task."""
    key = ["variable", "cut_threshold", "region_size"]
    long = _long(results)
    means = small(long.groupBy(*key).agg(F.avg("v").alias("mean")))
    return long.join(means, key).groupBy(*key, "mean").agg((F.avg(F.when(F.col("v") >= F.col("mean"), F.col("v"))) - F.col("mean")).alias("up"), (F.col("mean") - F.avg(F.when(F.col("v") < F.col("mean"), F.col("v")))).alias("down"))


def time_series_combined(one: DataFrame, two: DataFrame, labels: tuple[str, str] = ("one", "two")) -> DataFrame:
    return time_series(one).withColumn("label", F.lit(labels[0])).unionByName(time_series(two).withColumn("label", F.lit(labels[1])))


def average_time(results: DataFrame, function: str, size: int, cut: float) -> DataFrame:
    rows = filter_results(results, functions=[function], sizes=[size], cuts=[cut])
    return rows.agg(*[F.avg(t).alias(t) for t in TIMES], F.count(F.lit(1)).alias("n"))


def accuracy_sweep(measured: DataFrame) -> DataFrame:
    """(f,) r, value, n: mean of a measure (image, r, value) over images; where the rows name an estimator (f) or a measure, of each of them."""
    by = [c for c in ("f", "measure") if c in measured.columns]
    return measured.groupBy(*by, "r").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def accuracy_table(matrices: dict[str, DataFrame], truth: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """f, measure, r, value, n: every estimator's matrix against the truth by every measure, as means over images. The aggregates
    of one matrix are one shuffle; only the structural one needs windows of its own."""
    out = None
    for f, matrix in matrices.items():
        pairs = compare(matrix, truth)
        plain = {m: c for m, c in errors().items() if m in measures}
        parts = [pairs.groupBy("image", "r").agg(*[c.alias(m) for m, c in plain.items()]).unpivot(["image", "r"], list(plain), "measure", "value")] if plain else []
        if "ssim" in measures:
            parts.append(ssim(pairs).select("image", "r", F.lit("ssim").alias("measure"), "value"))
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows.withColumn("f", F.lit(f))
        out = rows if out is None else out.unionByName(rows)
    return accuracy_sweep(out)


