"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import shared
from ..shared import n_bytes, new_path, shared_dir, small

__all__ = ["cache", "give_back", "long_texts", "n_bytes", "new_path", "rounds", "shared_dir", "small", "table", "tidy", "width", "written"]

#: How intermediate tables are written: small row groups, as a writer holds one before it writes.
WRITER = {"compression": "zstd", "parquet.block.size": str(16 << 20)}

#: What workers keep from one batch to the next; emptied at a task's end.
_caches: list[dict] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    return shared.written(df, label, sorts=False, **WRITER)


def rounds(spark: SparkSession, label: str) -> shared.Rounds:
    return shared.Rounds(spark, label, sorts=False, **WRITER)


def long_texts(spark: SparkSession) -> None:
    """Sends rows of texts to Python 1,000 at a time where the session has the default of 10,000:
    workers and the JVM's Arrow buffers then hold a few MB of text, not tens."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def cache(kept: dict) -> dict:
    """Registers what a worker keeps, so that a task's end empties it."""
    _caches.append(kept)
    return kept


def give_back() -> None:
    """Empties the worker's caches and gives freed memory back to the machine: workers outlive
    their tasks, and the next task may be another operator's."""
    for kept in _caches:
        kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose worker gives its memory back at the task's end."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
