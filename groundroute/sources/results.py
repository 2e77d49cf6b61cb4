"""Result records of a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import small

RESULT = (
    "image string, traversability_function string, region_size int, cut_threshold double, path_existence boolean, "
    "matrix_build_time double, graph_build_time double, path_build_time double, path_found boolean, path_score double, "
    "path_coordinates array<array<int>>, path_length int"
)


def read_results(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """array: the file is one JSON array; else one record a line."""
    return spark.read.schema(RESULT).option("multiLine", array).json(path)


def write_results(results: DataFrame, path: str, parquet: bool = False) -> None:
    """Records as JSON lines, or as Parquet by region size."""
    if parquet:
        results.write.partitionBy("region_size").parquet(path)
    else:
        results.write.json(path)


#: What tells records apart, as far as they have these columns.
KEYS = ("id", "image", "traversability_function", "region_size", "cut_threshold", "path_existence", "o1", "o2", "s", "t")


def append_results(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Old and new records; with keys, new ones that are already there (nulls equal) are left out."""
    if keys:
        have = old.select(*[old[k].alias(f"_{k}") for k in keys]).distinct()
        match = None
        for k in keys:
            same = new[k].eqNullSafe(have[f"_{k}"])
            match = same if match is None else match & same
        new = new.join(have, match, "left_anti")
    return old.unionByName(new, allowMissingColumns=True)


def append_files(new: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Adds records to a folder of Parquet files by region size (as write_results makes it); those that are there already (same keys, nulls
    equal) are left out, so a run that is repeated adds nothing.

    Only the region sizes that new records have are read (a filter at run time) and written again; other partitions, and records of columns
    that new ones lack, stay. Missing folders are begun. Records that repeat within ``new`` are added once."""
    spark = new.sparkSession
    keys = list(keys or [k for k in KEYS if k in new.columns])
    if not keys:
        raise ValueError("nothing tells these records apart: name the keys")
    new = new.dropDuplicates(keys)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        new = append_results(touched(spark, path, new), new, keys)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_size").parquet(path)


def touched(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The stored records of the region sizes that new records have."""
    old = spark.read.parquet(path)
    sizes = new.select(F.col("region_size").cast(old.schema["region_size"].dataType).alias("region_size")).distinct()
    known = sizes.where("region_size is not null and abs(region_size) >= 0")  # a comparison: without one no filter at run time is planned
    return old.where("region_size is not null").join(small(known), "region_size", "left_semi").unionByName(
        old.where("region_size is null").join(small(sizes.where("region_size is null").select(F.lit(1).alias("one"))), F.lit(1) == F.col("one"), "left_semi")
    )
