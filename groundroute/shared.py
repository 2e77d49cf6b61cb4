"""Written intermediate tables: what iterative jobs cut their lineage with. Broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes (of values, uncompressed) up to which a side counts as small enough to broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows of whole groups that a task hands on together.
GATHERED = 1 << 18

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a temporary folder of this process."""
    if base := spark.conf.get("spark.checkpoint.dir", ""):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master: {master})")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-routes-"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """df marked for joins that sort both sides, unless the other side is marked for broadcast. Spark takes the size of a table's files for the table's, and
    would broadcast a well compressed one of many times its own bound."""
    return df.hint("merge")


def _write_to(df: DataFrame, path: str, options: dict[str, str]) -> DataFrame:
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str, sorts: bool = True, **options: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, so lost executors cost no re-run of what came before. options: of the writer. sorts: joins
    with it are shuffled()."""
    out = _write_to(df, new_path(df.sparkSession, label), options)
    return shuffled(out) if sorts else out


class Rounds:
    """The written rounds of an iterative job: a round's table goes when the one after it is whole."""

    def __init__(self, spark: SparkSession, label: str, sorts: bool = True, **options: str):
        self.spark, self.label, self.sorts, self.options, self.last = spark, label, sorts, options, None

    def write(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, self.label)
        out = _write_to(df, path, self.options)
        self.drop()
        self.last = path
        return shuffled(out) if self.sorts else out

    def drop(self) -> None:
        """Removes the last round's table: when nothing reads it any more."""
        if self.last:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.last)
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.last = None


def _width(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + _width(x, kind.elementType)), F.lit(0).cast("long")) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def n_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of df hold."""
    each = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return int(df.agg(F.sum(each)).first()[0] or 0)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows hold so few bytes (summed first), else shuffled(), as Spark would still go by the size of files."""
    return F.broadcast(df) if n_bytes(df) <= most else shuffled(df)


def _starts(table: pa.Table, key: Sequence[str]) -> np.ndarray:
    """Where each run of rows with equal key begins."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in key:
        column = table[name]
        new[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1)), True).to_numpy()
    return np.flatnonzero(new)


def in_groups(df: DataFrame, key: Sequence[str], f: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str, order: Sequence[str] = (), gathered: int = GATHERED) -> DataFrame:
    """df's groups of equal key, many small ones in a call: f gets whole groups (a table by key, then order) and where each begins, and yields tables of
    the schema. A task holds ``gathered`` rows, or one group, if that is larger."""
    key = list(key)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, due = [], 0, gathered
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < due:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            first = _starts(table, key)
            if cut := int(first[-1]):
                for found in f(table.slice(0, cut), first[:-1]):
                    yield from found.combine_chunks().to_batches()
                table = table.slice(cut)
            held, n = table.to_batches(), table.num_rows
            due = max(gathered, 2 * n)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            for found in f(table, _starts(table, key)):
                yield from found.combine_chunks().to_batches()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(task, schema)


def components(edges: DataFrame, key: list[str], label: str = "stars") -> DataFrame:
    """key, node, root (the component's smallest node) for every node of edges (key, a, b: long) that is no root itself, each key apart.

    Every node tells its neighbours of the smallest one it knows, by turns all larger ones and all smaller ones, so that a chain shrinks by half a
    round; written rounds take each other's place, and the last is the one that changes nothing."""
    down = lambda df: df.select(*key, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    kept, state = Rounds(edges.sparkSession, label), None
    now = kept.write(down(edges))
    while True:
        sums = now.agg(F.count(F.lit(1)), F.expr("sum(cast(a as decimal(38,0)))"), F.expr("sum(cast(b as decimal(38,0)))")).first()
        if sums == state or not sums[0]:
            return now.select(*key, F.col("a").alias("node"), F.col("b").alias("root"))
        state = sums
        both = now.unionByName(now.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        least = shuffled(both.groupBy(*key, "a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, [*key, "a"]).select(*key, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = shuffled(large.groupBy(*key, "a").agg(F.min("b").alias("m")))
        told = large.join(low, [*key, "a"]).select(*key, F.col("b").alias("a"), F.col("m").alias("b"))
        now = kept.write(down(told.unionByName(low.select(*key, "a", F.col("m").alias("b")))))
