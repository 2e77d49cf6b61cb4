"""Token counts from flat token files without an index: a separator scan.

The files are cut into blocks; each block is searched for the end-of-document id by one
vectorised comparison; a prefix scan over the blocks of a file (last separator so far,
separators so far) joins the documents that cross block boundaries.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, files
from .encoding import encoder, slices, vocabulary

BLOCK_BYTES = 8 << 20
#: <|endoftext|> of the vocabulary; texts are encoded so that they can't hold it.
END_ID = 50256


def write_flat(docs: DataFrame, out: str, vocab: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes one flat file of 2- or 4-byte ids for each input partition, every document
    followed by end_id. Returns a written table (path, ordinal, doc_id, item) of what went
    where; the files themselves hold ids only. Null text: empty."""
    common.long_texts(docs.sparkSession)
    path = vocab or vocabulary()

    def write(batches):
        coder, sink, uri, n = encoder(path, True), None, "", 0
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        for batch in batches:
            for ids, texts in slices(batch):
                if sink is None:
                    uri = f"{out}/flat-{uuid.uuid4().hex}.bin"
                    sink = files.open_write(uri)
                for x in coder.encode(texts):
                    sink.write(x)
                    sink.write(end)
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(ids)), pa.array(range(n, n + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array([coder.dtype.itemsize] * len(ids), pa.int32())], names=["path", "ordinal", "doc_id", "item"])
                n += len(ids)
        if sink is not None:
            sink.close()

    files.make_dir(out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.written(rows.mapInArrow(write, "path string, ordinal long, doc_id long, item int"), "flat-map")


def scan(paths: DataFrame, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of the flat files in ``paths`` (path, item: bytes of an id): path, ordinal (from
    0), start and n_tokens in ids without the separator, ended (false for ids after the last
    separator). A file without ids has no document; two separators in a row enclose an empty one."""
    spark = paths.sparkSession

    def blocks(batches):
        for batch in batches:
            for x in batch.to_pylist():
                step = max(1, block_bytes // x["item"])
                total = files.size_of(x["path"]) // x["item"]
                at = list(range(0, total, step))
                yield pa.RecordBatch.from_arrays([pa.array([x["path"]] * len(at), pa.string()), pa.array([x["item"]] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array([min(step, total - a) for a in at], pa.int64()), pa.array([total] * len(at), pa.int64())], names=["path", "item", "first", "n", "total"])

    def search(batches):
        for batch in batches:
            for x in batch.to_pylist():
                with files.open_read(x["path"]) as f:
                    f.seek(x["first"] * x["item"])
                    ids = np.frombuffer(f.read(x["n"] * x["item"]), dtype=f"<u{x['item']}")
                ends = np.flatnonzero(ids == end_id) + x["first"]
                yield pa.RecordBatch.from_arrays([pa.array([x["path"]]), pa.array([x["first"]], pa.int64()), pa.array([x["total"]], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["path", "first", "total", "ends"])

    n = common.width(spark)
    cut = paths.select("path", "item").repartition(n, "path").mapInArrow(blocks, "path string, item int, first long, n long, total long")
    found = cut.repartition(n, "path", "first").mapInArrow(search, "path string, first long, total long, ends array<long>")
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        found.withColumn("count", F.size("ends"))
        .withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .withColumn("last", F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before), F.lit(-1)))
    )
    ended = stitched.select(
        "path", F.posexplode("ends").alias("k", "at"), "base", "last", "ends",
    ).select(
        "path", (F.col("base") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") == 0, F.col("last")).otherwise(F.col("ends")[F.col("k") - 1]) + 1).alias("start"), "at",
    )
    tails = found.groupBy("path").agg(F.max("total").alias("total"), F.sum(F.size("ends")).alias("ordinal"), (F.max(F.coalesce(F.array_max("ends"), F.lit(-1))) + 1).alias("start"))
    return ended.select("path", F.col("ordinal").cast("long").alias("ordinal"), "start", (F.col("at") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended")).unionByName(
        tails.where("start < total").select("path", F.col("ordinal").cast("long").alias("ordinal"), "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    )


def token_counts(docs: DataFrame, out: str, vocab: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and n_tokens of every row of docs, counted by a scan of flat files under ``out``."""
    map_ = write_flat(docs, out, vocab)
    found = scan(map_.select("path", "item").distinct(), block_bytes=block_bytes)
    # file names compress so well that a size estimate of the map would suggest a broadcast
    return map_.hint("merge").join(found, ["path", "ordinal"]).select("doc_id", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), common.new_path(spark, "flat-tokens"))
