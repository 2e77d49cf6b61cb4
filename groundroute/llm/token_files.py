"""Token-ID output: independent zstandard frames, a trailing seek table, per-frame checksums.

A file holds, in this order: data frames (ids of whole documents, little-endian unsigned
integers of 2 or 4 bytes, about ``frame_ids`` ids each), one index frame (of each document:
id, frame, offset, length), and the public seek-table frame: per frame the compressed and the
plain size and the low 32 bits of the XXH64 of its plain bytes, then the footer. A reader
takes the footer, the table and the index, then only the frames it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, files
from .encoding import encoder, slices, vocabulary

#: Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_IDS = 1 << 17
MANIFEST = "part long, path string, first_id long, last_id long, n_docs long, n_tokens long, n_bytes long"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("n", "<u8")])


class Writer:
    """One file; add() the documents in order, then close()."""

    def __init__(self, uri: str, item: int, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.item, self.limit = files.open_write(uri), item, frame_ids * item
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.pending: list[bytes] = []
        self.size = self.tokens = self.written = 0

    def _frame(self, plain: bytes) -> None:
        packed = self.compress(plain)
        self.out.write(packed)
        self.written += len(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.pending:
            self._frame(b"".join(self.pending))
            self.pending, self.size = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.item
        self.index.append((doc_id or 0, doc_id is None, len(self.table), self.size // self.item, n))
        self.pending.append(ids)
        self.size += len(ids)
        self.tokens += n
        if self.size >= self.limit:
            self._flush()

    def close(self) -> None:
        self._flush()
        self._frame(bytes([self.item]) + np.array(self.index, dtype=INDEX).tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.written += len(body) + 8
        self.out.close()


class Reader:
    """Reads a file by its seek table; a frame is fetched and checked when one of its documents is wanted."""

    def __init__(self, uri: str):
        self.uri, self.file = uri, files.open_read(uri)
        size = self.file.size()
        count, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError(f"no seek table in {uri}")
        raw = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(count, 3)
        self.sizes, self.sums = raw[:, :2].astype(np.int64), raw[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        self.frames_read = 0
        index = self.frame(count - 1)
        self.item, self.index = index[0], np.frombuffer(index, dtype=INDEX, offset=1)
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.sizes[k, 0])), max_output_size=int(self.sizes[k, 1]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} of {self.uri} fails its checksum")
        self.frames_read += 1
        return plain

    def document(self, row) -> np.ndarray:
        k = int(row["frame"])
        if self._last[0] != k:
            self._last = (k, self.frame(k))
        return np.frombuffer(self._last[1], dtype=f"<u{self.item}", count=int(row["n"]), offset=int(row["offset"]) * self.item)

    def read(self, doc_ids) -> dict[int, list[np.ndarray]]:
        """The ids of the documents asked for; only their frames are decompressed."""
        wanted: dict[int, list[np.ndarray]] = {}
        for row in self.index[np.isin(self.index["doc_id"], list(doc_ids)) & (self.index["null"] == 0)]:
            wanted.setdefault(int(row["doc_id"]), []).append(self.document(row))
        return wanted


def write_token_files(docs: DataFrame, out: str, vocab: str | None = None, end_id: int = 2, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encodes docs (doc_id, text, others ignored), appends end_id to each, writes files under
    ``out`` in ascending doc_id order and returns their manifest, itself a table in the shared
    folder. Only files of successful task attempts are in the manifest, so retries are harmless.

    A null text is empty (its end id alone is written); a null doc_id comes first; rows that
    share a doc_id are all written, by a hash of their text. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    common.long_texts(spark)
    path = vocab or vocabulary()

    def write(batches):
        from pyspark import TaskContext

        coder, writer, uri, first, last = encoder(path), None, "", None, None
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for ids, texts in slices(batch):
                if writer is None:
                    uri = f"{out}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                    writer, first = Writer(uri, coder.dtype.itemsize, frame_ids), ids[0]
                for i, x in zip(ids, coder.encode(texts)):
                    writer.add(i, x + end)
                last = ids[-1]
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": uri, "first_id": first, "last_id": last, "n_docs": len(writer.index), "n_tokens": writer.tokens, "n_bytes": writer.written}], schema=pa.schema([("part", pa.int64()), ("path", pa.string()), *((c, pa.int64()) for c in ("first_id", "last_id", "n_docs", "n_tokens", "n_bytes"))]))

    files.make_dir(out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # with the text's hash, rows that share an id (or have none) spread over tasks and files too
    order = ["doc_id", "hash", "text"]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(common.width(spark), *order[:2]).sortWithinPartitions(*order)
    return common.written(dealt.select("doc_id", "text").mapInArrow(common.tidy(write), MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """base: ids in all files before this one. The manifest has one row for each file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens
    (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    spark = manifest.sparkSession

    def read(batches):
        for batch in batches:
            for x in batch.to_pylist():
                reader, start, rows = Reader(x["path"]), x["base"], []
                for row in reader.index:
                    ids = reader.document(row)
                    rows.append((None if row["null"] else int(row["doc_id"]), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_starts(manifest).select("path", "base").repartition(common.width(spark), "path").mapInArrow(common.tidy(read), DECODED)


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids (array of int) of the documents in ``wanted`` (doc_id); of each file only
    the frames that hold one of them are decompressed."""
    spark = manifest.sparkSession
    held = common.small(manifest.select("path", "first_id", "last_id"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("want")).where("want is not null").distinct()
    per_file = asked.join(held, (F.col("want") <= F.col("last_id")) & ((F.col("want") >= F.col("first_id")) | F.col("first_id").isNull())).groupBy("path").agg(F.collect_list("want").alias("ids"))

    def read(batches):
        for batch in batches:
            for x in batch.to_pylist():
                rows = [{"doc_id": i, "ids": a.astype(np.int32)} for i, found in Reader(x["path"]).read(x["ids"]).items() for a in found]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return per_file.repartition(common.width(spark), "path").mapInArrow(read, "doc_id long, ids array<int>")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, common.new_path(spark, "token-files")))
