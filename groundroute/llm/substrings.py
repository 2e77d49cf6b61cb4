"""Repeated word windows across and within documents, and their removal.

A first pass counts windows in count-min sketches, one a chunk of documents, which are merged by
range of columns. A window is counted under its minimiser: the smallest hash of the ten-word
runs in it, a value that equal windows share, so an estimate is never below the window's
count while a sixth of the insertions do. The sketch has as many columns as the corpus needs; nobody holds more
than one range of it: each chunk's columns go to their ranges and come back if they were counted twice or more.
A second pass groups exactly, by 96-bit hashes,
only windows whose estimate says "repeated"; each task first settles the windows that
repeat among its own rows, so that a very common window costs one row a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, files
from .words import M2, WordHashes, rolling

WINDOW, RUN = 20, 10
#: Sketch columns (as bits of their number) that one range holds: 4 MB of counts.
RANGE_BITS = 22
#: Windows that a task settles at a time; minimisers of a chunk.
FLUSH, CHUNK = 500_000, 500_000
ROW_SEED = np.uint64(0xD6E8FEB86659FD93)
NO_ID = -(1 << 63)

#: Text for each bucket of window hashes; document ranges at least.
BUCKET_BYTES, LEAST_RANGES = 48 << 20, 16
WINDOWS = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("start", "<i4"), ("doc", "<u4")])

_hashes = common.cache(WordHashes())


def anchors(h: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of each window, and the values at all positions that are minimal in some window."""
    g = rolling(h, run)
    n, span = len(h) - window + 1, window - run + 1
    low, size = g, 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[span - size : span - size + n])
    chosen = np.zeros(len(g), dtype=bool)
    for k in range(span):
        chosen[k : k + n] |= g[k : k + n] == low
    return low, g[chosen]


def columns(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return values >> shift, (values * ROW_SEED) >> shift


def _texts(batch):
    """(row parts, words) of an Arrow batch whose last column is the text as bytes."""
    rest = [c.to_pylist() for c in batch.columns[:-1]]
    for *head, text in zip(*rest, batch.columns[-1]):
        yield head, (text.as_py() or b"").split()


def _pack(rows: np.ndarray, keys: np.ndarray, hashes: np.ndarray, hashed: bool) -> bytes:
    """Rows by column, with the documents they are of, compressed. hashed: with the windows' hashes."""
    used, doc = np.unique(rows["doc"], return_inverse=True)
    columns_ = [keys[used], hashes[used], doc.astype("<u4"), rows["start"], *((rows["h1"], rows["h2"]) if hashed else ())]
    return np.array([len(used), len(rows)], dtype="<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns_))


def _unpack(parts: list[bytes], hashed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, keys, hashes of packed parts together."""
    rows, keys, hashes, base = [], [], [], 0
    for part in parts:
        n_docs, n = np.frombuffer(part, dtype="<i8", count=2).tolist()
        plain, at = zstandard.ZstdDecompressor().decompress(part[16:]), 0
        got = []
        for kind, count in (("<i8", n_docs), ("<i8", n_docs), ("<u4", n), ("<i4", n), *((("<u8", n), ("<u4", n)) if hashed else ())):
            got.append(np.frombuffer(plain, dtype=kind, count=count, offset=at))
            at += got[-1].nbytes
        own = np.zeros(n, dtype=WINDOWS)
        own["doc"], own["start"] = got[2] + np.uint32(base), got[3]
        if hashed:
            own["h1"], own["h2"] = got[4], got[5]
        rows.append(own)
        keys.append(got[0])
        hashes.append(got[1])
        base += n_docs
    return np.concatenate([*rows, np.empty(0, dtype=WINDOWS)]), np.concatenate([*keys, np.empty(0, dtype=np.int64)]), np.concatenate([*hashes, np.empty(0, dtype=np.int64)])


def _firsts(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by window, document and start; where a window's rows begin; which rows begin later than its first."""
    key = keys[rows["doc"]]
    order = np.lexsort((rows["start"], key, rows["h2"], rows["h1"]))
    rows, key = rows[order], key[order]
    new = np.r_[True, (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])][: len(rows)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    return rows, new, (key != key[first]) | (rows["start"] != rows["start"][first])


def _heads(rows: np.ndarray, new: np.ndarray, later: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first row of each window, and those that tie with it in key and start but are of another text."""
    tied = rows[~later]
    if len(tied) == int(new.sum()):
        return tied
    window, hash_ = np.cumsum(new)[~later], hashes[tied["doc"]]
    order = np.lexsort((hash_, window))
    tied, window, hash_ = tied[order], window[order], hash_[order]
    return tied[np.r_[True, (window[1:] != window[:-1]) | (hash_[1:] != hash_[:-1])]]


def ranges_of(keys: np.ndarray, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each document, so that neither copies of a text nor rows of a key share one."""
    mixed = (keys.view(np.uint64) * ROW_SEED ^ hashes.view(np.uint64)) * M2
    return (((mixed ^ mixed >> np.uint64(29)) * ROW_SEED >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)


def first_turn(partition: int, buckets: int) -> int:
    """The bucket of a task's first settled windows: tasks begin all over the buckets, not at the same one."""
    return ((partition + 1) * int(M2) * int(ROW_SEED) % (1 << 64) >> 32) % buckets


def in_turn(parts: list[bytes], most: int) -> list[list[bytes]]:
    """Packed parts in order, as many at a time as have together no more than most rows (or one that has more)."""
    out, size = [], 0
    for part in parts:
        n = int(np.frombuffer(part, dtype="<i8", count=2)[1])
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(part)
        size += n
    return out


def chunks(batches, window: int, run: int, size: int):
    """The documents of a task (rows: key, hash, words as bytes) in runs of about so many minimisers: (digest, [(key, hash,
    word hashes)], minimisers). Both passes cut alike where their tasks get the same rows; the digest tells
    whether they did. Documents shorter than a window are left out."""
    digest, held, values, n = xxhash.xxh64(), [], [], 0
    for batch in batches:
        for (key, hash_), words in _texts(batch):
            if len(words) < window:
                continue
            h = _hashes.of(words)
            digest.update(f"{key} {hash_};")
            held.append((key, hash_, h))
            values.append(anchors(h, window, run)[1])
            n += len(values[-1])
            if n >= size:
                yield digest.intdigest() - (1 << 63), held, values
                digest, held, values, n = xxhash.xxh64(), [], [], 0
    if held:
        yield digest.intdigest() - (1 << 63), held, values


FLAGS = "chunk long, row int, range long, low binary"


def sketch(docs: DataFrame, bits: int, range_bits: int = RANGE_BITS, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Of docs (key, hash, words as bytes): for each chunk the columns it uses of the merged sketch's two rows
    that were counted twice or more (chunk, row, range, low: their numbers in the range, uint32)."""
    range_bits = min(bits, range_bits)

    def count(batches):
        for chunk, _, values in chunks(batches, window, run, CHUNK):
            for row, at in enumerate(columns(np.concatenate(values), bits)):
                at, n = np.unique(at, return_counts=True)
                range_, low = (at >> np.uint64(range_bits)).astype(np.int64), (at & np.uint64((1 << range_bits) - 1)).astype("<u4")
                cuts = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1]])
                ends = np.r_[cuts[1:], len(range_)]
                once = [low[a:b][n[a:b] == 1].tobytes() for a, b in zip(cuts, ends)]
                more = [low[a:b][n[a:b] > 1].tobytes() for a, b in zip(cuts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(cuts), pa.int64()), pa.array([row] * len(cuts), pa.int32()), pa.array(range_[cuts]), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["chunk", "row", "range", "once", "more"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << range_bits, dtype=np.uint8)
        for x, y in zip(pdf["once"], pdf["more"]):
            x = np.frombuffer(x, dtype="<u4")  # no number twice in one part
            counts[x] = np.minimum(counts[x], 1) + 1
            counts[np.frombuffer(y, dtype="<u4")] = 2
        once = (np.frombuffer(x, dtype="<u4") for x in pdf["once"])
        back = [x[counts[x] > 1].tobytes() + bytes(y) for x, y in zip(once, pdf["more"])]
        return pdf[["chunk", "row", "range"]].assign(low=back)

    return docs.mapInArrow(common.tidy(count), "chunk long, row int, range long, once binary, more binary").groupBy("row", "range").applyInPandas(merge, FLAGS)


class Flags:
    """What came back of the merged sketch, chunk by chunk, from a table written by slot."""

    def __init__(self, uri: str, slots: int, bits: int, range_bits: int = RANGE_BITS):
        self.uri, self.slots, self.bits, self.range_bits = uri, slots, bits, min(bits, range_bits)

    def of(self, chunk: int) -> list[np.ndarray] | None:
        """The sorted repeated columns of each row of the sketch; None for a chunk that wasn't counted."""
        fs, path = files.split_uri(f"{self.uri}/slot={chunk % self.slots}")
        found = fs.get_file_info(path)
        if found.type != files.pafs.FileType.Directory:
            return None
        rows: list[list[np.ndarray]] = [[], []]
        parts = [x.path for x in fs.get_file_info(files.pafs.FileSelector(path)) if x.path.endswith(".parquet")]
        for part in parts:
            for x in pq.read_table(part, filesystem=fs, partitioning=None, filters=[("chunk", "==", chunk)]).to_pylist():
                rows[x["row"]].append(np.frombuffer(x["low"], dtype="<u4").astype(np.uint64) + (np.uint64(x["range"]) << np.uint64(self.range_bits)))
        return [np.sort(np.concatenate(r)) for r in rows] if all(rows) else None

    def hits(self, low: np.ndarray, flags: list[np.ndarray] | None) -> np.ndarray:
        """Which windows, given by their minimisers, are estimated repeated: all where nothing is known."""
        if flags is None:
            return np.arange(len(low))
        new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])  # neighbouring windows share a minimiser
        hit = np.ones(len(new), dtype=bool)
        for at, known in zip(columns(low[new], self.bits), flags):
            place = np.searchsorted(known, at)
            hit &= (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == at) if len(known) else False
        return np.flatnonzero(np.repeat(hit, np.diff(np.r_[new, len(low)])))


def prefilter(docs: DataFrame, window: int = WINDOW, run: int = RUN, max_columns: int | None = None, range_bits: int = RANGE_BITS) -> Flags:
    """The merged sketch of docs, as what each chunk needs of it. max_columns bounds its columns (more windows
    then pass); by itself it has one for every nine bytes of text, four for each insertion."""
    size = n_text(docs)
    bits = max(16, (min(max_columns or size, max(2, size // 9)) - 1).bit_length())
    slots = max(common.width(docs.sparkSession), size // (64 << 20))
    flags = Flags(common.new_path(docs.sparkSession, "sketch"), slots, bits, range_bits)
    back = sketch(docs, bits, range_bits, window, run).withColumn("slot", F.pmod("chunk", F.lit(slots)))
    back.repartition("slot").sortWithinPartitions("slot", "chunk").write.partitionBy("slot").parquet(flags.uri)
    return flags


def n_text(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def filter_rate(docs: DataFrame, window: int = WINDOW, run: int = RUN, **options) -> tuple[int, int]:
    """(windows, windows that the prefilter estimates repeated) of docs (key, hash, words as bytes)."""
    flags = prefilter(docs, window, run, **options)

    def count(batches):
        for chunk, held, _ in chunks(batches, window, run, CHUNK):
            known = flags.of(chunk)
            for _, _, h in held:
                low, _ = anchors(h, window, run)
                yield pa.RecordBatch.from_arrays([pa.array([len(low)]), pa.array([len(flags.hits(low, known))])], names=["all", "hit"])

    row = docs.mapInArrow(count, "all long, hit long").agg(F.sum("all"), F.sum("hit")).first()
    return row[0] or 0, row[1] or 0


def repeated_starts(docs: DataFrame, window: int = WINDOW, run: int = RUN, max_columns: int | None = None, range_bits: int = RANGE_BITS) -> DataFrame:
    """Of docs (key, hash, words as bytes): key, hash, starts (binary int32): where windows begin
    that also begin earlier (smaller key, or same key and smaller start). One row a document."""
    spark = docs.sparkSession
    size = n_text(docs)
    flags = prefilter(docs, window, run, max_columns, range_bits)
    # a bucket of hashes stays small even if every window were estimated repeated
    buckets = max(common.width(spark), size // BUCKET_BYTES + 1)
    # documents are dealt by key and hash (copies of a text share the hash alone) into ranges of a third of that, as all their windows may come back
    # (their number depends on the text alone: each bucket sends a row to each range)
    ranges = max(LEAST_RANGES, 3 * size // BUCKET_BYTES + 1)
    found = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), ("rows", pa.binary())])

    def candidates(batches):
        held, of, size, turn = [], [], 0, first_turn(TaskContext.get().partitionId(), buckets)

        def settle():
            """Sends the first of equal windows here (all that tie) to their hash's bucket; later ones are known to repeat."""
            nonlocal turn
            keys, hashes = np.array(of, dtype=np.int64).reshape(-1, 2).T
            rows, new, later = _firsts(np.concatenate(held), keys)
            heads = _heads(rows, new, later, hashes)
            bucket = (heads["h1"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            heads, bucket = heads[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [_pack(heads[x:y], keys, hashes, True) for x, y in zip(cuts, np.r_[cuts[1:], len(heads)])]
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[bucket[cuts], turn % buckets]), pa.array([False] * len(cuts) + [True]), pa.array([*parts, _pack(rows[later], keys, hashes, False)], pa.binary())], schema=found)

        for chunk, docs_, _ in chunks(batches, window, run, CHUNK):
            known = flags.of(chunk)
            for key, hash_, h in docs_:
                hit = flags.hits(anchors(h, window, run)[0], known)
                if len(hit):
                    rows = np.empty(len(hit), dtype=WINDOWS)
                    rows["h1"], rows["h2"], rows["start"], rows["doc"] = rolling(h, window)[hit], rolling(h, window, M2)[hit] >> np.uint64(32), hit, len(of)
                    of.append((key, hash_))
                    held.append(rows)
                    size += len(hit)
                if size >= FLUSH:
                    yield from settle()
                    held, of, size = [], [], 0
        if held:
            yield from settle()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a bucket's windows those that begin later than their first, packed for each document range."""
        out, settled = [], pdf["settled"].to_numpy(dtype=bool)
        # settled windows need no others of their bucket: a few flushes at a time are unpacked
        for part, hashed in (*((p, False) for p in in_turn(list(pdf["rows"][settled]), 4 * FLUSH)), (list(pdf["rows"][~settled]), True)):
            if not part:
                continue
            rows, keys, hashes = _unpack(part, hashed)
            if hashed:
                rows, _, later = _firsts(rows, keys)
                rows = rows[later]
            range_ = ranges_of(keys, hashes, ranges)[rows["doc"]]
            order = np.argsort(range_, kind="stable")
            rows, range_ = rows[order], range_[order]
            cuts = np.flatnonzero(np.r_[True, range_[1:] != range_[:-1]][: len(rows)])
            out += [(range_[x], _pack(rows[x:y], keys, hashes, False)) for x, y in zip(cuts, np.r_[cuts[1:], len(rows)])]
        return pd.DataFrame({"range": [r for r, _ in out], "rows": [p for _, p in out]})

    def by_document(pdf: pd.DataFrame) -> pd.DataFrame:
        """A range's packed windows by document."""
        rows, keys, hashes = _unpack(list(pdf["rows"]), False)
        key, hash_, start = keys[rows["doc"]], hashes[rows["doc"]], rows["start"]
        order = np.lexsort((start, hash_, key))
        key, hash_, start = key[order], hash_[order], start[order]
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (hash_[1:] != hash_[:-1])][: len(key)])
        return pd.DataFrame({"key": key[cuts], "hash": hash_[cuts], "starts": [start[x:y].tobytes() for x, y in zip(cuts, np.r_[cuts[1:], len(key)])]})

    packed = docs.mapInArrow(common.tidy(candidates), "bucket long, settled boolean, rows binary").groupBy("bucket").applyInPandas(group, "range long, rows binary")
    return packed.groupBy("range").applyInPandas(by_document, "key long, hash long, starts binary")


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, keep_text: bool = False) -> DataFrame:
    """Every row of docs (doc_id, text; others ignored): doc_id, n_words, n_removed, kept_sha256
    and, if asked for, the kept text (words joined by one space). Words are runs of other than
    ASCII white space. A null text has no words; a null doc_id comes before all others; rows with the same
    doc_id and text are one document met twice, so neither is earlier than the other."""
    common.long_texts(docs.sparkSession)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    starts = repeated_starts(keyed, window, run)
    schema = KEPT + (", text string" if keep_text else "")

    def keep(batches):
        for batch in batches:
            out = []
            for (key, starts_), words in _texts(batch):
                kept, n = words, 0
                if starts_:
                    at = np.frombuffer(starts_, dtype="<i4")
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    n = int(gone.sum())
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(kept)
                out.append((None if key == NO_ID else key, len(words), n, hashlib.sha256(text).hexdigest(), *([text.decode()] if keep_text else [])))
            if out:
                types = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: len(types)])

    return keyed.join(starts, ["key", "hash"], "left").select("key", "starts", "text").mapInArrow(common.tidy(keep), schema)


def op9_repeats_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
