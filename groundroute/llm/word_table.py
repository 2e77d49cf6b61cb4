"""Byte-pair encoding by a table of distinct words, and decoding by a join of ids and pieces.

Texts are split into the words that the vocabulary's own splitter would part (where that is
certain; else up to the next white space). A task turns its texts, chunk by chunk, into numbers of the
chunk's distinct words and a list of these words. The lists, dealt out by the words' hashes, meet in tasks that encode
each distinct word once and give every list back as ids. A chunk's ids then meet its
numbers again, and the numbers' places give each text's ids. Words travel once a chunk, not once an occurrence.

Decoding looks the piece of each id up in the vocabulary and joins pieces as the vocabulary's decoder does.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import _gather, slices, vocabulary

#: Characters and distinct words of a chunk, about: what a task of the last step holds.
CHUNK_CHARACTERS, CHUNK_WORDS = 32_000_000, 600_000
#: Words that a worker keeps with their ids.
KNOWN_WORDS = 1_000_000

#: Letters that are one letter for every version of Unicode, in any composition, upper and lower case alike (İ has no single lower-case letter).
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
PLAIN = re.compile(f"[\x21-\x7e{LETTERS}]+")
#: The vocabulary's splitter for such letters, digits and ASCII marks, in lower case.
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
#: White space that ends a word for every splitter here.
SPACES = str.maketrans("\t\n\r", "   ")

CODED = "chunk long, kind int, part int, doc_ids array<long>, data binary"
#: Kinds of rows: texts (how many words each has, then all words' numbers); the part of each of a chunk's words; a list of words.
TEXT, PARTS, WORDS = 0, 1, 2
ENCODED = "doc_id long, n_tokens long, ids binary"


def word_vocabulary() -> str:
    return vocabulary("word_bpe_49k.json")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_word(run: str) -> list[str]:
    """The words of a run of characters without white space; the run itself where its letters, marks or added tokens
    leave that to the library."""
    if run.isalpha() and PLAIN.fullmatch(run):
        return [run.lower()]
    return PIECES.findall(run.lower()) if PLAIN.fullmatch(run) and "<|" not in run else [run]


class Chunk:
    """Texts as numbers of distinct words."""

    def __init__(self):
        self.texts: list[tuple[list, np.ndarray, np.ndarray]] = []
        self.words: dict[str, int] = {}
        self.runs: dict[str, bytes] = {"": b""}
        self.characters = 0

    def _number(self, run: str) -> bytes:
        words = self.words
        self.runs[run] = out = array("I", [words.setdefault(w, len(words)) for w in split_word(run)]).tobytes()
        return out

    def add(self, doc_ids: list, texts: list[str]) -> None:
        """Keeps, of some texts, their ids, how many words each has, and the numbers of all these words."""
        self.characters += sum(map(len, texts))
        lists = pc.split_pattern(pa.array([t.translate(SPACES) for t in texts], pa.string()), " ")
        coded, runs = lists.flatten().dictionary_encode(), self.runs
        parts = [runs[r] if r in runs else self._number(r) for r in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        numbers, ends = _gather(np.frombuffer(b"".join(parts), dtype=np.uint32), sizes, coded.indices.to_numpy())
        self.texts.append((doc_ids, np.diff(np.r_[0, ends][lists.offsets.to_numpy()]), numbers))

    def full(self) -> bool:
        return self.characters >= CHUNK_CHARACTERS or len(self.words) >= CHUNK_WORDS or len(self.runs) >= 2 * CHUNK_WORDS


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes plane by plane, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    plain = np.frombuffer(bytearray(zstandard.decompress(data)), dtype=np.uint8)
    return plain.reshape(4, -1).T.copy().view("<u4").ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["chunk", "kind", "part", "doc_ids", "data"])


def _rows(chunk: Chunk, number: int, parts: int) -> Iterator[pa.RecordBatch]:
    """A chunk's texts, their words numbered anew from the most frequent one on (most numbers are small then); the words by part, in the
    order of their numbers, and the part of each."""
    words = list(chunk.words)
    count = np.zeros(len(words), dtype=np.int64)
    for *_, numbers in chunk.texts:
        count += np.bincount(numbers, minlength=len(words))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(words), dtype=np.uint32)
    rank[order] = np.arange(len(words))
    for doc_ids, lengths, numbers in chunk.texts:
        yield _batch([(number, TEXT, None, doc_ids, pack(np.r_[lengths, rank[numbers]]))])
    words = [words[w] for w in order.tolist()]
    to = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)) % np.uint64(parts)
    by_part = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[by_part], np.arange(parts + 1, dtype=np.uint64)).tolist()
    rows = [(number, PARTS, None, None, pack(to))]
    for k, (x, y) in enumerate(zip(bounds, bounds[1:])):
        if y > x:
            rows.append((number, WORDS, k, None, zstandard.compress("\n".join([words[w] for w in by_part[x:y].tolist()]).encode(), 3)))
    yield _batch(rows)


def _split(parts: int):
    def task(batches):
        from pyspark import TaskContext

        chunk, number = Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in slices(batch):
                chunk.add(ids, texts)
                if chunk.full():
                    yield from _rows(chunk, number, parts)
                    chunk, number = Chunk(), number + 1
        if chunk.texts:
            yield from _rows(chunk, number, parts)

    return task


def _encode(path: str):
    def task(batches):
        tokenizer, known = _tokenizer(path), {}
        for batch in batches:
            for x in batch.to_pylist():
                words = zstandard.decompress(x["data"]).decode().split("\n")
                if len(known) > KNOWN_WORDS:
                    known.clear()
                if new := [w for w in words if w not in known]:
                    known.update(zip(new, (np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(new, add_special_tokens=False))))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), dtype="<u4", count=len(ids)) // 4
                yield _batch([(x["chunk"], WORDS, x["part"], None, pack(np.r_[np.array([len(ids)], dtype="<u4"), sizes, np.frombuffer(b"".join(ids), dtype="<u4")]))])

    return task


def _place(texts: pa.Table, lists: pa.Table) -> pa.Table:
    """Of one chunk: the ids of each text, from its words' numbers and the lists' ids."""
    by_part = dict(zip(lists["part"].to_pylist(), map(unpack, lists["data"].to_pylist())))
    each = [by_part[p] for p in sorted(by_part)]
    none = np.empty(0, dtype="<u4")
    sizes = np.concatenate([none, *(x[1 : x[0] + 1] for x in each)]).astype(np.int64)
    pool = np.concatenate([none, *(x[x[0] + 1 :] for x in each)])
    rows = list(zip(texts["kind"].to_pylist(), texts["doc_ids"].to_pylist(), texts["data"].to_pylist()))
    # a word's place in the lists, end to end
    place = np.empty(len(sizes), dtype=np.int64)
    place[np.argsort(np.concatenate([none, *(unpack(d) for kind, _, d in rows if kind == PARTS)]), kind="stable")] = np.arange(len(sizes))
    ids, out = [], []
    for kind, doc_ids, data in rows:
        if kind == TEXT:
            numbers, n = unpack(data), len(doc_ids)
            cuts = np.r_[0, np.cumsum(numbers[:n])]
            if cuts[-1]:
                found, ends = _gather(pool, sizes, place[numbers[n:]])
                cuts = np.r_[0, ends][cuts]
                raw = found.tobytes()
            ids += doc_ids
            out += [raw[4 * x : 4 * y] if y > x else b"" for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
    return pa.table([pa.array(ids, pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row of docs (doc_id, text, others
    ignored), as the tokenizers library encodes the whole text without adding special tokens; strings of added tokens
    in a text are these tokens, as there. For vocabularies that drop white space and lower letters.

    Null and empty texts have no ids; null ids and rows that share a doc_id are documents of their own; an empty
    table gives an empty one. A text or a word of any length stays whole.
    """
    spark = docs.sparkSession
    common.long_texts(spark)
    path, n = vocab or word_vocabulary(), common.width(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # written, so that lists and numbers are of the same run of a task
    coded = common.written(rows.mapInArrow(common.tidy(_split(4 * n)), CODED), "word-numbers")
    ids = coded.where(F.col("kind") == WORDS).repartition(n, "part").mapInArrow(common.tidy(_encode(path)), CODED)
    texts = coded.where(F.col("kind") != WORDS).select("chunk", "kind", "doc_ids", "data")
    return texts.groupBy("chunk").cogroup(ids.select("chunk", "part", "data").groupBy("chunk")).applyInArrow(_place, ENCODED)


@lru_cache(maxsize=4)
def _pieces(path: str) -> pa.Array:
    """The piece of each id of a vocabulary (null: none)."""
    vocabulary_ = _tokenizer(path).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocabulary_.values()) + 1)
    for piece, k in vocabulary_.items():
        out[k] = piece
    return pa.array(out, pa.string())


def decode(encoded: DataFrame, vocab: str | None = None) -> DataFrame:
    """encoded (doc_id, n_tokens, ids, as encode gives them) with text: the pieces of the ids, special tokens too, joined by a
    space, as the library does for vocabularies without a decoder (others are left to the library). Ids that
    the vocabulary doesn't have are left out; no or null ids give an empty text."""
    path = vocab or word_vocabulary()

    def task(batches):
        pieces, plain = _pieces(path), _tokenizer(path).decoder is None
        for batch in batches:
            texts = []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_py() or b"", dtype="<u4")
                ids = ids[ids < len(pieces)]
                if not plain:
                    texts.append(_tokenizer(path).decode(ids.tolist(), skip_special_tokens=False))
                    continue
                found = pieces.take(pa.array(ids)).drop_null()
                texts.append(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found), " ")[0].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(common.tidy(task), ENCODED + ", text string")


def op12_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: n_tokens, digests of its ids and of the text that they decode to."""
    found = decode(encode(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
