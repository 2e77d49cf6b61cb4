"""Text to token ids with a public vocabulary file, at the speed of a dictionary.

Byte-level BPE splits a text at white space before it merges, so a chunk from one single
space or line break to the next is encoded alone. Each worker keeps the ids of the words it
has met; texts whose white space is less regular go to the tokenizer whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker keeps of words met and their ids, about; and what an entry costs beside its characters and ids.
CACHE_BYTES, ENTRY = 64 << 20, 250
#: New words that are encoded as one text, a line each.
TOGETHER = 100
#: Punctuation that is split off a word before it is encoded.
PUNCTUATION = ".,;:!?*%&$#"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """plain_specials: strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}
        self.held = 0
        line = self.tokenizer.encode("a\na", add_special_tokens=False).ids
        self.line = line[1] if len(line) == 3 else None
        self.newline = np.array([self.line or 0], dtype=self.dtype).tobytes()

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, chunks: list[str]) -> list[bytes]:
        """The ids of words (one leading space at most, no line break): many are encoded as the
        lines of one text, which the id of a line break parts again."""
        out: list[bytes] = []
        packs = [chunks[k : k + TOGETHER] for k in range(0, len(chunks), TOGETHER)]
        for pack, e in zip(packs, self.tokenizer.encode_batch_fast(["\n".join(p) for p in packs], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            ends = np.flatnonzero(ids == self.line)
            if self.line is None or len(ends) != len(pack) - 1:
                out += self._ids(pack)
                continue
            raw, item = ids.tobytes(), self.dtype.itemsize
            starts = [0, *((ends + 1) * item).tolist()]
            out += [raw[x:y] for x, y in zip(starts, [*(ends * item).tolist(), len(raw)])]
        return out

    def _learn(self, new: list[str]) -> None:
        """new: words, with the space that stands before them, if one does."""
        self.held += sum(map(len, new)) * 2 + ENTRY * len(new)
        plain = [w for w in new if "<|" not in w]
        self.known.update(zip(plain, self._lines(plain)))
        if len(plain) < len(new):
            odd = [w for w in new if "<|" in w]
            self.known.update(zip(odd, self._ids(odd)))

    def _pieces(self, names: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Of distinct chunks: the ids of the pieces they are made of, and the numbers of each chunk's
        three pieces. Letters end where punctuation begins, so a word and its closing punctuation
        are encoded alone; a line break is a piece of its own too."""
        bare = pc.starts_with(names, "\n")
        body = pc.utf8_ltrim(names, "\n")
        word = pc.utf8_rtrim(body, PUNCTUATION)
        word = pc.if_else(pc.utf8_is_alpha(word), word, body)
        coded = pc.binary_join_element_wise(pc.if_else(bare, "", " "), word, "").dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        n_tail = pc.subtract(pc.binary_length(body), pc.binary_length(word)).to_numpy()
        tailed = np.flatnonzero(n_tail)
        ends = [c[-n:] for c, n in zip(body.take(pa.array(tailed)).to_numpy(zero_copy_only=False).tolist(), n_tail[tailed].tolist())]
        tails = {t: k for k, t in enumerate(dict.fromkeys(ends))}
        for t in tails:
            if t not in self.tail:
                self.tail[t] = self._ids([t])[0]
                self.held += 2 * len(t) + ENTRY
        parts = [b"", self.newline, *map(self.known.__getitem__, words), *map(self.tail.__getitem__, tails)]
        place = np.zeros((len(names), 3), dtype=np.int64)
        place[:, 0] = bare.to_numpy(zero_copy_only=False)
        place[:, 1] = coded.indices.to_numpy() + 2
        place[tailed, 2] = np.fromiter(map(tails.__getitem__, ends), dtype=np.int64, count=len(ends)) + 2 + len(words)
        return parts, place

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        if self.held > self.limit:
            self.known.clear()
            self.tail.clear()
            self.held = 0
        out: list[bytes] = [b""] * len(texts)
        whole, regular, lines = [], [], []
        for n, text in enumerate(texts):
            if not text:
                continue
            if self.line is None or "\u180e" in text or " ".join(text.split()) != text.replace("\n", " "):
                whole.append(n)  # white space other than single inner spaces and line breaks
            else:
                regular.append(n)
                lines.append("\n" + text.replace("\n", " \n"))  # the first word begins a line
        if regular:
            chunks = pc.split_pattern(pa.array(lines), " ")
            at, coded = chunks.offsets.to_numpy(), chunks.flatten().dictionary_encode()
            parts, place = self._pieces(coded.dictionary)
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // self.dtype.itemsize
            pool, ends = _gather(np.frombuffer(b"".join(parts), dtype=self.dtype), sizes, place.ravel())
            ids, ends = _gather(pool, np.diff(ends[2::3], prepend=0), coded.indices.to_numpy())
            raw, item = ids.tobytes(), self.dtype.itemsize
            cuts = (np.r_[0, ends][at] * item).tolist()
            for n, x, y in zip(regular, cuts, cuts[1:]):
                out[n] = raw[x + item : y]
        if whole:
            for n, ids in zip(whole, self._ids([texts[n] for n in whole])):
                out[n] = ids
        return out


def _gather(pool: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pool (of the given sizes, one after another) in the order of place, and where each ends."""
    n = sizes[place]
    ends = np.cumsum(n)
    return pool[np.repeat((np.cumsum(sizes) - sizes)[place] - (ends - n), n) + np.arange(int(ends[-1]))], ends


@lru_cache(maxsize=4)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One for each worker process, so that its cache lasts over tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, plain_specials)


def slices(batch, characters: int = 2_000_000):
    """Runs of rows of an Arrow batch (doc_id, text, …) of about so many characters: (doc ids, texts)."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        t = t.as_py() or ""
        ids.append(i)
        texts.append(t)
        size += len(t)
        if size >= characters:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
