"""Periodic runs of words inside a text, and texts with their repeats collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that
no neighbouring word extends. The words of a text become the letters of a suffix automaton. Its states are visited
from the longest to the shortest and the sets of end positions are merged along the suffix links, the
smaller set into the larger one. A position put between two others gets new neighbours; two neighbours at a distance
d of no more than the state's length L are a seed: a square of period d ends at the later one. As both meet in this
state first, L is their longest common suffix, so the run begins L - 1 words before the earlier one. A seed
whose two next words are alike is a word further on once more; one whose next words differ ends its run.

Only stretches of words that lie in repeated windows go into the automaton: a run of at least ``least`` words and
``times`` periods begins and ends with the same least * (1 - 1 / times) words and is covered by such windows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import div
from . import common
from .words import WordHashes, rolling

#: Words and periods of a run at least.
LEAST, TIMES = 24, 3
#: End positions in a block of an ordered set.
BLOCK = 1024

RUNS = "array<struct<start: long, length: long, period: long>>"
#: Of words met, in a worker.
_hashes = common.cache(WordHashes())
_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


class Ends:
    """An ordered set of end positions: sorted blocks, so that adding moves a block at most."""

    __slots__ = ("blocks", "heads", "n")

    def __init__(self, position: int):
        self.blocks, self.heads, self.n = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """The neighbours of x once it is in: the position before and the one after (-1 for none)."""
        blocks = self.blocks
        b = max(bisect_right(self.heads, x) - 1, 0)
        block = blocks[b]
        k = bisect_right(block, x)
        before = block[k - 1] if k else blocks[b - 1][-1] if b else -1
        after = block[k] if k < len(block) else blocks[b + 1][0] if b + 1 < len(blocks) else -1
        block.insert(k, x)
        self.heads[b] = block[0]
        self.n += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks.insert(b + 1, block[half:])
            self.heads.insert(b + 1, block[half])
            del block[half:]
        return before, after


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a word: suffix link, length and first end position (-1: a split state) of each state."""
    link, length, end, to = [-1], [0], [-1], [{}]
    last = 0
    for at, c in enumerate(word):
        new = len(link)
        link.append(0)
        length.append(at + 1)
        end.append(at)
        to.append({})
        state = last
        while state >= 0 and c not in to[state]:
            to[state][c] = new
            state = link[state]
        if state >= 0:
            met = to[state][c]
            if length[met] == length[state] + 1:
                link[new] = met
            else:
                split = len(link)
                link.append(link[met])
                length.append(length[state] + 1)
                end.append(-1)
                to.append(to[met].copy())
                while state >= 0 and to[state].get(c) == met:
                    to[state][c] = split
                    state = link[state]
                link[met] = link[new] = split
        last = new
    return link, length, end


def runs_of(word: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word, by start, then period."""
    link, length, end = automaton(word)
    found: dict[tuple[int, int], int] = {}
    n = len(word)

    def merged(held: Ends | None, own: Ends, common_: int) -> Ends:
        """Both sets of a state whose strings are so long; runs that end at new neighbours are found."""
        if held is None:
            return own
        if held.n < own.n:
            held, own = own, held
        last = -1
        for x in own:
            before, after = held.add(x)
            if before == last:
                before = -1  # both of the smaller set: they met in a longer state
            last = x
            for a, b in ((before, x), (x, after)):
                d = b - a
                if a >= 0 and 0 < d <= common_ and common_ + d >= least and common_ >= (times - 1) * d and (b + 1 == n or word[a + 1] != word[b + 1]):
                    key = (a - common_ + 1, b)
                    found[key] = min(d, found.get(key, d))
        return held

    sets: dict[int, Ends] = {}
    for state in np.argsort(np.array(length), kind="stable")[:0:-1].tolist():  # but for the root, whose string is empty
        held = sets.pop(state, None)
        if end[state] >= 0:
            held = merged(held, Ends(end[state]), length[state])
        if link[state] > 0:
            sets[link[state]] = merged(sets.get(link[state]), held, length[link[state]])
    return sorted((a, b - a + 1, d) for (a, b), d in found.items())


def _stretches(hashes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(first, end) of the stretches of words that lie in a window met more than once in the text."""
    at = rolling(hashes, window)
    order = np.argsort(at, kind="stable")
    alike = at[order[1:]] == at[order[:-1]]
    if not alike.any():
        return []
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    again = np.unique(np.r_[order[1:][alike], order[:-1][alike]])
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    inside = np.r_[0, np.cumsum(step) > 0, 0].astype(np.int8)
    turns = np.flatnonzero(np.diff(inside))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def find_runs(hashes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, given as a number for each word."""
    out: list[tuple[int, int, int]] = []
    for first, last in _stretches(hashes, least - least // times):
        letters = np.unique(hashes[first:last], return_inverse=True)[1].tolist()
        out += [(first + a, n, d) for a, n, d in runs_of(letters, least, times)]
    return out


def collapse(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and text of every row of docs (doc_id, text,
    others ignored): in text, its words joined by one space, words that any run holds after its first period are left out.

    Words are runs of other than ASCII white space, unchanged, numbered from 0. Null and empty texts have no word and
    no run; rows that share a doc_id, and null ids, are documents of their own. No shuffle: a text is looked at
    where it is, and a task holds one batch of texts and the automaton of one stretch.
    """
    common.long_texts(docs.sparkSession)

    def task(batches):
        for batch in batches:
            found, texts, counts = [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                words = (raw.as_py() or b"").split()
                runs = find_runs(_hashes.of(words), least, times) if len(words) >= least else []
                counts.append(len(words))
                if runs:
                    keep = np.ones(len(words), dtype=bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                found.append([{"start": a, "length": n, "period": d} for a, n, d in runs])
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _RUN), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidy(task), f"doc_id long, n_words long, runs {RUNS}, text string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equal ones the first. Null without runs."""
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, x: F.when(more(best, x), x).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; about one text in ten repeats, from a word on, the words that begin there. Which one, from where
    and with which period follows from the checksum of its doc_id (null ids: none)."""
    mark = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when(mark % 10 == 0, F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.floor(mark / 10).alias("g"), words.alias("w"))
    n = F.nullif(F.size("w"), F.lit(0))
    at = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - at) / (3 + F.col("g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", at + 1, period), F.ceil((n - at) / period).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), at), F.slice(again, F.lit(1), n - at)), " ")
    return cut.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: n_runs, its strongest run, digests of all runs and of the collapsed text."""
    found = collapse(with_planted_runs(common.table(spark, sf_dir, "documents")))
    line = lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", div(F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
