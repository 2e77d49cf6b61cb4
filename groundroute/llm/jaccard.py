"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents with equal shingle sets are one class. Class representatives get MinHash values and
meet in bands: two in a bucket are a candidate pair, more are linked to the bucket's ends.
Candidates fall into groups (large ones are formed again from pairs that outlast the pruning); within a group (or, for a large one, between its blocks) pairs
compare their MinHash values 16 at a time and are dropped once the posterior probability that
their similarity reaches the threshold is below the tolerance. The rest are verified exactly.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .words import WordHashes, rolling

WORDS, THRESHOLD = 5, 0.8
VALUES, ROWS, STEP, TOLERANCE = 128, 4, 16, 1e-9
#: Documents of a block of a large group; small groups dealt to one task at a time.
BLOCK, TOGETHER = 128, 1024
#: Documents of a bucket that are compared at once, and rows of buckets dealt to one task.
CELL, DEALT = 2048, 50_000
NO_ID = -(1 << 63)

_hashes = common.cache(WordHashes())
_multipliers = np.random.Generator(np.random.Philox(key=[20, 5])).integers(1, 1 << 31, size=(2, VALUES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of runs of so many words; a shorter text is one run; no words, none."""
    found = text.split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = _hashes.of(found)
    return np.unique(rolling(h, min(words, len(found))))


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES min-wise values (uint16) of a shingle set."""
    low = (s ^ s >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 4096):
        x = low[at : at + 4096, None] * _multipliers[0]
        x ^= x >> np.uint32(15)
        x *= _multipliers[1]
        np.minimum(best, x.min(axis=0), out=best)
    return (best ^ best >> np.uint32(16)).astype("<u2")


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest matches to go on): under a flat prior the posterior probability
    of similarity >= t after m of n matches is P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of two signature matrices outlast the incremental comparison."""
    alive = np.ones((len(a), len(b)), dtype=bool)
    matches = np.zeros(alive.shape, dtype=np.int16)
    for n, least in least_matches(threshold):
        for k in range(n - STEP, n):
            matches += a[:, k, None] == b[None, :, k]
        alive &= matches >= least
        if not alive.any():
            break
    return alive


def verified(a: list[np.ndarray], b: list[np.ndarray], alive: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) among alive whose exact Jaccard similarity reaches the threshold."""
    i, j = np.nonzero(alive)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    if len(i):  # sizes alone exclude some
        fits = np.minimum(na[i], nb[j]) >= threshold * np.maximum(na[i], nb[j]) - 1e-9
        i, j = i[fits], j[fits]
    if len(i) > 4 * (len(a) + len(b)):
        ia, ib = np.unique(i), np.unique(j)
        terms = np.unique(np.concatenate([*(a[k] for k in ia), *(b[k] for k in ib)]))
        both = np.zeros((len(a), len(b)), dtype=np.float32)
        for at in range(0, len(terms), 8192):
            part = terms[at : at + 8192]
            mats = []
            for sets, rows in ((a, ia), (b, ib)):
                mat = np.zeros((len(sets), len(part)), dtype=np.float32)
                for k in rows:
                    lo, hi = np.searchsorted(sets[k], (part[0], part[-1]))
                    own = sets[k][lo : hi + 1]
                    at_ = np.searchsorted(part, own)
                    ok = at_ < len(part)
                    ok[ok] = part[at_[ok]] == own[ok]
                    mat[k, at_[ok]] = 1
                mats.append(mat)
            both += mats[0] @ mats[1].T
        shared = both[i, j].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], dtype=np.int64)
    ok = shared >= threshold * (na[i] + nb[j] - shared) - 1e-9
    return i[ok], j[ok]


def signatures(docs: DataFrame) -> DataFrame:
    """Of docs (key, text as bytes): key, set_id (128-bit identity of the shingle set, binary; null
    without words), sig."""

    def rows(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py())
                out.append((key, xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (key, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["key", "set_id", "sig"])

    return docs.select("key", "text").mapInArrow(common.tidy(rows), "key long, set_id binary, sig binary")


def bands(reps: DataFrame) -> DataFrame:
    """node, bucket (64 bits over the band's number and values)."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(batch.num_rows, VALUES // ROWS)
            bucket = sig + np.arange(1, sig.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bucket ^= bucket >> np.uint64(31)
            bucket *= np.uint64(0xBF58476D1CE4E5B9)
            bucket ^= bucket >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sig.shape[1])), pa.array(bucket.view(np.int64).ravel())], names=["node", "bucket"])

    return reps.select("node", "sig").mapInArrow(rows, "node long, bucket long")


def candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """a, b: candidate pairs of two-document buckets that outlast the pruning, and for larger
    buckets every member with the bucket's smallest and largest."""
    met = bands(reps)
    buckets = common.written(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1 and low < high"), "buckets")
    pairs = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
    sigs = reps.select("node", "sig")
    pairs = pairs.join(sigs.withColumnsRenamed({"node": "a", "sig": "x"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "y"}), "b")

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(batch.num_rows, VALUES) for k in (2, 3))
                same, alive = x == y, np.ones(batch.num_rows, dtype=bool)
                for n, least in least_matches(threshold):
                    alive &= same[:, :n].sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(alive))

    kept = pairs.select("a", "b", "x", "y").mapInArrow(prune, "a long, b long")
    stars = met.join(common.small(buckets.where("n > 2").select("bucket", "low", "high")), "bucket")
    return kept.unionByName(stars.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct())


def _pruned_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of buckets (bucket, node, sig) whole: a, b that join what outlasts the pruning within each bucket."""
    pdf = pdf.sort_values(["bucket", "node"])
    node, cuts = pdf["node"].to_numpy(), np.flatnonzero(np.r_[True, np.diff(pdf["bucket"].to_numpy()) != 0])
    sig, out = np.vstack([np.frombuffer(x, dtype="<u2") for x in pdf["sig"]]), set()
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pdf)]):
        free = np.arange(x, y)
        while len(free) > 1:  # spread from one member after another over what is alike
            reached, free = free[:1], free[1:]
            while len(reached) and len(free):
                alive = surviving(sig[reached], sig[free], threshold)
                near = alive.any(axis=0)
                out.update(zip(node[free[near]].tolist(), node[reached[alive.argmax(axis=0)[near]]].tolist()))
                reached, free = free[near], free[~near]
    return pd.DataFrame(sorted(out), columns=["a", "b"]).astype("int64")


def refined_edges(reps: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """a, b among reps (node, sig): candidates that outlast the pruning within their buckets. Buckets of more than cell documents keep
    their links to smallest and largest member; they are compared all the same, later."""
    met = bands(reps)
    counted = common.written(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1 and low < high"), "cells")
    stars = met.join(common.small(counted.where(F.col("n") > cell).drop("n")), "bucket").select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    rows = counted.where(F.col("n") <= cell).agg(F.sum("n")).first()[0] or 0
    deals = max(common.width(reps.sparkSession), -(-rows // DEALT))
    dealt = met.join(common.small(counted.where(F.col("n") <= cell).select("bucket")), "bucket").join(reps.select("node", "sig"), "node")
    links = dealt.withColumn("unit", F.pmod(F.xxhash64("bucket"), F.lit(deals))).groupBy("unit").applyInPandas(lambda pdf: _pruned_links(pdf, threshold), "a long, b long")
    return links.unionByName(stars)


def candidate_groups(reps: DataFrame, threshold: float) -> DataFrame:
    """node, root: groups that hold every candidate pair. Groups of more than a block are formed again from pairs that outlast
    the pruning, so that texts of one template, which meet in many buckets without being near duplicates, don't stay one group."""
    with_roots = lambda g: g.unionByName(g.select(F.col("root").alias("node"), "root").distinct())
    grouped = common.written(with_roots(components(candidate_edges(reps, threshold))), "grouped")
    sizes = common.written(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK), "large-groups")
    if not sizes.limit(1).count():
        return grouped
    large = common.written(grouped.join(common.small(sizes.select("root")), "root", "left_semi").select("node"), "large-members")
    again = components(refined_edges(reps.join(common.small(large), "node", "left_semi"), threshold))
    return grouped.join(common.small(sizes.select("root")), "root", "left_anti").select("node", "root").unionByName(with_roots(again).select("node", "root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs (doc_id, text; others ignored): doc_id, class_id (smallest doc_id it is
    linked to over any chain of links, its own included), rep_id (smallest doc_id with the same
    shingle set) and n_links (other rows with similarity >= threshold, copies included).

    Words are runs of other than white space, lower-cased. Null and empty texts have no shingle
    and no link: each is its own class. Rows that share a doc_id count each, as copies or not
    by their texts. A null doc_id comes before all others. No rows give no rows."""
    spark = docs.sparkSession
    common.long_texts(spark)
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary").alias("text"))
    sigs = common.written(signatures(keyed), "signatures")
    # a node is a shingle set: its first document's key can stand for several texts if ids repeat, its hash can't
    node = F.xxhash64("set_id")
    reps = common.written(sigs.where("set_id is not null").groupBy("set_id").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig")).withColumn("node", node), "classes")
    grouped = candidate_groups(reps, threshold)
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = common.written(grouped.join(sizes, "root").join(reps.select("node", "rep", "copies", "set_id"), "node"), "members")

    asked = members.select("node", "root", "members", "rep", "copies", F.col("set_id").alias("want"))

    def sets(batches):
        for batch in batches:
            out = []
            for *head, want, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
                s = shingles(text.as_py())
                if xxhash.xxh3_128_digest(s.tobytes()) == want:
                    out.append((*head, signature(s).tobytes(), s.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.binary()] * 2)], names=["node", "root", "members", "copies", "sig", "set"])

    texts = keyed.join(common.small(asked), keyed["key"] == asked["rep"]).select("node", "root", "members", "copies", "want", "text")
    full = texts.mapInArrow(common.tidy(sets), "node long, root long, members long, copies long, sig binary, set binary")
    n_small = members.where(F.col("members") <= BLOCK).count()
    deals = max(common.width(spark), -(-n_small // TOGETHER))
    n_blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    full = full.withColumn("blocks", n_blocks)
    dealt = full.where("blocks = 1").select("*", F.pmod(F.xxhash64("root"), F.lit(deals)).alias("unit"), F.lit(-1).cast("long").alias("t1"), F.lit(-1).cast("long").alias("t2"), F.lit(0).cast("long").alias("own"))
    tiled = full.where("blocks > 1").withColumn("own", own).withColumn("o", other).select(*full.columns, F.col("root").alias("unit"), F.least("own", "o").alias("t1"), F.greatest("own", "o").alias("t2"), "own")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        # rows that repeat a doc_id with one text give a set twice
        pdf = pdf.drop_duplicates("node")
        for _, g in pdf.groupby("root", sort=False):
            t1, t2 = int(g["t1"].iloc[0]), int(g["t2"].iloc[0])
            sides = [g, g] if t1 == t2 else [g[g["own"] == t1], g[g["own"] == t2]]
            if t1 == t2 and len(g) < 2 or not len(sides[0]) or not len(sides[1]):
                continue
            sig = [np.vstack([np.frombuffer(x, dtype="<u2") for x in s["sig"]]) for s in sides]
            alive = surviving(*sig, threshold)
            if t1 == t2:
                alive = np.triu(alive, 1)
            i, j = verified(*([np.frombuffer(x, dtype=np.uint64) for x in s["set"]] for s in sides), alive, threshold)
            if not len(i):
                continue
            a, b = sides[0]["node"].to_numpy()[i], sides[1]["node"].to_numpy()[j]
            ca, cb = sides[0]["copies"].to_numpy()[i], sides[1]["copies"].to_numpy()[j]
            root: dict[int, int] = {}

            def find(x):
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
            count = pd.Series(np.r_[cb, ca]).groupby(np.r_[a, b]).sum()
            out.append(pd.DataFrame({"node": count.index, "to": [find(x) for x in count.index], "links": count.to_numpy(), "tile": max(t1, -1)}))
        return (pd.concat(out) if out else pd.DataFrame({"node": [], "to": [], "links": [], "tile": []})).astype("int64")

    linked = common.written(dealt.unionByName(tiled).groupBy("unit", "t1", "t2").applyInPandas(link, "node long, to long, links long, tile long"), "links")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    # a group that was compared whole has its classes; only what was compared by tiles still has to be put together
    whole, tiles = linked.where("tile < 0"), linked.where("tile >= 0")
    groups = whole.select("node", F.col("to").alias("root")).unionByName(components(tiles.select(F.col("node").alias("a"), F.col("to").alias("b"))))
    named = reps.join(links, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = common.written(named.join(firsts, "root").select("set_id", "class_id", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-classes")
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return (
        sigs.select("key", "set_id").join(classes, "set_id", "left")
        .select(F.col("key").alias("doc_id"), F.coalesce("class_id", "key").alias("class_id"), F.coalesce("rep", "key").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        .select(plain("doc_id"), plain("class_id"), plain("rep_id"), "n_links")
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
