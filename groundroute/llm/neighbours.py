"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 with one scale a row and packed into blocks. A tile is one block
of queries against one block of candidates: one int8 product gives all distances with bounds
on the quantisation error; pairs whose lower bound exceeds the k-th smallest upper bound so
far can't be among the k nearest; the rest are computed again from the original vectors in
double precision and merged into the queries' heaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

QUERY_BLOCK, BLOCK, K = 1024, 8192, 10
#: Rows of a band of queries and of a group of candidates: what one task holds.
BAND_ROWS, GROUP_ROWS = 16_384, 262_144
FOUND = "query_id long, tag long, vec_id long, score double"
PACKED = "dim int, block long, ids binary, tags binary, vectors binary"


def component(*vectors: DataFrame) -> str:
    """The type to hold components in: float, or double where a side has anything but floats."""
    return "float" if all(isinstance(v.schema["embedding"].dataType, T.ArrayType) and isinstance(v.schema["embedding"].dataType.elementType, T.FloatType) for v in vectors) else "double"


def usable(vectors: DataFrame, kind: str = "float") -> DataFrame:
    """Rows with an id and a vector that is neither null nor zero, all of whose components are finite; tag: a hash of both."""
    v = F.col("embedding").cast(f"array<{kind}>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    return good.withColumn("tag", F.xxhash64("vec_id", "embedding"))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the vector, norm of its quantised form, norm of the residue."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt((x * x).sum(1)), np.sqrt((back * back).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows: sums of at most 127² a component fit a float32 up to 1,040 components."""
    kind = np.float32 if a.shape[1] <= 1000 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.float64)


class Heaps:
    """The k nearest of each query so far: by distance, then id."""

    def __init__(self, query_ids: np.ndarray, tags: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.tags, self.x, self.k = query_ids, tags, queries.astype(np.float64), k
        self.q = quantise(queries)
        self.best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        self.limit = np.full(len(query_ids), np.inf)

    def tile(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        qc, qs, qn, qh, qe = self.q
        cc, cs, cn, ch, ce = quantise(vectors)
        dots = _product(qc, cc) * qs[:, None] * cs[None, :]
        error = qe[:, None] * ch[None, :] + qh[:, None] * ce[None, :] + qe[:, None] * ce[None, :]
        square = qn[:, None] ** 2 + cn[None, :] ** 2 - 2 * dots
        slack = 1e-9 * (qn[:, None] ** 2 + cn[None, :] ** 2)
        upper, lower = square + 2 * error + slack, square - 2 * error - slack
        own = self.ids[:, None] == ids[None, :]
        upper[own] = np.inf
        n = min(self.k, upper.shape[1]) - 1
        bound = np.minimum(np.partition(upper, n, axis=1)[:, n] if upper.shape[1] >= self.k else np.inf, self.limit)
        for r, c in zip(*_rows((lower <= bound[:, None]) & ~own)):
            d = np.sqrt(((self.x[r] - vectors[c].astype(np.float64)) ** 2).sum(1))
            merged = self.best[r] + list(zip(d.tolist(), ids[c].tolist()))
            self.best[r] = sorted(merged)[: self.k]
            if len(self.best[r]) == self.k:
                self.limit[r] = self.best[r][-1][0] ** 2 * (1 + 1e-9)

    def rows(self) -> pd.DataFrame:
        flat = [(int(q), int(t), i, d) for q, t, best in zip(self.ids, self.tags, self.best) for d, i in best]
        return pd.DataFrame(flat, columns=NAMES).astype(dict.fromkeys(NAMES, "int64") | {"score": "float64"})


NAMES = ["query_id", "tag", "vec_id", "score"]


def _rows(mask: np.ndarray):
    r = np.flatnonzero(mask.any(axis=1))
    return r, [np.flatnonzero(mask[k]) for k in r]


def pack(vectors: DataFrame, size: int, keep: int | None, kind: str = "float") -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension, made where the rows lie. keep: of
    identical vectors in a block only so many smallest ids (no query can use more of them)."""
    kept_as = np.dtype("<f4" if kind == "float" else "<f8")

    def blocks(batches):
        part, n, held = TaskContext.get().partitionId(), 0, {}

        def made(dim, ids, tags, x):
            nonlocal n
            x, ids, tags = np.vstack(x), np.concatenate(ids), np.concatenate(tags)
            if keep is not None:
                order = np.argsort(ids, kind="stable")
                x, ids, tags = x[order], ids[order], tags[order]
                _, same = np.unique(x.view(f"V{kept_as.itemsize * dim}").ravel(), return_inverse=True)
                by = np.argsort(same, kind="stable")
                first = np.r_[True, same[by][1:] != same[by][:-1]]
                rank = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
                kept = np.sort(by[rank < keep])
                x, ids, tags = x[kept], ids[kept], tags[kept]
            n += 1
            return pa.RecordBatch.from_pylist([{"dim": dim, "block": (part << 32) + n, "ids": ids.astype("<i8").tobytes(), "tags": tags.astype("<i8").tobytes(), "vectors": x.tobytes()}], schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "tags", "vectors"))]))

        for batch in batches:
            ids, tags, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            dims = np.diff(column.offsets.to_numpy())
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
            for dim in np.unique(dims):
                where = np.flatnonzero(dims == dim)
                x = flat[(at[where][:, None] + np.arange(dim)[None, :]).ravel()].reshape(-1, dim)
                x = np.ascontiguousarray(x + kept_as.type(0), dtype=kept_as)  # -0 and 0 are one value
                for k in range(0, len(where), size):
                    mine = held.setdefault(int(dim), [[], [], [], 0])
                    for column_, values in zip(mine, (ids[where[k : k + size]], tags[where[k : k + size]], x[k : k + size])):
                        column_.append(values)
                    mine[3] += len(mine[0][-1])
                    if mine[3] >= size:
                        yield made(int(dim), *mine[:3])
                        del held[int(dim)]
        for dim, (*columns, _) in held.items():
            yield made(dim, *columns)

    return vectors.select("vec_id", "tag", "embedding").mapInArrow(blocks, PACKED)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """The k nearest candidates (all, if fewer) of each query by Euclidean distance, exactly:
    query_id, rank, vec_id, score; ties go to the smaller id. Both sides have vec_id and
    embedding (others ignored); a query's own id is no candidate of it. Unusable vectors take
    no part, and vectors are compared only with those of their own length. A query row that repeats an id and its vector
    gets the same neighbours again; rows of one id with different vectors are different queries, each with ranks from 1.
    Of repeated candidate rows each counts. Empty tables give no rows.

    Bands of query blocks meet groups of candidate blocks; each pair of them is one task's group,
    of bounded size on both sides, and gives a query k rows at most."""
    spark = queries.sparkSession
    kind = component(queries, candidates)
    asked = usable(queries, kind)
    q = common.written(pack(asked.dropDuplicates(["vec_id", "embedding"]), query_block, None, kind), "query-blocks")
    c = common.written(pack(usable(candidates, kind), block, k + 1, kind), "candidate-blocks")
    rows = lambda packed: packed.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    bands = max(1, -(-int(rows(q)) // BAND_ROWS))
    groups = max(common.width(spark) // bands, -(-int(rows(c)) // GROUP_ROWS), 1)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = q.select("dim", "ids", "tags", "vectors", of(bands).alias("band"), numbers(groups).alias("group"))
    right = c.select("dim", "ids", "vectors", numbers(bands).alias("band"), of(groups).alias("group"))

    def tiles(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        array = lambda x: np.frombuffer(x, dtype="<f4" if kind == "float" else "<f8").reshape(-1, dim)
        out = []
        if len(left) and len(right):
            ids, tags = (np.concatenate([np.frombuffer(b, dtype="<i8") for b in left[c]]) for c in ("ids", "tags"))
            x = np.vstack([array(b) for b in left["vectors"]])
            for at in range(0, len(ids), query_block):
                heaps = Heaps(ids[at : at + query_block], tags[at : at + query_block], x[at : at + query_block], k)
                for b, v in zip(right["ids"], right["vectors"]):
                    heaps.tile(np.frombuffer(b, dtype="<i8"), array(v))
                out.append(heaps.rows())
        return pd.concat(out) if out else pd.DataFrame(columns=NAMES).astype(dict.fromkeys(NAMES, "int64") | {"score": "float64"})

    found = left.groupBy("dim", "band", "group").cogroup(right.groupBy("dim", "band", "group")).applyInPandas(tiles, FOUND)
    order = Window.partitionBy("query_id", "tag").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    again = common.written(asked.groupBy("vec_id", "tag").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1"), "repeated-queries")
    copies = ranked.join(common.small(again.select(F.col("vec_id").alias("query_id"), "tag", "times")), ["query_id", "tag"], "left")
    return copies.select("query_id", "rank", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.coalesce("times", F.lit(1)))).alias("copy")).drop("copy")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors)
