"""Mixing sources to target weights by balanced sampling (the cube method).

Sources get shares of the mix by weight; a source that would be used more than ``cap`` times
stops there and its excess is reshared. Every document of a source then has the same
multiplicity, target / size of the source: its whole part is taken as copies, its fraction is
an inclusion probability. The cube method settles these fractions: in blocks of documents,
probabilities move along the null space of the constraints (words and documents stay as
expected) until at most two in a block lie strictly between 0 and 1; what is left of many
blocks forms the next level's blocks; the last few of a source land.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: weights by rank, the mix's size, the most often a source is used.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
#: Units kept out of a source's last flight for its landing.
LANDING = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """rows with rank, from 0, by a column (null last). Rows are dealt out by range, counted there, and numbered after what lies in
    the ranges before: one row a range is all that meets in one place."""
    spread = rows.repartitionByRange(common.width(rows.sparkSession), F.col(by).asc_nulls_last())
    spread = common.written(spread.withColumn("range", F.spark_partition_id()), "ranges")
    counts = spread.groupBy("range").agg(F.count(F.lit(1)).alias("held"))
    before = counts.select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("range").orderBy(F.col(by).asc_nulls_last())
    return spread.join(common.small(before), "range").withColumn("rank", F.col("before") + F.row_number().over(order) - 1).drop("range", "before")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row a source: source, sid (rank by code point, null last), n, source_size, target.

    Sources whose share at the level reached so far exceeds their cap stop there, and the level rises for the rest, until none
    is above its cap any more; each round is one sum over the sources."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rows = ranked(rows, "source").withColumnRenamed("rank", "sid")
    rows = common.written(rows.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("sid") % len(weights) + 1).cast("int"))), "source-weights")
    total = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return rows.select("source", "sid", "n", "source_size", F.lit(0.0).alias("target"))
    budget, stopped, level = total["size"] * share, 0, total["size"] * share / total["weight"]
    most = F.lit(cap) * F.col("source_size")
    while level is not None:
        over = F.lit(level) * F.col("weight") > most
        now = rows.agg(F.count_if(over).alias("stopped"), F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if now["stopped"] == stopped:
            break
        stopped, level = now["stopped"], (budget - cap * now["size"]) / now["weight"] if now["weight"] else None
    target = most if level is None else F.least(F.lit(level) * F.col("weight"), most)
    return rows.select("source", "sid", "n", "source_size", target.cast("double").alias("target"))


def settle(sizes: np.ndarray, pi: np.ndarray, draw: np.random.Generator, land: bool) -> np.ndarray:
    """Flight over one block: at most two probabilities stay fractional. With land, the first
    LANDING units stay out of the flight; together with what it leaves they form the landing
    problem, settled by the choice whose words (then documents) are nearest to what is expected."""
    pi, eps = pi.copy(), 1e-9
    todo = [k for k in range(len(pi)) if eps < pi[k] < 1 - eps]
    held, todo = (todo[:LANDING], todo[LANDING:]) if land else ([], todo)
    draws = draw.random(len(todo) + 1)
    at = used = 0
    active: list[int] = []
    while True:
        while len(active) < 3 and at < len(todo):
            active.append(todo[at])
            at += 1
        if len(active) < 3:
            break
        a, b, c = (float(sizes[k]) for k in active)
        move = [b - c, c - a, a - b]  # orthogonal to the sizes and to (1, 1, 1)
        longest = max(map(abs, move))
        move = [x / longest for x in move] if longest else [1.0, -1.0, 0.0]
        up = down = np.inf
        for k, u in zip(active, move):
            if u > 0:
                up, down = min(up, (1 - pi[k]) / u), min(down, pi[k] / u)
            elif u < 0:
                up, down = min(up, pi[k] / -u), min(down, (1 - pi[k]) / -u)
        by = up if draws[used] * (up + down) < down else -down
        used += 1
        for k, u in zip(active, move):
            pi[k] += by * u
            if pi[k] <= eps or pi[k] >= 1 - eps:
                pi[k] = round(pi[k])
        active = [k for k in active if 0 < pi[k] < 1]
    if land and (last := active + held):
        choices = (np.arange(1 << len(last))[:, None] >> np.arange(len(last)) & 1).astype(float)
        off = choices - pi[last]
        cost = np.abs(off @ sizes[last]) / max(1.0, float(np.mean(sizes[last]))) + 0.01 * np.abs(off.sum(axis=1))
        pi[last] = choices[int(np.argmin(cost))]
    return pi


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Every row of docs (doc_id, text, source; others ignored) as doc_id, size, source_size,
    target, taken. Null text has size 0; null is a source of its own, ranked last; repeated rows
    are units of their own; a source without words takes nothing; no rows give no rows. The draw
    depends on the rows and the seed alone, not on how the rows are dealt out."""
    spark = docs.sparkSession
    sized = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    sources = common.written(source_targets(sized, weights, share, cap), "sources")
    biggest = sources.agg(F.max("n")).first()[0] or 0
    side = common.small(sources.withColumnRenamed("source", "of"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        sized.join(side, sized["source"].eqNullSafe(side["of"]))
        .select("doc_id", "size", "sid", "n", F.floor(times).cast("long").alias("copies"), (times - F.floor(times)).alias("pi"), F.xxhash64("doc_id", "size", F.lit(seed)).alias("h"))
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
        .withColumn("block", F.pmod("h", "blocks"))
    )

    def flight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable", na_position="first")
        first = pdf.iloc[0]
        draw = np.random.Generator(np.random.Philox(key=[seed, int(first["level"]) << 40 ^ int(first["sid"])], counter=[int(first["block"]), 0, 0, 0]))
        return pdf.assign(pi=settle(pdf["size"].to_numpy(float), pdf["pi"].to_numpy(float), draw, bool(first["blocks"] == 1)))

    done, level = None, 0
    while True:
        flown = units.withColumn("level", F.lit(level)).groupBy("sid", "block").applyInPandas(flight, units.withColumn("level", F.lit(level)).schema)
        flown = common.written(flown, f"flight-{level}").drop("level")
        settled = flown.where("pi <= 0 or pi >= 1")
        done = settled if done is None else done.unionByName(settled)
        biggest = -(-biggest // block)
        if biggest <= 1:
            break
        # at most two of a block are left, so block / 2 blocks make one of the next level
        units = flown.where("pi > 0 and pi < 1").withColumn("block", F.floor(F.col("block") / (block // 2)).cast("long")).withColumn("blocks", F.ceil(F.col("blocks") / (block // 2)).cast("long"))
        biggest, level = biggest * 2, level + 1
    taken = (F.col("size") * (F.col("copies") + F.col("pi").cast("long"))).cast("long").alias("taken")
    totals = common.small(sources.select("sid", "source_size", "target"))
    return done.join(totals, "sid").select("doc_id", "size", "source_size", "target", taken)


def op5_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
