"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the component's smallest node) for every node of edges (a, b: long) that is no
    root itself. Loops, repeated and reversed edges don't matter. Every round is written to the
    shared folder, where it takes the last one's place; ends when a round changes nothing."""
    kept = common.rounds(edges.sparkSession, "stars")
    now = kept.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    if not now.limit(1).count():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        after = kept.write(_small(_large(now).distinct()).distinct())
        sums = after.agg(F.count(F.lit(1)), F.expr("sum(cast(a as decimal(38,0)))"), F.expr("sum(cast(b as decimal(38,0)))")).first()
        if sums == state:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, state = after, sums
    raise RuntimeError(f"components not settled after {rounds} rounds")
