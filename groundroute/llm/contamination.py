"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct shingles (powers of two). Each partition has a
sketch length and a threshold of its own: an item keeps its k smallest shingle hashes
(bottom-k MinHash), and as a text that holds the wanted share of an item of s shingles lacks at most
s - ceil(threshold * s) of them, it must hold k less that many of the sketch's. k is that
allowance for the partition's largest size and an eighth of this size more, so that one common run of words makes no
candidate of a long item. All shingle hashes of every document are looked up in the sketches of
all partitions; pairs that meet their partition's threshold are verified by exact shingle containment.
Items of fewer words than a shingle are one shingle of their own length. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD = 5, 0.8
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def runs(w: Column, hashed: bool, n: int = WORDS) -> Column:
    """The runs of n words of an array of words, as hashes or as strings; none below n words."""
    def at(k):
        parts = [F.get(w, k + i) for i in range(n)]
        return F.xxhash64(*parts) if hashed else F.concat_ws(" ", *parts)

    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), at))


def all_runs(w: Column, hashed: bool, lengths: list[int]) -> Column:
    """The runs of all these lengths."""
    none = F.array().cast("array<long>" if hashed else "array<string>")
    return F.concat(*[F.coalesce(runs(w, hashed, n), none) for n in lengths])


def item_shingles(items: DataFrame, n: int = WORDS) -> DataFrame:
    """item_id, shingle, words (how many it has), size (distinct shingles of the item): runs of n words, or of
    all where an item's text has fewer."""
    w = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("item_id is not null")
    whole = F.when((F.size("w") > 0) & (F.size("w") < n), F.array(F.concat_ws(" ", "w")))
    flat = w.select("item_id", F.least(F.size("w"), F.lit(n)).alias("words"), F.explode(F.coalesce(runs(F.col("w"), False, n), whole)).alias("shingle")).distinct()
    return flat.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def hash_of(n: int) -> Column:
    """The hash that runs gives a shingle of n words."""
    return F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(k)) for k in range(n)])


def sketches(shingled: DataFrame, threshold: float, lengths: list[int]) -> DataFrame:
    """item_id, h, need (hashes of the sketch that a document must hold): the k smallest hashes of each item."""
    part = F.floor(F.log2("size"))
    top = F.pow(F.lit(2), part + 1) - 1  # largest size of the item's partition
    k = F.least(F.col("size"), (F.floor(top * (1 - threshold) + 1e-9) + 1 + F.floor(top / 8)).cast("long"))
    lacks = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9)
    hashed = F.coalesce(*[F.when(F.col("words") == n, hash_of(n)) for n in lengths])
    order = Window.partitionBy("item_id").orderBy("h", "shingle")
    ranked = shingled.withColumn("h", hashed).withColumn("rank", F.row_number().over(order)).withColumn("k", k).where("rank <= k")
    return ranked.select("item_id", "h", (F.col("k") - lacks).alias("need")).distinct()


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every document that holds at least
    the threshold of an item's distinct shingles of n words (one shingle of all its words, if an item has fewer).

    Words are runs of other than ASCII white space, lower-cased. Null and empty texts
    have no shingle, so they neither hold nor are found; null ids take no part; rows that share
    a doc_id are one document, and items that share an item_id one item. Empty tables give no rows.
    """
    shingled = common.written(item_shingles(items, n), "item-shingles")
    lengths = [r["words"] for r in shingled.select("words").distinct().orderBy("words").collect()] or [n]  # n values at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # the words are a column of their own: inside the lambda they would be split again for each run
    split = texts.select("doc_id", words(F.col("text")).alias("w"))
    hashed = split.select("doc_id", F.explode(all_runs(F.col("w"), True, lengths)).alias("h"))
    sketch = common.small(common.written(sketches(shingled, threshold, lengths), "item-sketches"))
    met = hashed.join(sketch, "h").groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("hits"))
    pairs = common.written(met.where("hits >= need").select("doc_id", "item_id"), "candidates")
    asked = common.small(pairs.select("doc_id").distinct())
    exact = texts.join(asked, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(all_runs(F.col("w"), False, lengths)).alias("shingle"))
    shared = exact.join(common.small(shingled.select("item_id", "shingle", "size")), "shingle").groupBy("doc_id", "item_id", F.col("size").alias("n_shingles")).agg(F.count_distinct("shingle").alias("n_shared"))
    enough = shared.where(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9).join(pairs, ["doc_id", "item_id"], "left_semi")
    return enough.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def op10_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS_SQL = "[x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') if x <> '']"

OP10_SQL = f"""
with item_words as (select item_id, {_WORDS_SQL} as w from benchmark where item_id is not null),
items as (select distinct item_id, least(len(w), 5) as n, array_to_string(w[i : i + 4], ' ') as shingle
          from (select item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from item_words where len(w) > 0)),
sizes as (select item_id, count(*) as n_shingles from items group by item_id),
docs as (select distinct doc_id, array_to_string(w[i : i + n - 1], ' ') as shingle
         from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from (select doc_id, {_WORDS_SQL} as w from documents where doc_id is not null), (select distinct n from items) where len(w) >= n)),
met as (select doc_id, item_id, count(*) as n_shared from docs join items using (shingle) group by doc_id, item_id)
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles::double as containment
from met join sizes using (item_id) where n_shared >= 0.8::double * n_shingles - 1e-9
"""
