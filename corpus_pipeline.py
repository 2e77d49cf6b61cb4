"""The corpus pipeline: documents through five of the training-data operators, stage by stage.

run() applies the stages to the documents table; each stage's result is written as Parquet in
the shared folder and read again as the next one's documents. All but the last return the
columns of documents; the last returns the token files' contents, document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundroute.llm import common, contamination, jaccard, mixing, token_files, toxicity


def _row() -> Column:
    """What a decision is about: a document is a doc_id (null ones too) with its text, and rows that share both share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _by_row(docs: DataFrame) -> DataFrame:
    """docs with the row's hash as its doc_id, so that operators tell apart what shares an id, and meet null ones."""
    return docs.select(_row().alias("doc_id"), "text")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs but for those whose hash is in rows (column drop_row)."""
    return docs.join(common.small(rows.distinct()), _row() == F.col("drop_row"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The classifier learns from the labels of the rows it is given."""
    found = toxicity.score(_by_row(docs), toxicity.train(docs, common.table(spark, sf_dir, "labels")))
    return _without(docs, common.written(found.where("predicted = 1").select(F.col("doc_id").alias("drop_row")), "toxic-rows"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the document with the smallest doc_id (null before
    all others) stays. Texts without shingles are in no group, and stay however often a row is there."""
    found = jaccard.near_duplicates(_by_row(docs))
    linked = common.written(found.where("n_links > 0").groupBy(F.col("doc_id").alias("row"), F.col("class_id").alias("class")).agg(F.count(F.lit(1)).alias("copies")), "near-rows")
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), _row().alias("row")).join(common.small(linked), "row")
    kept = common.written(ids.groupBy("class").agg(F.min(F.struct("id", "row", "copies")).alias("first")).select("first.row", "first.copies"), "near-kept")
    rest = _without(docs, common.written(linked.join(common.small(kept.select("row")), "row", "left_anti").select(F.col("row").alias("drop_row")), "near-dropped"))
    # of rows that repeat an id and its text one stays
    twice = common.written(kept.where("copies > 1").select(F.col("row").alias("drop_row")), "near-twice")
    repeated = rest.join(common.small(twice), _row() == F.col("drop_row")).groupBy("drop_row").agg(F.min(F.struct(*docs.columns)).alias("one"))
    return _without(rest, twice).unionByName(repeated.select("one.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contamination.contained(_by_row(docs), common.table(spark, sf_dir, "benchmark"))
    return _without(docs, common.written(found.select(F.col("doc_id").alias("drop_row")).distinct(), "leak-rows"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice. Rows that repeat an id and its text
    are there as often as the mix takes them together."""
    mixed = mixing.mix(docs.select(_row().alias("doc_id"), "text", "source")).where("size > 0")
    rows = mixed.groupBy(F.col("doc_id").alias("take_row")).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"), F.count(F.lit(1)).alias("met"))
    taken = common.written(rows.where("times > 0"), "taken")
    times = F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")
    single, repeated = (docs.join(common.small(taken.where(c)), _row() == F.col("take_row")) for c in ("met = 1", "met > 1"))
    once = repeated.groupBy("take_row", "times").agg(F.min(F.struct(*docs.columns)).alias("one"))
    return single.select(*docs.columns, times).drop("copy").unionByName(once.select("one.*", times).drop("copy"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.read_token_files(token_files.write_token_files(docs, common.new_path(spark, "pipeline-tokens")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", write_tokens),
]

#: Byte-pair encoding, a fitted classifier and a drawn sample are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
