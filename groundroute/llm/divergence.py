"""Source divergence audit: how the sources of a language differ in their use of words.

Every (language, source) group and every language gives each kept term a smoothed share p, in billionths. Two groups
differ by the sum of their shares' differences over all kept terms; a group's telling terms are those whose share
exceeds the language's by most.

Pairs are computed from postings: a term that neither group has differs by the groups' base shares (those of a count
of 0), a term that only one has by that one's share against the other's base, and only terms that both have
are joined. Telling terms are searched by upper bounds: a group's terms are put into buckets by count; the bucket's largest
count and the smallest language share among its terms bound the difference. Buckets are evaluated from
the highest bound down, twice as many terms each round, until the bounds of what is left are strictly below the k-th value found.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import div
from . import common

#: Documents of a language that a term must be in, at least; telling terms of a group; what is added to every count; shares are given in parts of this.
LEAST_DOCUMENTS, TOP, SMOOTH, UNIT = 30, 50, 5, 1_000_000_000
#: Counts that a worker holds, about, before it passes them on.
HELD = 1_500_000

#: Bytes that end a term become spaces, A-Z become a-z; all others (so all letters beyond ASCII) stay.
_FOLD = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

GROUP = ["lang", "source"]
COUNTED = "lang string, source string, term string, count long, docs long"


class _Held:
    """Counts by group and term, and of documents, summed in numpy until they are passed on."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []  # rows: key, count, documents
        self.size = self.settled = 0

    def add(self, groups: list[tuple[str, str]], texts: list[bytes]) -> None:
        split = [t.translate(_FOLD).split() for t in texts]
        terms = self.terms
        codes = np.fromiter((terms.setdefault(w, len(terms)) for words in split for w in words), dtype=np.int64, count=sum(map(len, split)))
        of = np.repeat(np.arange(len(split)), [len(w) for w in split])
        pairs, times = np.unique((of << 32) | codes, return_counts=True)  # a document's distinct terms
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], dtype=np.int64)[pairs >> 32]
        self.parts.append(np.stack([(group << 32) | (pairs & 0xFFFFFFFF), times, np.ones(len(pairs), dtype=np.int64)]))
        self.size += len(pairs)
        if self.size > 2 * max(self.settled, 500_000):
            self.settle()

    def settle(self) -> np.ndarray:
        """One row a key."""
        rows = np.concatenate(self.parts, axis=1) if self.parts else np.empty((3, 0), dtype=np.int64)
        order = np.argsort(rows[0], kind="stable")
        rows = rows[:, order]
        first = np.flatnonzero(np.diff(rows[0], prepend=-1))
        rows = np.stack([rows[0, first], *(np.add.reduceat(x, first) if len(first) else x for x in rows[1:])])
        self.parts, self.size, self.settled = [rows], rows.shape[1], rows.shape[1]
        return rows

    def rows(self) -> pa.RecordBatch:
        keys, count, docs = self.settle()
        group, term = keys >> 32, keys & 0xFFFFFFFF
        names = [pa.array([g[k] for g in self.groups], pa.string()).take(pa.array(group)) for k in (0, 1)]
        words = pa.array(list(self.terms), pa.binary()).cast(pa.string()).take(pa.array(term))
        return pa.RecordBatch.from_arrays([*names, words, pa.array(count), pa.array(docs)], names=["lang", "source", "term", "count", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences), docs (documents) of docs' texts. Each task sums what it reads before the one shuffle, so a
    source of any size sends a row a term and task at most."""

    def task(batches):
        held = _Held()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1)]
            texts, size, first = batch.column(2).cast(pa.binary()), 0, 0
            sizes = pc.binary_length(texts).to_pylist()
            for k, n in enumerate(sizes):
                size += n
                if size >= 4_000_000 or k + 1 == len(texts):
                    held.add(list(zip(columns[0][first : k + 1], columns[1][first : k + 1])), texts.slice(first, k + 1 - first).to_pylist())
                    size, first = 0, k + 1
                    if held.size >= HELD:
                        yield held.rows()
                        held = _Held()
        if held.size:
            yield held.rows()

    parts = docs.select("lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(common.tidy(task), COUNTED)
    return parts.groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)), exactly: three digits at a time, as the product of large counts
    would leave 64 bits. Null without terms."""
    over = F.nullif(total + SMOOTH * terms, F.lit(0).cast("long"))
    value, rest = F.lit(0).cast("long"), count + SMOOTH
    for _ in range(3):
        value, rest = value * 1000 + div(rest * 1000, over), (rest * 1000) % over
    return value + 1


def _bucket(count: Column) -> Column:
    """Small counts have buckets of their own, larger ones share four a doubling."""
    return F.when(count < 16, count).otherwise(F.floor(F.log2(count.cast("double")) * 4)).cast("long")


class Audit:
    """The tables of an audit, each written once: groups (lang, source, total, kinds: its kept terms, base: its share of a count of 0),
    langs (lang, terms), counts (lang, source, term, count, p, q: the language's share)."""

    def __init__(self, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS):
        common.long_texts(docs.sparkSession)
        named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP), "text")
        counted = common.written(term_counts(named), "term-counts")
        terms = counted.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
        kept = common.written(terms.select("lang", "term", "in_lang"), "kept-terms")
        totals = common.small(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total")))
        present = counted.join(kept, ["lang", "term"])
        sizes = common.written(present.groupBy(*GROUP).agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("kinds")), "group-sizes")
        zero = F.lit(0).cast("long")
        met = named.select(*GROUP).distinct().join(common.small(sizes), GROUP, "left").join(totals, "lang", "left")
        filled = met.select(*GROUP, *(F.coalesce(c, zero).alias(c) for c in ("total", "kinds", "terms", "lang_total")))
        self.groups = common.written(filled.withColumn("base", F.coalesce(share(zero, F.col("total"), F.col("terms")), zero)), "groups")
        shares = present.join(common.small(self.groups.drop("kinds", "base")), GROUP).select(
            *GROUP, "term", "count", share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q")
        )
        self.counts = common.written(shares, "term-shares")

    def pairs(self) -> DataFrame:
        """lang, source, item (another source of the language), value."""
        groups = self.groups.select("lang", "source", "kinds", "terms", "base")
        a, b = (groups.select("lang", *(F.col(c).alias(c + side) for c in ("source", "kinds", "base")), *(["terms"] if side == "_a" else [])) for side in ("_a", "_b"))
        both = a.join(common.small(b), "lang").where("source_a < source_b")
        # postings: terms that both have, against what they'd count as terms of one group only
        p, q = (self.counts.select("lang", "term", F.col("source").alias("source" + side), F.col("p").alias("p" + side)) for side in ("_a", "_b"))
        bases = [common.small(groups.select("lang", F.col("source").alias("source" + side), F.col("base").alias("base" + side))) for side in ("_a", "_b")]
        p, q = (x.join(base, ["lang", "source" + side]) for x, base, side in zip((p, q), bases, ("_a", "_b")))
        gain = F.abs(F.col("p_a") - F.col("p_b")) - F.abs(F.col("p_a") - F.col("base_b")) - F.abs(F.col("p_b") - F.col("base_a"))
        key = ["lang", "source_a", "source_b"]
        shared = p.join(q, ["lang", "term"]).where("source_a < source_b").groupBy(*key).agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("shared"))
        # each group's terms against the other's base: as many rows as it has different counts
        levels = common.written(self.counts.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("n")), "count-levels")
        alone = levels.join(common.small(groups.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base"))), "lang").where("source <> other")
        alone = alone.groupBy("lang", "source", "other").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("other_base"))).alias("alone"))
        sides = [alone.select("lang", F.col("source").alias("source" + x), F.col("other").alias("source" + y), F.col("alone").alias("alone" + x)) for x, y in (("_a", "_b"), ("_b", "_a"))]
        whole = reduce(lambda left, right: left.join(right, key, "left"), [shared, *sides], both)
        zero = F.lit(0).cast("long")
        value = sum((F.coalesce(c, zero) for c in ("gain", "alone_a", "alone_b")), zero)
        neither = F.col("terms") - F.col("kinds_a") - F.col("kinds_b") + F.coalesce("shared", zero)
        found = common.written(whole.select(*key, (value + neither * F.abs(F.col("base_a") - F.col("base_b"))).alias("value")), "pair-values")
        return found.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(
            found.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value")
        )

    def buckets(self) -> DataFrame:
        """lang, source, bucket, n (terms), bound (no term of it exceeds the language's share by more), before (terms in
        buckets of higher bounds)."""
        made = self.counts.withColumn("bucket", _bucket(F.col("count"))).groupBy(*GROUP, "bucket").agg(F.count(F.lit(1)).alias("n"), (F.max("p") - F.min("q")).alias("bound"))
        order = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket")
        return common.written(made.where("bound > 0").withColumn("before", F.sum("n").over(order) - F.col("n")), "count-buckets")

    def telling(self, top: int = TOP) -> DataFrame:
        """lang, source, item (term), value, rank: the terms whose share exceeds the language's by most."""
        open_, bucketed = self.buckets(), self.counts.withColumn("bucket", _bucket(F.col("count")))
        order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
        rounds, best, most = common.rounds(self.groups.sparkSession, "telling-terms"), None, top
        while True:
            # the first open bucket of each group, and what follows it within so many terms
            ahead = open_.withColumn("now", F.col("before") - F.min("before").over(Window.partitionBy(*GROUP)) < most)
            now = common.small(ahead.where("now").select(*GROUP, "bucket"))
            values = bucketed.join(now, [*GROUP, "bucket"]).where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            met = values if best is None else values.unionByName(best.drop("rank"))
            best = rounds.write(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
            kth = best.where(F.col("rank") == top).select(*GROUP, F.col("value").alias("kth"))
            left = ahead.where("not now").join(common.small(kth), GROUP, "left").where("kth is null or bound >= kth")
            open_ = common.written(left.drop("kth", "now"), "open-buckets")
            if open_.isEmpty():
                return best
            most *= 2


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source; others ignored).

    part `pair`: each other source of the language, by the sum of differences; part `term`: terms whose share
    exceeds the language's, the ``top`` with the greatest excess. rank: from 1, by value descending, then item (as UTF-8) ascending.
    Nulls are empty: a group named '' or a text without terms. Groups without terms take part; a language without
    kept terms gives pairs of value 0. Repeated rows count as often as they are there. An empty table gives no rows.
    """
    audit = Audit(docs, least_documents)
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(audit.telling(top), "term"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(common.table(spark, sf_dir, "documents"))


OP13_SQL = f"""
with docs as (select doc_id, row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
words as (select n, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (select lang, term, count(*)::hugeint as n from words group by lang, term having count(distinct n) >= {LEAST_DOCUMENTS}),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
groups as (select distinct lang, source from docs),
counts as (select w.lang, w.source, w.term, count(*)::hugeint as n from words w join kept k on k.lang = w.lang and k.term = w.term group by all),
totals as (select lang, source, sum(n)::hugeint as total from counts group by lang, source),
grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + ({UNIT}::hugeint * (coalesce(c.n, 0) + {SMOOTH})) // (coalesce(t.total, 0) + {SMOOTH} * l.v) as p,
                1 + ({UNIT}::hugeint * (k.n + {SMOOTH})) // (l.total + {SMOOTH} * l.v) as q
         from groups g join kept k on k.lang = g.lang join langs l on l.lang = g.lang
         left join totals t on t.lang = g.lang and t.source = g.source
         left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from grid where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= {TOP}
"""
