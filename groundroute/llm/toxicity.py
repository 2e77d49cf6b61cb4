"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over words and word beginnings. Labelled sentences that mention an
identity term are paired with the same sentence with the term swapped for others of its group,
and the squared change of the score's logit is penalised, so that a neutral mention of a group
earns no score of its own. Groups are a list of identity terms and, beside it, neutral words of
the labelled rows that stand in the same slots (after the same words), so that rows in any language have pairs.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoding import slices

#: Labelled rows to fit on, at most: the classifier's bounded sample. All their sentences count.
SAMPLE = 8_000
#: Features are chosen by how far the logarithms of their rates under the labels lie apart, times the root of their count: those that say nothing
#: about toxicity in the sample would only be weighed at random. No row or text is left out for it.
APART = 4.5
THRESHOLD = 0.3
#: Identity terms that may stand for each other (a list of our own; a parameter). Fixed values.
IDENTITIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"), ("mothers", "fathers"), ("wives", "husbands"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"), ("gays", "heterosexuals", "lesbians", "bisexuals"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"), ("islam", "christianity", "judaism", "hinduism", "buddhism"),
    ("black", "white", "asian", "latino", "arab", "hispanic"), ("blacks", "whites", "asians", "latinos", "arabs", "hispanics"), ("african", "european", "american", "chinese", "indian", "mexican", "turkish", "polish"),
    ("immigrants", "refugees", "foreigners", "natives", "migrants"), ("immigrant", "refugee", "foreigner", "native", "migrant"), ("deaf", "blind", "disabled", "autistic"), ("old", "young", "elderly"), ("rich", "poor"),
    ("frauen", "männer", "mädchen", "jungen"), ("frau", "mann"), ("muslime", "christen", "juden", "atheisten"), ("ausländer", "flüchtlinge", "einwanderer", "deutsche"), ("schwule", "lesben"),
    ("femmes", "hommes", "filles", "garçons"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "athées"), ("immigrés", "réfugiés", "étrangers", "français"),
    ("mujeres", "hombres", "niñas", "niños"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "ateos"), ("inmigrantes", "refugiados", "extranjeros", "españoles"),
)
#: Neutral words of the sample that may become stand-ins, at most; the least share of rows they are in; how far their rates
#: under the two labels may differ; how alike the words before them must be (cosine).
STAND_INS, LEAST_SHARE, NEUTRAL, ALIKE = 100, 0.02, 1.5, 0.3
TOKEN = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.!?\n]+")
STEMS = (4, 5, 6)


def features(word: str) -> list[str]:
    return ["w:" + word, *(f"{n}:{word[:n]}" for n in STEMS if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(TOKEN.findall(text.lower()))


def swaps(words: Iterable[str], groups=IDENTITIES) -> list[set[str]]:
    """The word sets of a sentence with one term swapped for each other term of its group."""
    words, out = set(words), []
    for group in groups:
        here = words.intersection(group)
        for term in sorted(here):
            out += [words - {term} | {other} for other in group if other not in here]
    return out


def counted_differences(sentences: Iterable[Iterable[str]], groups=IDENTITIES) -> list[tuple[tuple[str, ...], tuple[str, ...], int]]:
    """By what features sentences (their words) and their swapped forms differ: those that only the sentence has, those that only the swapped form has, and
    how many pairs differ so. There are no more of these than a pair of terms has subsets of its features."""
    of = {t: [g for g in groups if t in g] for g in groups for t in g}
    known = {t: features(t) for t in of}
    found: Counter = Counter()
    for words in sentences:
        words = set(words)
        here = sorted(words.intersection(of))
        if not here:
            continue
        met = Counter(f for w in words for f in features(w))
        for term in here:
            for group in of[term]:
                for other in group:
                    if other not in words:
                        a, b = known[term], known[other]
                        rest = lambda f: met[f] > (f in a)  # noqa: B023, E731
                        found[tuple(f for f in a if f not in b and not rest(f)), tuple(f for f in b if f not in a and not rest(f))] += 1
    return [(a, b, n) for (a, b), n in found.items()]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    n_pairs: int = 0  # counterfactual pairs it was fitted with

    def logit(self, words: set[str]) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in {f for w in words for f in features(w)})


def fit(rows: list[tuple[tuple[str, ...], int]], penalty: float = 1.0, ridge: float = 3e-4, groups=IDENTITIES, rounds: int = 250, apart: float = 0.0, sentences: list[tuple[str, ...]] | None = None, pairs: list[tuple[tuple[str, ...], tuple[str, ...], int]] | None = None) -> Model:
    """rows: (words, label); pairs: by what features a sentence and its swapped form differ, and how many pairs do so (see differences);
    else sentences: the words of each sentence to swap terms in (each row's, if none
    are given). Chooses features by how labels differ over them, then descends."""
    n, positive = len(rows), sum(y for _, y in rows)
    if not n or positive in (0, n):
        return Model({}, -20.0 if not positive else 20.0)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in rows:
        seen[y].update({f for w in words for f in features(w)})

    def standing_out(f):  # how far the labels' rates of a feature differ (their logarithms), for how often it is met
        a, b = seen[1][f], seen[0][f]
        return abs(np.log((a + 0.5) / (positive + 1)) - np.log((b + 0.5) / (n - positive + 1))) * np.sqrt(a + b)

    named = sorted({*(f for f in seen[1].keys() | seen[0].keys() if standing_out(f) >= apart), *("w:" + t for g in groups for t in g)})
    at = {f: k for k, f in enumerate(named)}
    coded = lambda words: {at[f] for w in words for f in features(w) if f in at}
    xs = [np.array(sorted(coded(w)), dtype=np.int64) for w, _ in rows]
    y = np.array([v for _, v in rows], dtype=float)
    # the penalty knows a pair by its difference alone: features of the sentence (1) and of its swapped form (-1) that the other has not
    differing: Counter = Counter()
    for plus, minus, n_alike in counted_differences([w for w, _ in rows] if sentences is None else sentences, groups) if pairs is None else pairs:
        differing[tuple(sorted(at[f] for f in plus if f in at)), tuple(sorted(at[f] for f in minus if f in at))] += n_alike
    n_pairs, alike = sum(differing.values()), np.array(list(differing.values()), dtype=float)
    d_cols = np.array([c for both in differing for part in both for c in part], dtype=np.int64)
    d_sign = np.array([sign for both in differing for part, sign in zip(both, (1.0, -1.0)) for _ in part])
    d_row = np.repeat(np.arange(len(differing)), [len(a) + len(b) for a, b in differing])
    flat = lambda parts: (np.concatenate([*parts, np.empty(0, dtype=np.int64)]).astype(np.int64), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
    cols, row = flat(xs)
    w, b = np.zeros(len(named)), float(np.log(positive / (n - positive)))
    m, v = np.zeros(len(named) + 1), np.zeros(len(named) + 1)
    for t in range(1, rounds + 1):  # Adam on all rows
        z = b + np.bincount(row, weights=w[cols], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(cols, weights=((p - y) / n)[row], minlength=len(w)) + ridge * w
        if n_pairs:
            change = alike * np.bincount(d_row, weights=d_sign * w[d_cols], minlength=len(alike))
            g += np.bincount(d_cols, weights=d_sign * (2 * penalty / n_pairs * change)[d_row], minlength=len(w))
        g = np.r_[g, (p - y).mean()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: float(x) for f, x in zip(named, w) if abs(x) > 1e-4}, float(b), n_pairs)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled_sentences(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """row, toxic, words (distinct, in order), sentences (a line each) of at most ``sample`` labelled rows that aren't held
    out, by smallest hash of the id, then of the text; words are parted by spaces. Rows that share an id count each, rows that share a text too once."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    marks = marks.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = common.written(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "marks")

    def cut(batches):
        for batch in batches:
            for rows, texts in slices(batch, 1_000_000):
                found = [[w for w in (TOKEN.findall(s) for s in SENTENCE_END.split(t.lower())) if w] for t in texts]
                words, lines = [" ".join(sorted({w for s in f for w in s})) for f in found], ["\n".join(map(" ".join, f)) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.string()), pa.array(lines, pa.string())], names=["row", "words", "sentences"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(common.small(marks), "doc_id")
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    keys = common.written(texts.select("doc_id", "row", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(sample), "labelled-rows")
    once = texts.join(common.small(keys.select("row")), "row", "left_semi").groupBy("row").agg(F.min("text").alias("text"))
    found = once.mapInArrow(common.tidy(cut), "row long, words string, sentences string")
    return common.written(found.join(common.small(keys), "row").select("row", (F.col("toxic") > 0).cast("int").alias("toxic"), "words", "sentences"), "labelled-sentences")


def stand_ins(sentences: DataFrame) -> list[tuple[str, str]]:
    """Pairs of neutral words that stand in the same slots: words at about the same rate under
    both labels, each the other's nearest by the words that come before it. The driver gets counts of at most STAND_INS words."""
    total = sentences.agg(F.count_if(F.col("toxic") == 1).alias("one"), F.count_if(F.col("toxic") == 0).alias("none")).first()
    if not total["one"] or not total["none"]:
        return []
    met = sentences.where("words <> ''").select("toxic", F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("one"), F.count_if(F.col("toxic") == 0).alias("none"))
    ratio = (F.col("one") / total["one"]) / (F.col("none") / total["none"])
    neutral = met.where((F.col("one") + F.col("none") >= LEAST_SHARE * (total["one"] + total["none"])) & (F.col("none") > 0) & ratio.between(1 / NEUTRAL, NEUTRAL))
    words = [r["word"] for r in neutral.orderBy(F.desc(F.col("one") + F.col("none")), "word").limit(STAND_INS).collect()]
    if len(words) < 2:
        return []
    at, counts = {w: k for k, w in enumerate(words)}, np.zeros((len(words), len(words)))

    def slots(batches):
        met = Counter()
        for batch in batches:
            for text in batch.column(0):
                for line in text.as_py().split("\n"):
                    places = [at.get(w, -1) for w in line.split(" ")]
                    met.update((a, b) for a, b in zip(places, places[1:]) if a >= 0 and b >= 0)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((a, b, n) for (a, b), n in met.items()))], names=["before", "word", "n"])

    for r in sentences.select("sentences").mapInArrow(slots, "before long, word long, n long").groupBy("before", "word").agg(F.sum("n").alias("n")).collect():
        counts[r["word"], r["before"]] = r["n"]
    counts /= np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-9)
    alike = counts @ counts.T - 2 * np.eye(len(words))
    best = alike.argmax(axis=1)
    return [(words[k], words[b]) for k, b in enumerate(best.tolist()) if k < b and best[b] == k and alike[k, b] >= ALIKE]


def labelled_rows(sentences: DataFrame) -> list[tuple[tuple[str, ...], int]]:
    """(words, label) of each labelled row."""
    rows = sorted((r["row"], tuple(map(sys.intern, r["words"].split())), r["toxic"]) for r in sentences.select("row", "words", "toxic").toLocalIterator())
    return [r[1:] for r in rows]


def differences(sentences: DataFrame, groups=IDENTITIES) -> list[tuple[tuple[str, ...], tuple[str, ...], int]]:
    """counted_differences over all sentences, counted where they are; in order."""

    def count(batches):
        for batch in batches:
            lines = (line.split(" ") for text in batch.column(0) for line in text.as_py().split("\n"))
            if met := counted_differences(lines, groups):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in met], pa.list_(pa.string())), pa.array([x[1] for x in met], pa.list_(pa.string())), pa.array([x[2] for x in met], pa.int64())], names=["plus", "minus", "n"])

    found = sentences.select("sentences").mapInArrow(count, "plus array<string>, minus array<string>, n long").groupBy("plus", "minus").agg(F.sum("n").alias("n"))
    return sorted((tuple(r["plus"]), tuple(r["minus"]), r["n"]) for r in found.toLocalIterator())


def labelled_sample(sentences: DataFrame, groups=IDENTITIES, most: int = 20_000) -> tuple[list[tuple[tuple[str, ...], int]], list[tuple[str, ...]]]:
    """(words, label) of each labelled row, and a look at the sentences with a term of the groups: those of the list before
    those of stand-ins, then by smallest hash, ``most`` at most. (Fitting takes differences() of all sentences.)"""
    listed, terms = (frozenset(t for g in gs for t in g) for gs in (IDENTITIES, groups))

    def meeting(batches):
        for batch in batches:
            met = {}
            for text in batch.column(0):
                for line in text.as_py().split("\n"):
                    words = set(line.split(" "))
                    if not words.isdisjoint(terms):
                        met[" ".join(sorted(words))] = not words.isdisjoint(listed)
            if met:
                yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.bool_())], names=["s", "listed"])

    asked = sentences.select("sentences").mapInArrow(meeting, "s string, listed boolean").distinct()
    asked = asked.orderBy(F.desc("listed"), F.xxhash64("s"), "s").limit(most)
    return labelled_rows(sentences), [tuple(map(sys.intern, r["s"].split())) for r in asked.toLocalIterator()]


class Scorer:
    """Looks up a word's features once."""

    def __init__(self, model: Model):
        self.model, self.known = model, common.cache({})

    def logit(self, text: str) -> float:
        known, weights, found = self.known, self.model.weights, set()
        for w in set(TOKEN.findall(text.lower())):
            hit = known.get(w)
            if hit is None:
                if len(known) > 200_000:
                    known.clear()
                hit = known[w] = tuple(f for f in features(w) if f in weights)
            if hit:
                found.update(hit)
        return self.model.bias + sum(weights[f] for f in sorted(found))


@lru_cache(maxsize=2)
def _scorer(path_key: str, weights: tuple, bias: float) -> Scorer:
    return Scorer(Model(dict(weights), bias))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs (doc_id, text; others ignored): doc_id, held_out, score, predicted. Null text
    scores as empty, and null ids are not held out; repeated rows repeat. No shuffle."""
    common.long_texts(docs.sparkSession)
    # a model is at most a few thousand weights
    sent = docs.sparkSession.sparkContext.broadcast((tuple(sorted(model.weights.items())), model.bias))

    def rows(batches):
        scorer = _scorer(str(id(sent)), *sent.value)
        for batch in batches:
            for ids, texts in slices(batch):
                z = np.clip(np.array([scorer.logit(t) for t in texts]), -40, 40)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.tidy(rows), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 1.0) -> Model:
    """The classifier fitted on labelled rows of docs (doc_id, text) that aren't held out; labels: doc_id, toxic
    (the highest counts, null ones don't). Without rows of both labels it is a constant."""
    sentences = labelled_sentences(docs, labels, sample)
    groups = (*IDENTITIES, *stand_ins(sentences))
    model = fit(labelled_rows(sentences), penalty, groups=groups, apart=APART, pairs=differences(sentences, groups))
    common.give_back()  # the driver goes on to other work
    return model


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
