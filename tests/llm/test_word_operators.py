"""Periodic runs, the table of distinct words, and the source audit against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundroute.llm import common, divergence, periods, queries, word_table
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n int, chunk int, count int, runs string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def brute_runs(word, least, times):
    """Every maximal stretch for each of its periods, the smallest period of a stretch kept."""
    best = {}
    for d in range(1, len(word)):
        start = 0
        while start + d < len(word):
            end = start + d
            while end < len(word) and word[end] == word[end - d]:
                end += 1
            if end - start >= max(least, times * d):
                best.setdefault((start, end), d)
            start = max(end - d + 1, start + 1)
    return sorted((a, b - a, d) for (a, b), d in best.items())


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    word = lambda: random.choice(["ab", "Ab", "don't", "élan", "x9,", "naïve!!", "'tis", "A", "ĳs", "日本語", "İ", "ﬁn", "áb", "Σας", "$5.20", "<|endoftext|>", "<|start", "q r", " z", "it's"])
    texts = [" ".join(word() for _ in range(n)) for n in (1, 5, 40, 200, 400)]
    texts += ["la " * 30, "one two " * 40 + "three", "a b c d e f g h " * 3, "", None, " \t\n ", "x" * 30_000, "\x0bv\x0cw\rz\x1fq", "a b " * 4000]
    texts += [texts[3]] * 4
    out = [(k, t, random.choice(["en", "en", "de", None]), random.choice(["s", "s", "t", "", None]), 1, 2, 3, "r") for k, t in enumerate(texts)]
    return out + [out[2], (None, "a null id " * 20, "en", "s", 1, 2, 3, "r")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_runs_of_random_words_equal_brute_force():
    random.seed(3)
    for trial in range(400):
        letters = random.choice([1, 2, 2, 3, 5])
        word = [random.randrange(letters) for _ in range(random.choice([1, 7, 30, 60]))]
        if trial % 3 == 0:  # a planted run amid others
            period = [random.randrange(letters) for _ in range(random.randint(1, 9))]
            word = word[:10] + period * random.randint(2, 6) + period[: random.randint(0, len(period))] + word[10:]
        for least, times in ((24, 3), (4, 2), (6, 3)):
            assert periods.runs_of(word, least, times) == brute_runs(word, least, times)
            assert periods.find_runs(np.array(word, dtype=np.uint64), least, times) == brute_runs(word, least, times)


def test_ordered_sets_split_their_blocks(monkeypatch):
    monkeypatch.setattr(periods, "BLOCK", 4)
    random.seed(4)
    numbers = random.sample(range(500), 200)
    held, seen = periods.Ends(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        before, after = max((y for y in seen if y < x), default=-1), min((y for y in seen if y > x), default=-1)
        assert held.add(x) == (before, after)
        seen.append(x)
    assert list(held) == sorted(seen) and len(held.blocks) > 20
    assert periods.runs_of([0] * 300) == [(0, 300, 1)]


def test_collapse_keeps_first_periods(docs, rows):
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["text"]) for r in periods.collapse(docs).collect())
    wanted = []
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        runs = brute_runs(words, 24, 3)
        gone = {k for a, n, d in runs for k in range(a + d, a + n)}
        wanted.append((-1 if doc_id is None else doc_id, len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert got == sorted(wanted)
    assert any(len(r) for _, _, r, _ in got)


def test_periodic_runs_query_equals_brute_force(spark):
    found = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    table = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    planted = 0
    for doc_id, text in table:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words, 24, 3) if n < 3000 else periods.find_runs(np.unique(np.array(words), return_inverse=True)[1].astype(np.uint64))
        gone = {k for a, n, d in runs for k in range(a + d, a + n)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        r = found[doc_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[1] * 1000 // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{d}\n" for a, n, d in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    assert len(found) == len(table) and planted > 5 and sum(r["n_runs"] > 0 for r in found.values()) > 5


def test_strongest_run_is_exact(spark):
    runs = [(0, 30, 7), (5, 60, 14), (9, 61, 14)]
    df = spark.createDataFrame([(1, runs), (2, runs[:2]), (3, [])], f"doc_id long, runs {periods.RUNS}")
    assert [tuple(r["best"] or ()) for r in df.select("doc_id", periods.strongest(F.col("runs")).alias("best")).orderBy("doc_id").collect()] == [(9, 61, 14), (0, 30, 7), ()]


def test_word_table_equals_the_library(docs, rows, monkeypatch):
    tokenizer = word_table._tokenizer(word_table.word_vocabulary())
    wanted = []
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        wanted.append((-1 if doc_id is None else doc_id, len(ids), np.array(ids, dtype="<u4").tobytes(), tokenizer.decode(ids, skip_special_tokens=False)))
    assert any(49407 in np.frombuffer(w[2], dtype="<u4") for w in wanted)
    for characters in (word_table.CHUNK_CHARACTERS, 1):
        monkeypatch.setattr(word_table, "CHUNK_CHARACTERS", characters)
        got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text"]) for r in word_table.decode(word_table.encode(docs)).collect()]
        assert sorted(got) == sorted(wanted)


def test_word_table_query_equals_the_library(spark):
    tokenizer = word_table._tokenizer(word_table.word_vocabulary())
    found = {r["doc_id"]: r for r in queries.QUERIES["op12_word_table"](spark, DATA).collect()}
    table = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    for doc_id, text in table:
        ids, r = tokenizer.encode(text or "", add_special_tokens=False).ids, found[doc_id]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(found) == len(table)


def test_split_words_are_the_librarys(rows):
    tokenizer = word_table._tokenizer(word_table.word_vocabulary())
    random.seed(8)
    alphabet = "aZé'sÉtß0.,!<|>ſıøĳŋ-\"’»日İǅ́"
    for _ in range(3000):
        run = "".join(random.choices(alphabet, k=random.randint(1, 9)))
        ids = [i for w in word_table.split_word(run) for i in tokenizer.encode(w, add_special_tokens=False).ids]
        assert ids == tokenizer.encode(run, add_special_tokens=False).ids, run


def test_distinct_words_are_encoded_once(docs, spark):
    n = [0]

    class Counting:
        def encode_batch_fast(self, words, add_special_tokens):
            n[0] += len(words)
            assert len(set(words)) == len(words)
            return word_table_tokenizer.encode_batch_fast(words, add_special_tokens=add_special_tokens)

    word_table_tokenizer = word_table._tokenizer(word_table.word_vocabulary())
    chunk = word_table.Chunk()
    chunk.add([1, 2], ["a b a", "b c"])
    *_, batch = word_table._rows(chunk, 7, 1)
    kept = word_table._tokenizer
    try:
        word_table._tokenizer = lambda path: Counting()
        out = list(word_table._encode("x")([batch.slice(1), batch.slice(1)]))
    finally:
        word_table._tokenizer = kept
    assert n[0] == 3 and len(out) == 2


def test_decoding_leaves_out_unknown_ids(spark):
    df = spark.createDataFrame([(1, 2, bytearray(np.array([320, 4_000_000], dtype="<u4").tobytes())), (2, 0, bytearray()), (3, None, None)], "doc_id long, n_tokens long, ids binary")
    got = {r["doc_id"]: r["text"] for r in word_table.decode(df).collect()}
    tokenizer = word_table._tokenizer(word_table.word_vocabulary())
    assert got == {1: tokenizer.decode([320], skip_special_tokens=False), 2: "", 3: ""}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert periods.collapse(none).count() == word_table.decode(word_table.encode(none)).count() == divergence.divergence(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 1, 2, 3, "r"), (2, "", "en", "a", 1, 2, 3, "r")], DOCS)
    assert [r["n_tokens"] for r in word_table.encode(blank).collect()] == [0, 0]


def brute_audit(rows, least, top):
    import re
    from collections import Counter, defaultdict

    docs, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        langs[lang].update(terms)
    out = []
    for lang, source in counts:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, whole = shares(counts[lang, source]), shares(langs[lang])
        pairs = [(sum(abs(own[t] - other[t]) for t in kept), s) for l, s in counts if l == lang and s != source for other in [shares(counts[l, s])]]
        terms = [(own[t] - whole[t], t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("least,top", [(1, 3), (2, 50), (1000, 5)])
def test_divergence_equals_brute_force(docs, rows, least, top):
    assert sorted(map(tuple, divergence.divergence(docs, least, top).collect())) == brute_audit(rows, least, top)


def test_divergence_with_ties_and_many_rounds(spark):
    """Terms in their hundreds with equal shares: the search must go on while bounds equal the k-th value."""
    random.seed(6)
    rows = []
    for k in range(240):
        source = f"s{k % 6}"
        words = [f"w{chr(97 + random.randrange(26))}{chr(97 + random.randrange(12))}" for _ in range(60)] + [f"only{source[1:]}{chr(97 + j % 26)}" for j in range(k % 40)]
        rows.append((k, " ".join(words), "en" if k % 5 else "", source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for least, top in ((1, 5), (3, 50)):
        assert sorted(map(tuple, divergence.divergence(df, least, top).collect())) == brute_audit(rows, least, top)


def test_shares_of_large_counts_are_exact(spark):
    rows = [(c, t, v) for c in (0, 1, 10**10, 9 * 10**13) for t in (9 * 10**13, 9 * 10**13 + 7) for v in (1, 12345)] + [(0, 0, 0), (3, 7, 2)]
    df = spark.createDataFrame(rows, "c long, t long, v long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("t"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 5) // (t + 5 * v) if t + 5 * v else None for c, t, v in rows]


def test_counts_survive_flushes(spark, docs, monkeypatch):
    wanted = sorted(map(tuple, divergence.term_counts(docs).collect()), key=str)
    held = divergence._Held()
    monkeypatch.setattr(divergence, "HELD", 1)
    assert sorted(map(tuple, divergence.term_counts(docs).collect()), key=str) == wanted
    for _ in range(3):
        held.add([("en", "a"), ("en", "b")], [b"x y x", b"y"])
        held.settle()
    assert [tuple(r.values()) for r in held.rows().to_pylist()] == [("en", "a", "x", 6, 3), ("en", "a", "y", 3, 3), ("en", "b", "y", 3, 3)]
