"""Near duplicates, repeated windows, decontamination, mixing, neighbours and the pipeline."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from groundroute.llm import components, contamination, jaccard, mixing, neighbours, queries, substrings
from tests.conftest import DATA

DOCS = "doc_id long, text string, key string, n int, hash int, size int, source string"


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, self-repeats, nulls, empty and long texts, repeated rows."""
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(2, 5)))
    texts = [" ".join(word() for _ in range(random.choice([3, 5, 30, 60, 200]))) for _ in range(60)]
    base = " ".join(word() for _ in range(120)).split()
    for _ in range(150):  # one large group of near copies, more than a block
        w = base[:]
        w[random.randrange(120)] = word()
        texts.append(" ".join(w))
    texts += [texts[3]] * 5 + [texts[70]] * 40
    passage = " ".join(word() for _ in range(25))
    texts += [f"{word()} {passage} {word()}\n{passage}" for _ in range(6)]
    texts += ["la " * 50, "LA " * 3000, "a b " * 12, "", "", None, " \t ", "one two", "ONE  two"]
    random.shuffle(texts)
    out = [(k, t, "k", 1, 2, 3, random.choice(["a", "a", "b", None])) for k, t in enumerate(texts)]
    return out + [out[0], (None, "null id text", "k", 1, 2, 3, "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def test_near_duplicates_equal_brute_force(docs, rows):
    def shingles(t):
        w = (t or "").lower().encode().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())

    sets = [shingles(r[1]) for r in rows]
    ids = [-1 if r[0] is None else r[0] for r in rows]
    root, links, reps = list(range(len(rows))), [0] * len(rows), {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), 1 << 60), ids[k])
        if sets[k]:
            reps[sets[k]] = min(reps.get(sets[k], 1 << 60), ids[k])
    wanted = sorted((ids[k], least[find(k)], reps.get(sets[k], ids[k]), links[k]) for k in range(len(rows)))
    got = [tuple(-1 if v is None else v for v in r) for r in jaccard.near_duplicates(docs).collect()]
    assert sorted(got) == wanted


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(80), random.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pruning_bound_keeps_likely_pairs():
    table = dict(jaccard.least_matches(0.8))
    assert table[128] < 0.8 * 128 and table[16] < table[128]
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 60, 1000).astype(np.uint64)
    near, far = np.sort(np.r_[a[:920], a[:0]]), np.sort(np.r_[a[:300], rng.integers(0, 1 << 60, 700).astype(np.uint64)])
    sig = [jaccard.signature(np.sort(x))[None] for x in (a, near, far)]
    assert jaccard.surviving(sig[0], sig[1], 0.8)[0, 0] and not jaccard.surviving(sig[0], sig[2], 0.8)[0, 0]


@pytest.mark.parametrize("flush", [40, 1_500_000])
def test_repeated_windows_equal_brute_force(docs, rows, flush, monkeypatch):
    monkeypatch.setattr(substrings, "FLUSH", flush)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    listed = [(-1 if r[0] is None else r[0], word.findall(r[1] or "")) for r in rows]
    for i, w in listed:
        for k in range(len(w) - 19):
            q = tuple(w[k : k + 20])
            first[q] = min(first.get(q, (i, k)), (i, k))
    wanted = []
    for i, w in listed:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone.update(range(k, k + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        wanted.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(wanted)


def test_copies_of_a_text_spread_over_ranges():
    keys, hashes = np.arange(6400, dtype=np.int64), np.full(6400, -7, dtype=np.int64)
    for k, h in ((keys, hashes), (hashes, keys)):
        counts = np.bincount(substrings.ranges_of(k, h, 64), minlength=64)
        assert counts.min() > 50 and counts.max() < 200


def test_settled_windows_of_tasks_spread_over_buckets():
    begun = [substrings.first_turn(k, 64) for k in range(640)]
    counts = np.bincount(begun, minlength=64)
    assert len(counts) == 64 and counts.min() > 0 and counts.max() < 40
    parts = [np.array([1, n], dtype="<i8").tobytes() for n in (4, 4, 9, 1, 1)]
    assert substrings.in_turn(parts, 8) == [parts[:2], parts[2:3], parts[3:]]


def test_rows_that_repeat_a_key_with_other_texts_lose_their_windows(spark):
    shared = " ".join(f"w{k}" for k in range(20))
    two = [(5, f"{shared} tail one"), (5, f"{shared} other end"), (5, f"{shared} other end"), (1, shared), (9, "x"), (9, "y")]
    dealt = spark.createDataFrame(spark.sparkContext.parallelize(two, 2), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(dealt).collect() if r.doc_id < 9)
    assert got == [(1, 20, 0), (5, 22, 20), (5, 22, 20), (5, 22, 20)]


def test_containment_equals_sql_and_edges(spark, docs, rows):
    long_text = max((r[1] for r in rows if r[1]), key=len).split()
    items = spark.createDataFrame([(1, " ".join(next(r[1] for r in rows if r[1] and len(r[1].split()) == 200).split()[50:80]), "x"), (2, None, "x"), (3, "too short", "x"), (4, "  ", "x"), (None, "a b c d e f", "x"), (5, " ".join(long_text[:40]), "x"), (1, None, "x")], "item_id long, text string, doc_id string")
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text").toPandas())
    con.register("b", items.select("item_id", "text").toPandas())
    con.execute("create view documents as select doc_id::bigint as doc_id, text from d")
    con.execute("create view benchmark as select item_id::bigint as item_id, text from b")
    got = sorted(map(tuple, contamination.contained(docs, items).collect()))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op10_contaminated"]).fetchall()) and len(got) > 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained(docs, none).count() == 0


def filled(weights, sizes, share=1.5, cap=2.0):
    """Resharing, round by round."""
    budget, targets, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        level = budget / sum(weights[k] for k in free)
        over = {k for k in free if level * weights[k] > cap * sizes[k]}
        if not over:
            for k in free:
                targets[k] = level * weights[k]
            break
        for k in over:
            targets[k] = cap * sizes[k]
            budget -= targets[k]
        free -= over
    return targets


@pytest.mark.parametrize("block", [16, 4096])
def test_mixing(spark, docs, rows, block):
    got = mixing.mix(docs, block=block).collect()
    again = mixing.mix(docs.repartition(2), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    names = ["a", "b", None]
    sizes = [sum(len(word.findall(r[1] or "")) for r in rows if r[6] == s) for s in names]
    targets = filled([5, 2, 1], sizes)
    taken = {}
    for r in got:
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert set(taken) == {(s, round(t, 6)) for s, t in zip(sizes, targets)}
    for (_, target), t in taken.items():
        assert abs(sum(t) - target) <= 0.03 * target + 60


def test_settle_keeps_totals():
    rng = np.random.default_rng(3)
    sizes, pi = rng.integers(1, 500, 400).astype(float), np.full(400, 0.37)
    flown = mixing.settle(sizes, pi, np.random.default_rng(1), False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2 and flown @ sizes == pytest.approx(pi @ sizes, rel=1e-6) and flown.sum() == pytest.approx(pi.sum(), rel=1e-6)
    landed = mixing.settle(sizes, pi, np.random.default_rng(1), True)
    assert set(landed) <= {0.0, 1.0} and abs(landed @ sizes - pi @ sizes) < 5


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:120] = x[50]  # many ties
    rows = [(k, x[k].tolist(), "s") for k in range(400)] + [(400, None, "s"), (401, [0.0] * 8, "s"), (402, [float("nan")] * 8, "s"), (403, [1.0, None] * 4, "s"), (404, [float("inf")] * 8, "s"), (405, [1.0, 2.0], "s"), (406, [], "s"), (None, [1.0] * 8, "s")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = {}
    for r in neighbours.nearest(v.where("vec_id % 10 = 0 or vec_id > 399"), v, 10, query_block=7, block=50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 400, 10))
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        order = [k for k in np.lexsort((np.arange(400), d)) if k != q][:10]
        assert [found[n][0] for n in range(1, 11)] == [int(k) for k in order]
        assert [found[n][1] for n in range(1, 11)] == pytest.approx(d[order].tolist(), rel=1e-12)
    assert neighbours.nearest(v.where("vec_id < 0"), v).count() == 0 and neighbours.nearest(v, v.where("vec_id < 0")).count() == 0
    few = v.where("vec_id < 3")
    assert neighbours.nearest(few, few).count() == 6


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA)
        assert docs.columns == before.columns
        if name != "mixing":
            assert docs.exceptAll(before).count() == 0 and docs.count() > 0.3 * before.count()
        docs = docs.cache()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count()
    empty = before.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0


def test_pipeline_decides_by_id_and_text(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    item = " ".join(f"item{k}" for k in range(30))
    clean, other = (" ".join(f"{p}{k}" for k in range(30)) for p in ("clean", "other"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    left = lambda stage, rows: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in stage(spark, make(rows), str(tmp_path)).collect())
    assert left(corpus_pipeline.drop_contaminated, [(None, item), (None, clean), (5, item), (5, other)]) == [(-1, clean), (5, other)]
    rows = [(None, clean), (3, clean), (5, clean), (5, other), (7, other), (7, other), (8, item), (8, item), (9, ""), (9, ""), (None, None)]
    got = left(corpus_pipeline.drop_near_duplicates, [(k, t or "") for k, t in rows])
    assert [r for r in got if r[1]] == [(-1, clean), (5, other), (8, item)]
    assert sum(not r[1] for r in got) == 3
    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda docs, labels: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda docs, model: docs.selectExpr("doc_id", "cast(text like 'item%' as int) as predicted"))
    monkeypatch.setattr(corpus_pipeline.common, "table", lambda *a: None)
    assert left(corpus_pipeline.drop_toxic, [(None, item), (None, clean), (5, item), (5, other)]) == [(-1, clean), (5, other)]


def keyed(docs):
    from pyspark.sql import functions as F

    return docs.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


@pytest.mark.parametrize("columns, range_bits", [(None, 22), (1 << 16, 22), (None, 9), (1 << 16, 11)])
def test_sketch_by_ranges_loses_no_window(docs, columns, range_bits):
    rows = keyed(docs).orderBy("key").coalesce(2)
    starts = lambda **o: sorted(map(tuple, substrings.repeated_starts(rows, **o).collect()))
    assert starts(max_columns=columns, range_bits=range_bits) == starts()


def test_prefilter_lets_few_other_windows_pass(spark):
    random.seed(12)
    text = lambda n: " ".join(f"w{random.randrange(10**6)}" for _ in range(n))
    shared = text(60)
    docs = spark.createDataFrame([(k, text(300)) for k in range(40)] + [(50 + k, f"{text(30)} {shared} {text(30)}") for k in range(4)], "doc_id long, text string")
    windows, hit = substrings.filter_rate(keyed(docs))
    assert windows == 40 * 281 + 4 * 101 and 4 * 41 <= hit < 0.1 * windows
    assert substrings.filter_rate(keyed(docs.limit(0))) == (0, 0)


def test_unknown_chunks_pass_whole(tmp_path):
    flags = substrings.Flags(f"file://{tmp_path}/none", 4, 16)
    assert flags.of(123) is None and flags.hits(np.arange(7, dtype=np.uint64), None).tolist() == list(range(7))


def test_short_items_equal_sql(spark):
    docs = spark.createDataFrame([(1, "four words are here today"), (2, "Four  words ARE here"), (3, "words are here four"), (4, "one"), (4, "more of one two three four five six"), (5, None), (6, "six seven eight nine ten eleven twelve"), (None, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "four words are here"), (2, "one"), (3, "one two three four five six"), (4, "six seven eight nine ten"), (5, ""), (5, "a b"), (None, "one")], "item_id long, text string")
    con = duckdb.connect()
    con.register("d", docs.toPandas())
    con.register("b", items.toPandas())
    con.execute("create view documents as select doc_id::bigint as doc_id, text from d")
    con.execute("create view benchmark as select item_id::bigint as item_id, text from b")
    got = sorted(map(tuple, contamination.contained(docs, items).collect()))
    assert got == sorted(con.execute(queries.ORACLE_SQL["op10_contaminated"]).fetchall())
    assert {r[:2] for r in got} == {(1, 1), (2, 1), (4, 2), (4, 3), (6, 4)}


def test_sketch_length_and_threshold_of_size_partitions(spark):
    """A text that holds just the wanted share of an item, whatever share it is, meets the item's threshold."""
    random.seed(3)
    items, docs = [], []
    for n, size in enumerate((1, 2, 3, 4, 5, 7, 8, 10, 15, 16, 31, 40, 64, 100)):
        words = [f"w{n}x{k}" for k in range(size + 4)]
        items.append((n, " ".join(words)))
        for d in range(3):  # words at one end are lost, so that whole shingles are
            lost = int(0.2 * size + 1e-9) + (d == 2)
            kept = words[lost:] if d == 0 else words[: len(words) - lost]
            docs.append((3 * n + d, "x y z " + " ".join(kept) + " z y x"))
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contained(make(docs, "doc_id"), make(items, "item_id")).collect()}
    assert got == {(3 * n + d, n) for n in range(14) for d in (0, 1)}


def test_repeated_queries_and_double_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1e-9]), (3, [1.0, 2e-9]), (4, [0.0, 3.5]), (5, [9.0, 9.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["rank"], r.vec_id, r.score) for r in neighbours.nearest(v.where("vec_id = 1"), v, 2).collect())
    assert [(n, i) for n, i, _ in got] == [(1, 2), (1, 2), (1, 4), (2, 3), (2, 3), (2, 3)]
    assert [s for n, i, s in got if i == 3][:2] == [2e-9, 2e-9]


def test_mixing_stage_counts_rows_not_ids(spark):
    import corpus_pipeline

    rows = [(k % 7, f"{'word ' * (5 + k % 11)}{k}", "s") for k in range(60)] + [(100, "twice the same row", "s")] * 4 + [(None, "no id here", None), (8, None, "s"), (8, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    size = lambda rs, s: sum(len((t or "").split()) for _, t, x in rs if x == s)
    assert set(map(tuple, out)) <= set(rows) and abs(size(out, "s") - 1.5 * size(rows, "s")) < 0.6 * size(rows, "s")
    assert size(out, None) <= 2 * size(rows, None) and all(t for _, t, _ in out)


def test_small_counts_bytes_and_workers_give_back(spark, monkeypatch):
    from groundroute.llm import common

    df = spark.createDataFrame([(1, "x" * 1000, [1, 2])], "a long, b string, c array<long>")
    assert 1000 < common.n_bytes(df) < 1200 and common.n_bytes(df.limit(0)) == 0
    kept = common.cache({"a": 1})
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and kept == {}

    class Cluster:
        conf = {}
        sparkContext = type("Context", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.shared_dir(Cluster())


def test_templates_do_not_stay_one_group(spark):
    """600 texts of one template, alike by about 0.4, and six near copies of each of three of them."""
    random.seed(21)
    template = [f"t{k}" for k in range(90)]
    made = lambda k: template + [f"own{k}x{j}" for j in range(60)]
    texts = [made(k) for k in range(600)]
    for k in (5, 250, 599):
        for j in range(6):
            texts.append(made(k)[:-1] + [f"copy{j}"])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    keyed_ = docs.selectExpr("doc_id as key", "cast(lower(text) as binary) as text")
    reps = jaccard.signatures(keyed_).selectExpr("key as node", "sig").cache()
    groups = jaccard.candidate_groups(reps, 0.8).groupBy("root").count().collect()
    plain = components.components(jaccard.candidate_edges(reps, 0.8)).groupBy("root").count().collect()
    assert max(r["count"] for r in plain) > 500 and max(r["count"] for r in groups) < 100
    got = jaccard.near_duplicates(docs).where("n_links > 0").collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted([(k, k, 6) for k in (5, 250, 599)] + [(600 + 6 * g + j, k, 6) for g, k in enumerate((5, 250, 599)) for j in range(6)])
    few = jaccard.refined_edges(reps, 0.8, cell=2)
    assert few.count() > jaccard.refined_edges(reps, 0.8).count() > 0


def test_targets_of_many_sources_equal_resharing(spark):
    random.seed(9)
    names = [None, *("".join(random.choices("aBzÉ日", k=random.randint(1, 4))) for _ in range(300))]
    rows = sorted({n: (n, random.choice([0, 1, 5, 50, 5000])) for n in names}.values(), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).orderBy("sid").collect()
    wanted = filled([(5, 2, 1)[k % 3] for k in range(len(rows))], [s for _, s in rows])
    assert [(r.source, r.sid, r.source_size) for r in got] == [(n, k, s) for k, (n, s) in enumerate(rows)] and [r.target for r in got] == pytest.approx(wanted)
