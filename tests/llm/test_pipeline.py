"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from groundroute.llm import encoding, toxicity
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def without_copies(rows):
    """One row of each class of chained links, that of the smallest id; rows without words stay."""
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9:
                root[find(a)] = find(b)
    classes = {}
    for k, r in enumerate(rows):
        classes.setdefault(find(k), []).append(r)
    return [min(c, key=lambda r: r.doc_id) for c in classes.values()]


def without_items(rows, items):
    """Rows that hold less than 0.8 of each item's shingles."""
    asked = [s for s in (shingles(i.text) for i in items) if s]

    def holds(text, item):
        n = len(next(iter(item)))
        w = [x.lower() for x in WORD.findall(text or "")]
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        return len(own & item) >= 0.8 * len(item) - 1e-9

    return [r for r in rows if not any(holds(r.text, s) for s in asked)]


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.common.written(stage(spark, docs, DATA), "test-stage")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    score = lambda r: 1 / (1 + math.exp(-model.logit(toxicity.words_of(r.text or ""))))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if score(r) < 0.3) and len(after) < len(before)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    assert sorted(after, key=lambda r: r.doc_id) == sorted(without_copies(before), key=lambda r: r.doc_id) and len(after) < len(before)


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[2]
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    assert sorted(after, key=lambda r: r.doc_id) == sorted(without_items(before, items), key=lambda r: r.doc_id) and len(after) < len(before)


def test_mix_meets_its_targets(stages):
    _, before, after = stages[3]
    from tests.llm.test_corpus_operators import filled

    size = lambda rs, s: sum(len(WORD.findall(r.text or "")) for r in rs if r.source == s)
    names = sorted({r.source for r in before if r.source is not None}) + [None] * any(r.source is None for r in before)
    targets = filled([(5, 2, 1)[k % 3] for k in range(len(names))], [size(before, s) for s in names])
    for s, target in zip(names, targets):
        longest = max(len(WORD.findall(r.text or "")) for r in before if r.source == s)
        assert abs(size(after, s) - target) <= 0.02 * target + longest
    times = {}
    for r in after:
        times[r] = times.get(r, 0) + 1
    assert set(times) <= set(before) and max(times.values()) <= 2


def test_token_files_hold_the_tokenizers_ids(stages):
    from tokenizers import Tokenizer

    _, before, after = stages[4]
    t, start, wanted = Tokenizer.from_file(encoding.vocabulary()), 0, []
    for r in sorted(before, key=lambda r: (r.doc_id, r.text or "")):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after), key=lambda r: r[1]) == wanted


def test_run_chains_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, stages[-1][2]))
