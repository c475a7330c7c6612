"""Near copies of the pipeline's stage against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def parts(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(n, linked):
    parent = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return set(parent)


def likeness(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def edited(rng, words, share):
    return " ".join(f"x{rng.random()}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize("turns", [0, 4])
def test_stage(spark, monkeypatch, turns):
    monkeypatch.setattr(nearcopies, "TURNS", turns)
    rng = random.Random(11)
    texts = ["", None, " ", "a b", "A  b", "a b c", "one two three four five", "One two three four five", "one two three four five six"]
    for k in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 600]))]
        texts += [" ".join(words), edited(rng, words, 0.01), edited(rng, words, 0.02), edited(rng, words, 0.03), edited(rng, words, 0.1), " ".join(words[: len(words) * 4 // 5 + 1]), " ".join(words[: len(words) // 2])]
    base = [f"b{i}" for i in range(200)]
    texts += [edited(rng, base, 0.02) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, frame.unionByName(frame.where("doc_id = 30")), "").collect()
    kept = {r.doc_id for r in got}
    assert len(got) == len(kept) and got[0].__fields__ == frame.columns
    sets = [parts(t) for t in texts]
    prints = nearcopies.fingerprints(*distinct_hashes(texts))
    near = [[max(likeness(a, b), a == b) >= 0.8 for b in sets] for a in sets]
    close = [[sets[i] == sets[j] or bool((np.bitwise_count(prints[i] ^ prints[j]) <= nearcopies.RADIUS).any()) for j in range(len(texts))] for i in range(len(texts))]
    # no pair is linked below the similarity, and none is missed within the radius
    most = groups(len(texts), lambda i, j: near[i][j])
    least = groups(len(texts), lambda i, j: near[i][j] and close[i][j])
    assert most <= kept <= least and len(most) < len(texts)
    assert corpus_pipeline.near_duplicates(spark, frame.where(F.lit(False)), "").collect() == []


def distinct_hashes(texts):
    values, first = nearcopies.shingles(pa.array(texts))
    sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def test_fingerprints_count_bits():
    texts = [" ".join(f"w{k * k % 97} v{k}" for k in range(n)) for n in (0, 1, 2, 5, 200, 3000)]
    values, first = nearcopies.shingles(pa.array(texts))
    got = nearcopies.fingerprints(values, first, 3)
    for i in range(len(texts)):
        for s in range(3):
            h = nearcopies.mix(values[first[i] : first[i + 1]] + np.array([s], np.uint64) * nearcopies._STEP)
            assert int(got[i, s]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))


def test_recall_of_planted_pairs(spark):
    rng = random.Random(5)
    texts, near = [], 0
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(250)]
        texts += [" ".join(words), edited(rng, words, 0.012)]
        near += likeness(parts(texts[-2]), parts(texts[-1])) >= 0.8
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    gone = 600 - nearcopies.keep_dissimilar(frame).count()
    assert near > 200 and 0.93 * near <= gone <= near
    assert 0.6 < nearcopies.recall(0.8) < nearcopies.recall(0.9) < nearcopies.recall(0.95) <= 1


def test_no_table_of_python_rows_is_made(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(900)}" for _ in range(120)]
    texts = [" ".join(words), " ".join(words[:-1]), "a b c"]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    # such a table starts Python workers of its own on the executors
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *given, **more: pytest.fail("rows of Python"))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()} == {0, 2}
