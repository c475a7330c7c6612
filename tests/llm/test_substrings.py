"""Substring dedup on one passage that very many texts share."""

import hashlib
import re
from collections import Counter

PASSAGE = [f"p{i}" for i in range(60)]


def shared(n):
    return [" ".join([*(f"a{k}.{i}" for i in range(k % 9)), *PASSAGE, f"z{k}"]) for k in range(n)] + [" ".join(PASSAGE)] * 2 + ["", None, "alone " * 9]


def plain(texts, window=35):
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = {}
    for k, w in enumerate(words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_growing_table_is_broadcast(spark, monkeypatch):
    from quillstone.llm import substrings

    plans, keep = [], substrings.Scratch.keep
    monkeypatch.setattr(substrings.Scratch, "keep", lambda self, df: plans.append(plan(df)) or keep(self, df))
    texts = shared(300)
    docs = table(spark, texts)
    got = substrings.removals(docs)
    plans += [plan(got), plan(substrings.stripped(docs))]
    assert sum("SortMergeJoin" in p for p in plans) > 4
    # the planner takes these tables for less than its limit of 10 MB, whatever they hold
    assert not [m for p in plans for m in re.findall(r"BroadcastHashJoin \[.*?\], \[.*?\], (?:Inner|LeftOuter)", p)]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == plain(texts)


def test_frequent_window_has_a_row_for_each_block():
    import pyarrow as pa

    from quillstone.llm.substrings import _windows

    text = " ".join(PASSAGE[:40])
    batch = pa.RecordBatch.from_pydict({"sid": range(500), "start": [3] * 500, "text": [text] * 500, "block": [7] * 400 + [8] * 100})
    rows = [r for b in _windows(35)([batch]) for r in b.to_pylist()]
    assert Counter((r["block"], r["n"]) for r in rows) == {(7, 400): 6, (8, 100): 6}
    assert len({(r["a"], r["b"]) for r in rows}) == 6


def test_windows_are_compared_in_both_halves():
    import numpy as np

    from quillstone.llm.substrings import _among

    a, b = np.array([1, 1, 2, 3, 1], np.uint64), np.array([5, 6, 5, 9, 7], np.uint64)
    assert _among(a, b, np.array([1, 3, 1], np.uint64), np.array([7, 8, 5], np.uint64)).tolist() == [True, False, False, False, True]
    assert not _among(a, b, a[:0], b[:0]).any()


def test_stretches_end_with_their_text(spark):
    from quillstone.llm.substrings import removals

    texts = shared(40) + ["a b c", "c", "a b", "b x c", "x " * 50, "c c"]
    for window in (1, 2, 16):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removals(table(spark, texts), window).collect()}
        assert got == plain(texts, window)
