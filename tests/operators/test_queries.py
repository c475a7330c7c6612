"""A few registered queries against their SQL on the smallest tables, where these are present."""

import os
import random

import duckdb
import pytest

from quillstone import registry
from quillstone.operators import evaluation

SF = "/root/testdata/sf0.001"
NAMES = ["bm25_topk", "budget_window", "span_outermost", "span_sweep_segments", "priority_merge", "leakage_overlap", "policy_three", "threshold_search", "polarity_flip", "valid_time_lookup", "extract_citations", "claim_context", "negative_sample", "judgment_paragraphs", "provision_slice", "pdf_lines", "claim_segments", "joined_units", "run_summary"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        path = f"{SF}/{t}" + ("/*.parquet" if os.path.isdir(f"{SF}/{t}") else "")
        c.execute(f"create view {t.split('.')[0]} as select * from '{path}'")
    return c


def plain(v):
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    run = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in run.fetchall()) and (got or name == "priority_merge")


def test_document_counts_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "REFS", 100)
    draw = random.Random(2)
    rows = [(draw.choice([1, 1, 1, None, *range(2, 60)]), draw.choice(["a", "b", None]), draw.randrange(300), draw.choice([None, 0.0, -0.0, 1.5, float("nan")])) for _ in range(2000)] + [(77, "a", None, None)]
    got = evaluation.document_counts(spark.createDataFrame(rows, "k long, g string, t int, c double"), ["k", "g"], "t", "c")
    assert got.rdd.getNumPartitions() == 21 and "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k, g, t, c in rows:
        one = want.setdefault((k, g), (set(), set()))
        one[0].update([] if t is None else [t])
        one[1].update([] if c is None else [str(c + 0.0)])
    assert {((r.k, r.g), r.targets, r.claims) for r in got.collect()} == {(k, len(t), len(c)) for k, (t, c) in want.items()}
