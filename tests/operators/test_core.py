import json
import random
import re
import struct
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.operators import calibration as C, citations as N, claims as K, components as G, dataset as D, families as M, lookup as L, policy as P, retrieval as R, spans as S, structure as X


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 200), (None, 3), (300, 301), (300, 301)]
    got = {r.node: r.component for r in G.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 300, 301: 300}
    assert G.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_component_of(spark):
    draw = random.Random(4)
    numbers = [draw.choice([draw.randrange(40), draw.randrange(10 ** draw.randint(1, 17))]) for _ in range(60)] + [0, 1, 10, 100, 10**17 - 1]
    pairs = [(draw.choice(numbers), draw.choice([None, *range(70)])) for _ in range(150)] + [(None, 3), (7, None), (0, 500), (10, 500), (1, 501), (100, 501)] + [(k, 1000 + j) for k in range(2000, 2030) for j in (k, k + 1)]

    def want(pairs):
        up = {}
        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x
        for u, p in pairs:
            if u is not None and p is not None:
                up[top(f"doc:{u}")] = top(f"src:{p}")
        low = {}
        for u in [x for x in up if x.startswith("doc:")]:
            low[top(u)] = min(low.get(top(u), u), u)
        return {u[4:]: low[top(u)] for u in up if u.startswith("doc:")}

    for more in ([], [(-5, 1)], [(10**17, 2)]):
        frame = spark.createDataFrame(pairs + more, "a long, b int")
        for f in (frame, frame.withColumn("a", F.col("a").cast("string")), frame.withColumn("b", F.concat(F.lit("x"), "b"))):
            rows = D.component_of(f, "a", "b").collect()
            assert {r.a: r.component for r in rows} == want(pairs + more) and len(rows) == len(want(pairs + more))
    assert D.component_of(frame.where("false"), "a", "b").collect() == []


def test_groups_need_no_rounds(spark, monkeypatch):
    """Nodes of one group each, and groups whose centres agree, are labelled without contraction."""
    monkeypatch.setattr(G, "connected_components", None)
    frame = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") % 70).alias("b"))
    want = {}
    for i in range(3000):
        want[i % 70] = min(want.get(i % 70, str(i)), str(i))
    assert {r.a: r.component for r in D.component_of(frame, "a", "b").collect()} == {str(i): f"doc:{want[i % 70]}" for i in range(3000)}


def test_greedy_fill(spark):
    def fill(costs, budget):
        return spark.range(1).select(R.greedy_fill(F.array(*map(F.lit, costs)), budget).alias("x")).first().x

    assert fill([500, 10], 380) == [0] and fill([300, 200, 80, 5], 380) == [0, 2] and fill([100, 300, 200, 80], 380) == [0, 2, 3]


def test_chunks(spark):
    long = " ".join(f"Mening nummer {i} har ett antal ord i sig här." for i in range(60))
    d = spark.createDataFrame([(1, "Kort rubrik som är lång\n\n" + "x" * 130 + "\n\n" + long), (2, None), (3, "tunn")], "doc_id long, text string")
    rows = R.chunks(d).orderBy("doc_id", "p", "k").collect()
    assert [r.p_idx for r in rows if r.doc_id == 1][:3] == [0, 1, 200] and all(len(r.text) >= 800 for r in rows if r.p == 2 and r.doc_id == 1 and r.k < 2)
    assert " ".join(r.text for r in rows if r.doc_id == 1 and r.p == 2) == long
    merged = [r.text for r in R.merge_short(d).where("doc_id = 1").orderBy("index").collect()]
    assert merged[0] == "Kort rubrik som är lång\n\n" + "x" * 130


def test_bm25_pairs_are_not_shuffled(spark, monkeypatch):
    draw = random.Random(6)
    text = lambda: " ".join(draw.choice("abcdefghijklmnop") * draw.randint(1, 2) for _ in range(draw.randint(0, 12)))
    q = spark.createDataFrame([(i, text()) for i in range(12)] + [(50, None)], "query_id long, text string")
    d = spark.createDataFrame([(i, text()) for i in range(300)] + [(400, None)], "doc_id long, text string")
    monkeypatch.setattr(R, "DOCS", 40)
    here = R.bm25(q, d)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((?:query_id|term)#\d+L?, doc_id", plan) and "hashpartitioning(doc_id" in plan and here.rdd.getNumPartitions() == 8
    monkeypatch.setattr(R, "SENT", 0)
    dealt = R.bm25(q, d)
    assert "hashpartitioning(query_id" in dealt._jdf.queryExecution().executedPlan().toString()
    one, two = ({(r.query_id, r.doc_id): round(r.score, 9) for r in x.collect()} for x in (here, dealt))
    assert one == two and len(one) > 1000


def test_bm25_multiplicity(spark):
    q = spark.createDataFrame([(1, "a a b")], "query_id long, text string")
    d = spark.createDataFrame([(1, "a b c"), (2, "b"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in R.bm25(q, d).collect()}
    once = {r.doc_id: r.score for r in R.bm25(spark.createDataFrame([(1, "a b")], "query_id long, text string"), d).collect()}
    assert got[1] > once[1] and got[2] == once[2] and set(got) == {1, 2}


def test_spans(spark):
    s = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 2, 9), (1, 3, 6, 8), (1, 4, 0, 3)], "k long, id long, start long, end long")
    assert sorted(r.id for r in S.outermost(s, ["k"]).collect()) == [1, 3]
    parts = S.segments(s, ["k"]).orderBy("start").collect()
    assert [(r.start, r.end, r.ids) for r in parts] == [(0, 2, [1, 4]), (2, 3, [1, 2, 4]), (3, 5, [1, 2]), (5, 6, [2]), (6, 8, [2, 3]), (8, 9, [2])]
    t = s.withColumn("targets", F.array("id"))
    assert len(S.merge_adjacent(t, ["k"]).collect()) == 4


def test_thresholds(spark):
    rows = [(i, [0.9, 0.1], 0) for i in range(40)] + [(100 + i, [0.6, 0.4], 1) for i in range(20)] + [(200, [0.2, 0.8], 1)]
    frame = C.predictions(spark.createDataFrame(rows, "id long, probs array<double>, target int"))
    got = {r["class"]: r for r in C.fail_closed_thresholds(frame, 2, 0.9, least=30).collect()}
    assert got[0].threshold == 0.9 and got[0].accepted == 40 and got[0].reason is None
    assert got[1].threshold == C.DISABLED and got[1].reason == "insufficient_accepted_examples"
    strict = {r["class"]: r.reason for r in C.fail_closed_thresholds(frame, 2, 0.99, least=30).collect()}
    assert strict[0] == "wilson_bound_unmet"
    logits = spark.createDataFrame([([2.0, 0.0], 0), ([2.0, 0.0], 0), ([2.0, 0.0], 0), ([2.0, 0.0], 1)], "logits array<double>, target int")
    assert C.fit_temperature(logits) == pytest.approx(2 / 1.0986, rel=0.02)


def test_policies(spark):
    s = spark.createDataFrame([(1, 0, 0.95, 0.03, 0.02), (2, 0, 0.95, 0.0, 0.05), (2, 1, 0.1, 0.1, 0.8), (3, 0, 0.02, 0.03, 0.95), (4, 0, 0.1, 0.85, 0.05), (5, 0, 0.75, 0.2, 0.05)], "id long, index int, entailment double, neutral double, contradiction double")
    assert {r.id: r.status for r in P.three_label(s, ["id"]).collect()} == {1: "correct", 2: "abstain", 3: "incorrect", 4: "missing", 5: "abstain"}
    f = spark.createDataFrame([(1, "found"), (1, "invalid"), (2, "found"), (2, "strange"), (3, "pending")], "id long, status string")
    assert {r.id: r.status for r in P.severity(f, ["id"]).collect()} == {1: "invalid", 2: "found", 3: "pending"}


def test_dataset(spark):
    src = "array<struct<citation:string,source_id:string,document_id:string,text:string>>"
    rows = [("a", "train", "Claim", [("NJA (intilliggande)", "s1", "d1", "t")], "supported", "o1", "c1"), ("a", "test", "Claim", [("NJA (intilliggande)", "s1", "d1", " t ")], "incorrect", "d1", "c2")]
    found = D.audit(spark.createDataFrame(rows, f"id string, split string, claim string, sources {src}, label string, origin_document_id string, origin_claim_id string"))
    assert {k: v.count() for k, v in found.items()} == {"synthetic_label_marker": 2, "conflicting_exact_pairs": 1, "duplicate_row_ids": 1, "partition_leakage": 4, "origin_source_cross_role": 1}
    assert D.pack_components([("a", 6), ("b", 3), ("c", 1)], {"x": 0.5, "y": 0.5}) == {"a": "x", "b": "y", "c": "y"}
    kept = spark.range(1).select(D.drop_covered(F.array(*map(F.lit, ["1:1#K2", "1:1#K2P3", "2:2", "2:2#P1", "3:3"]))).alias("x")).first().x
    assert kept == ["1:1#K2P3", "2:2#P1", "3:3"]


def test_split_components(spark):
    rng = random.Random(5)
    for ratios in ({"x": 0.5, "y": 0.25, "z": 0.25}, {"a": 0.75, "b": 0.1, "c": 0.075, "d": 0.075}, {"p": 0.62, "q": 0.38}, {"all": 1.0}):
        sizes = [(i, int(rng.paretovariate(0.9))) for i in range(3000)]
        target, held = D._targets(sum(n for _, n in sizes), ratios), {p: rng.randrange(400) for p in ratios}
        for n, times in ((1, 0), (3, 1), (7, 50), (1, 2000)):
            slow = dict(held)
            for _ in range(times):
                slow[min(slow, key=lambda p: slow[p] / target[p])] += n
            assert D.advance(held, target, n, times) == slow
        got = D.split_components(spark.createDataFrame(sizes, "component long, n long").repartition(5), ratios).collect()
        assert {r.component: r.split for r in got} == D.pack_components(sizes, ratios) and len(got) == 3000
    # more components than the driver could be asked to hold one by one
    many = spark.range(300_000).select(F.col("id").alias("component"), (1 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("n"))
    want = D.pack_components([(r.component, r.n) for r in many.collect()], {"x": 0.5, "y": 0.3, "z": 0.2})
    assert {r.component: r.split for r in D.split_components(many, {"x": 0.5, "y": 0.3, "z": 0.2}).collect()} == want
    assert D.split_components(many.where("false"), {"x": 1.0}).collect() == []


def test_offset_map_in_parts(spark):
    texts = ["Ett ord  och\r\n\r\nett \t\n till\n" * 300, None, "", " ", "x\u00a0y\n\n\n📄 z"] * 60
    tracemalloc.start()
    sizes, got = [], []
    for part in X.offset_maps([pa.array(texts)], 20_000):
        sizes.append(len(part))
        got += [(len(x["text"]), len(x["offsets"]), x["offsets"][-1]) for x in part.slice(0, 5).to_pylist()]
    assert sum(sizes) == 300 and max(sizes) <= 15 and tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()
    assert all(n == m - 1 for n, m, _ in got)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").coalesce(1).select("doc_id", X.offset_map("text").alias("m")).collect()

    def slow(text):
        out, at = [], []
        for m in re.finditer(r"\s+|\S", text):
            new = m[0] if not m[0].isspace() else "\n\n" if len(re.findall(r"\r\n|\r|\n", m[0])) > 1 else " "
            out.append(new)
            at += [m.start()] * len(new)
        return "".join(out), [*at, len(text)]

    want = {x: slow(x or "") for x in texts[:5]}
    assert len(rows) == 300 and all((r.m.text, r.m.offsets) == want[texts[r.doc_id]] for r in rows)


def test_cited_claims_in_one_pass(spark):
    texts = ["Köparen ansvarar. Det gäller även här (se 1 § avtalslagen).", "Inget här.", None, "Säljaren svarar (NJA 2013 s. 502). (Jfr prop. 1999/2000:12 s. 4.)\n\nDetta gäller enligt 3 och 4 §§ köplagen, t.ex. när varan saknas."]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = K.cited_claims(docs)
    want = K.claims(docs.join(N.extract(docs), "doc_id"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.schema == want.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 6


def test_structure(spark):
    md = "## [1 kap.](#K1)\n\n**1 §** Ett.\n\n**2 §** Två.\n\n## [2 kap.](#K2)\n\n**1 §** Tre.\n\nMer.\n\n### R\n\n**1 a §** Fyra."
    assert X.slice_provision(md, "K2P1") == "**1 §** Tre.\n\nMer." and X.slice_provision(md, "K2P1a") == "**1 a §** Fyra." and X.slice_provision(md, "P2") == "**2 §** Två." and X.slice_provision(md, "K9P1") is None
    doc = "# NJA 2013 s. 502\n\nReferat.\n\n## Högsta domstolen\n\n### Domskäl\n\nSkäl ett.\n\n### Domslut\n\nAvslag.\n\nLagrum: 1 §"
    rows = X.judgment_paragraphs(spark.createDataFrame([(1, doc)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.court, r.role, r.text) for r in rows][1:] == [("högsta domstolen", "reasoning", "Skäl ett."), ("högsta domstolen", "decision", "Avslag."), ("högsta domstolen", "metadata", "Lagrum: 1 §")]
    text = "📄 a \r\n\r\n b  c"
    new, at = X.whitespace_with_offsets(text)
    assert new == "📄 a\n\nb c" and all(text[at[i]] == c for i, c in enumerate(new) if not c.isspace()) and len(at) == len(new) + 1
    record = b"LUR1\x10" + struct.pack(">I", 2) + struct.pack(">IHI", 7, 3, 0xFFFFFFFF) + b"a#1" + struct.pack(">IHI", 9, 1, len(z := zlib.compress(b"hej", wbits=-15))) + b"b" + z
    assert X.parse_units(record) == [(7, "a#1", None), (9, "b", "hej")] and X.murmur64(0) == 0
    tree = json.dumps({"type": "dom", "text": "A", "children": [{"type": "p", "text": ["b", {"text": "c"}]}, {"type": "p", "text": ""}]})
    frame = spark.createDataFrame([(1, tree), (2, None)], "doc_id long, tree string")
    assert [r.x for r in frame.select(X.tree_text("tree").alias("x")).collect()] == ["A\n\nbc", None]
    assert [(r.node_id, r.parent_id, r.text) for r in X.flatten_tree(frame).orderBy("node_id").collect()] == [(0, None, "A"), (1, 0, "bc"), (2, 0, "")]
    items = [("Rad", 10.0, 0.0, 100.0), ("ett", 10.0, 20.0, 100.5), ("Rad två", 10.0, 0.0, 88.0), ("Nytt", 10.0, 0.0, 60.0)]
    glyphs = spark.createDataFrame([(1, k, *x) for k, x in enumerate(items)] + [(2, 0, "  ", 9.0, 0.0, 0.0)], "page int, seq int, str string, height double, x double, y double")
    assert {r.page: (r.text, r.low_text) for r in X.page_blocks(glyphs).collect()} == {1: ("Rad ett Rad två\n\nNytt", True), 2: ("", True)}
    html = spark.createDataFrame([(1, "<h1>R</h1><p>a <b>b</b></p><ol><li>x</li><li>y</li></ol>"), (2, None)], "page_id long, html string")
    assert [(r.kind, r.label, r.marker, r.text) for r in X.html_blocks(html).orderBy("ord").collect()] == [("heading", "", "", "R"), ("paragraph", "R", "", "a b"), ("item", "R", "1.", "x"), ("item", "R", "2.", "y")]


def test_claims(spark):
    text = "Avtalet är ogiltigt. Det gäller även här (se 1 § avtalslagen). Slut."
    at = text.index("1 §")
    assert text[slice(*K.claim_around(text, at, at + 16, [(at, at + 16)]))].strip() == "Avtalet är ogiltigt. Det gäller även här (se 1 § avtalslagen)."
    text = "Köparen ska betala. Se 2 § köplagen."
    at = text.index("2 §")
    assert K.claim_around(text, at, at + 12, [(at, at + 12)])[0] == 0
    assert K.hypothesis("Avtalet gäller (se 1 § avtalslagen).", ["1 § avtalslagen"]) == "Avtalet gäller."
    sources = [{"citation": "A", "text": "\n\n".join(f"Stycke {i} om {'hyra' if i == 15 else 'annat'} " + "ord " * 40 for i in range(30))}]
    rows = spark.createDataFrame([("r1", "Hyra ska betalas", sources), ("r2", "Hyra", [{"citation": "B", "text": "kort"}])], "row_id string, claim string, sources array<struct<citation:string,text:string>>")
    got = {r.row_id: r.premise for r in K.windows(rows).collect()}
    assert got["r2"] == "[Källa 1: B]\nkort" and "Stycke 15" in got["r1"] and len(got["r1"].split()) < 300
    full = rows.withColumn("unresolved", F.lit(False)).unionByName(spark.createDataFrame([("r3", "Avtalet är bindande här", [], False), ("r4", "", [], False)], "row_id string, claim string, sources array<struct<citation:string,text:string>>, unresolved boolean"))
    reasons = {r.row_id: r.reason for r in K.verdicts(full).collect()}
    assert reasons["r3"] == "no_sources" and reasons["r4"] == "empty" and len(reasons) == 4


def test_families_and_lookup(spark):
    u = spark.createDataFrame([("prop/1:2#sid9", "prop/1:2#sid10"), ("1:1#K2P3", "1:1#K2P4"), ("dom/nja/1s2#p7", "dom/nja/1s2#p8"), ("coe/005", None)], "s string, w string")
    assert all(r.w == r.g for r in u.select("w", M.adjacent_unit(F.col("s")).alias("g")).collect())
    d = M.teacher_decision(F.lit("a"), F.lit("b"), F.lit(0.9), F.lit(None), F.lit(None))
    assert spark.range(1).select(d.alias("d")).first().d.decision == "reject"
    rows = spark.createDataFrame([(1, "avtalslagen 3 §"), (2, "avtalslagens")], "id long, t string")
    aliases = spark.createDataFrame([("avtalslagen",), ("avtalslagen 3",)], "alias string")
    assert [(r.id, r.alias) for r in L.longest_prefix(rows, "t", "id", aliases).collect()] == [(1, "avtalslagen 3")]
    w = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "k string, w int")
    a, b = (sorted(map(tuple, L.fillers(w, "k", "w", 10, "s").collect())) for _ in range(2))
    assert a == b and len({k for k, _ in a}) == 10
