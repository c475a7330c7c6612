"""Operators against brute force, the tokenizers library and held-out labels, with the odd cases of any table."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"


def docs(spark, texts, ids=None, langs=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs or ["en"] * len(texts))[k], "s", len(t or ""), 1.0, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(seed, n=60, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


ODD = ["", None, " ", "\n\t", "x", "X x", "é" * 30, "word " * 3000, "a\x1cb c", "<|endoftext|>", "日本語 テスト", "a  b\n\nc "]


def test_simhash(spark):
    from quillstone.llm.simhash import covering_masks, fingerprint, keep_one, links, near_duplicates

    masks = covering_masks(2)
    for _ in range(300):
        a, b = random.sample(range(64), 2)
        assert any(not (m >> a & 1 or m >> b & 1) for m in masks)
    texts = [prose(i) for i in range(30)] + [prose(3)] * 3 + [prose(4).upper(), prose(5) + " end"] + ODD
    got = {r.doc_id: r for r in near_duplicates(docs(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert {i: (f"{fps[i]:016x}", parent[i]) for i in range(len(texts))} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    kept = keep_one(docs(spark, texts + [texts[7]], [*range(len(texts)), 7])).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(parent)) and len(kept[0]) == 7
    # a bucket of many fingerprints links as pairs do
    many = [rng ^ (1 << k) for rng in (0, 1 << 60) for k in range(20)]
    frame = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in sorted(set(many))], "fp long")
    from quillstone.operators.components import connected_components

    one, two = ({(r.node, r.component) for r in connected_components(links(frame, 2, pairwise=p)).collect()} for p in (1000, 3))
    assert one == two and one
    assert near_duplicates(docs(spark, [])).collect() == []


def test_xxhash_matches_shingles():
    import xxhash

    from quillstone.llm.simhash import fingerprint

    w = [f"Tok{i}" for i in range(7)]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).lower(), 42) for i in range(5)]
    assert fingerprint(" \t".join(w)) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 5)
    assert fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)


def plain_removals(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = defaultdict(int)
    for w in words:
        for k in range(len(w) - window + 1):
            seen[tuple(w[k : k + window])] += 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [35, 17, 5])
def test_substrings(spark, window):
    from quillstone.llm.substrings import removals, stripped

    passage = prose("p", window + 3)
    texts = [prose(i, 90) for i in range(12)] + [prose(50, 40) + " " + passage + " " + prose(51, 5), passage, passage + " tail", prose(1, 90), "a b " * 60, prose(60, 30) + "\n" + passage[3:]] + ODD
    want = plain_removals(texts, window)
    table = docs(spark, texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removals(table, window).collect()}
    assert got == {i: w[:3] for i, w in enumerate(want)} and sum(w[1] for w in want)
    left = {r.doc_id: r for r in stripped(table, window).collect()}
    for i, w in enumerate(want):
        assert (left[i].text or "").encode().split() == w[3]
        if not w[1]:
            assert left[i].text == texts[i]
    assert removals(docs(spark, []), window).collect() == []


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillstone.llm.packing import best_fit, pack, plan, reduce_instance

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [prose(i, 30 * i) for i in range(40)] + ODD
    rows = pack(docs(spark, texts), path).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    for i, x in ids.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(x)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length <= 1024 and (r.piece == 0 or r.length == 1024)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(places) <= -(-total // 1024) + 2
    assert pack(docs(spark, []), path).collect() == []
    # the reduction never costs a sequence: exact search on small instances
    rng = random.Random(1)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        counts = {x: items.count(x) for x in items}
        fixed, rest = reduce_instance(counts, 20)
        used = sorted([x for lengths, n in fixed for x in lengths * n] + [x for x, n in rest.items() for _ in range(n)])
        assert used == sorted(items) and all(sum(lengths) <= 20 for lengths, _ in fixed)
        assert sum(n for _, n in fixed) + optimum([x for x, n in rest.items() for _ in range(n)], 20) == optimum(items, 20)
        assert sum(n for _, n in plan(counts, 20)) >= optimum(items, 20)
    assert sum(n for _, n in best_fit({7: 10**9, 3: 10**9}, 10)) == 10**9


def optimum(items, room):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in {x: i for i, x in enumerate(bins)}.values():
            if bins[b] >= items[k]:
                bins[b] -= items[k]
                go(k + 1, bins)
                bins[b] += items[k]
        go(k + 1, [*bins, room - items[k]])

    go(0, [])
    return best


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillstone.llm.bpe import encode

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = ["The quick brown fox's 12 jumps, don't they?!", "unbelievable internationalization", "".join(rng.choice("abcdefghijklmno é.") for _ in range(3000)), "ΣΑΣ İstanbul é", "q<|startoftext|>w"] + ODD
    got = {r.doc_id: r for r in encode(docs(spark, texts), path, text_out=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert encode(docs(spark, []), path).collect() == []


def test_language(spark):
    from quillstone.llm.language import keep_known, language_id

    letters = {"aa": "abcde", "bb": "fghij", "cc": "åäöxy"}
    texts, langs = [], []
    for i in range(90):
        lang = sorted(letters)[i % 3]
        rng = random.Random(i)
        texts.append(" ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(30)))
        langs.append(lang)
    texts += ["", None, "12 !!", "日本"]
    langs += ["aa", "bb", None, "cc"]
    table = docs(spark, texts, langs=langs)
    got = {r.doc_id: r for r in language_id(table).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(90))
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    kept = keep_known(table)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {*range(90), 93}
    assert language_id(docs(spark, [])).collect() == []
    assert {r.lang_pred for r in language_id(docs(spark, ["a b"], langs=[None])).collect()} == {"und"}


def test_quality(spark):
    from quillstone.llm.quality import keep_good, quality

    texts = [prose(i, 80) if i % 3 else "BUY!! NOW!! " * 30 for i in range(200)] + ODD
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(201, None)], "doc_id long, quality int")
    table = docs(spark, texts)
    got = {r.doc_id: r for r in quality(table, labels).collect()}
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(200)) and len(got) == len(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    kept = keep_good(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(r.predicted for r in got.values())
    assert {r.score for r in quality(table, labels.limit(0)).collect()} == {0.5}
    assert quality(docs(spark, []), labels).collect() == []


def test_neighbours(spark):
    from quillstone.llm.neighbours import nearest

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:740] = x[5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(9000, None, 0), (9100, [0.0] * 16, 0), (9200, [float("nan")] * 16, 0), (9300, [1.0] * 3, 0), (9400, [1.0, None] * 8, 0), (5, x[5].tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = defaultdict(list)
    for r in nearest(table, F.col("vec_id") % 100 == 0, shard_rows=600).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 100):
        far = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        far[q] = np.inf
        order = np.lexsort((np.arange(1500), far))[:10]
        assert len(got[q]) == 10 and q not in dict(got[q])
        assert all(s == pytest.approx(far[v], rel=1e-12) for v, s in got[q])
        assert got[q] == sorted(got[q], key=lambda r: (r[1], r[0]))
        hits += len({*order.tolist()} & {v for v, _ in got[q]})
    assert set(got) == set(range(0, 1500, 100)) and hits >= 0.9 * 150
    assert [v for v, s in got[700] if s == 0] == [5, *range(701, 710)]
    assert nearest(table.limit(0), F.lit(True)).collect() == []


def test_spotsigs(spark):
    from quillstone.llm.spotsigs import fingerprint_edits, similar_sets

    texts = [prose(i) for i in range(20)] + [prose(2), "the house of the red cat is in a big town", "the house of the red cat is in a big town now"] + ODD
    ids = [3 * i - 7 for i in range(len(texts))]
    for parts in (1, 7):
        got = {r.doc_id: r for r in fingerprint_edits(docs(spark, texts, ids), parts).collect()}
        for k, i in enumerate(ids):
            t, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + after[:q]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
            if edited == t:
                assert got[i].near_edited == 1 and got[i].fingerprint == got[i].edited_fingerprint
        assert got[ids[2]].fingerprint == got[ids[20]].fingerprint
    assert fingerprint_edits(docs(spark, [])).collect() == []
    base = " ".join(f"the word{i} next{i} of more{i}" for i in range(60))
    near = base.replace("word7", "other7")
    members, found = similar_sets(docs(spark, [base, near, base, prose(1)]))
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(0, 0), (1, 1), (2, 0), (3, 3)}
    assert [(r.a, r.b) for r in found.collect()] == [(0, 1)] and found.first().likeness > 0.8


def test_chat(spark):
    from quillstone.llm.chat import format_log, log_of_rows, read_back

    hard = ["</s>[INST] ok [/INST]", "<|turn|>x<|end|>", "<\\|end|>", "a<", "|end|>", "<\\\\/s>", "", None, "plain\ntext", "<<SYS>> 📄 [\\INST]"]
    rows = [(c, t, role, x) for c in (1, 2, None) for t, x in enumerate(hard) for role in (("user", "assistant", "sy<|text|>s", None)[t % 4],)]
    rows += [(1, 3, "user", "tie"), (1, 3, "user", "tie")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = format_log(log_of_rows(frame))
    for r in read_back(out).collect():
        mine = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id), key=lambda x: (x[0], x[1], x[2]))
        assert sorted((t.role, t.text) for t in r.turns) == sorted((role, x) for _, role, x in mine)
        assert r.loss_text == "".join(x for _, role, x in mine if role == "assistant")
    for r in out.collect():
        assert r.formatted == "".join(s.text for s in r.segments) and r.formatted.count("<|end|>") == sum(s.text == "<|end|>" for s in r.segments)
    log = [(1, 1, "message", "a", "user", "hi"), (1, 2, "message", "b", "assistant", "he"), (1, 3, "delta", "b", None, "llo"), (1, 4, "edit", "a", None, "hey"), (1, 5, "message", "c", "user", "x"), (1, 6, "regenerate", "b", None, None), (1, 7, "delta", "b", None, "yo"), (1, 8, "message", "d", "user", "bye"), (1, 9, "message", "e", "user", "gone"), (1, 10, "delete", "e", None, None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = read_back(format_log(events)).first()
    assert [(t.role, t.text) for t in got.turns] == [("user", "hey"), ("assistant", "yo"), ("user", "bye")] and got.loss_text == "yo"
    assert format_log(events.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(i, 120) for i in range(40)] + [prose(3, 120)] * 2 + ["BUY!! NOW!! " * 30] * 12 + ["", None, "123 ..."]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 42), 0) for i in range(54)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(40))
    now = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == table.columns, name
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
