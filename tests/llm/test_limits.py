"""Operators against plain restatements, and at the limits of what a table may hold."""

import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import language, nearcopies, quality, substrings
from quillstone.storage import Scratch, batch_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(seed, n=60, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


def test_long_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillstone.llm.bpe import WordBPE

    path = public_tokenizers.path("word_bpe_49k.json")
    mine, library, rng = WordBPE(path), Tokenizer.from_file(path), random.Random(1)
    for n in (65, 500, 20_000):
        text = "".join(rng.choice("abcdefghijklmnoprstuvy") for _ in range(n)) + " a"
        assert [*map(int, mine.encode_batch([text])[0][0].split())] == library.encode(text, add_special_tokens=False).ids
    start = time.time()
    mine.encode_batch(["".join(rng.choice("abcdefghijklmnoprstuvy") for _ in range(1_000_000))])
    assert time.time() - start < 60 and max(map(len, [*mine.cache, *mine.known])) < 1000


def test_many_scripts(monkeypatch):
    from quillstone.llm import language

    rng = random.Random(3)
    texts = ["".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(30)) for _ in range(10_000)]
    start = time.time()
    assert language.vectors(texts)[0].shape == (10_000, language.DIMENSIONS) and time.time() - start < 60
    some = texts[:40] + ["the cat sat on the mat", "", "the the the"]
    dense = language.vectors(some)[0]
    monkeypatch.setattr(language, "DENSE", 0)
    assert (dense == language.vectors(some)[0]).all()


def test_language_is_cosine_of_bound_trigrams(spark):
    from quillstone.llm.language import DIMENSIONS, identify, letter, profiles

    def plain(text):
        w = re.sub(r"[^a-zé]+", " ", f" {text.lower()} ")
        v = np.zeros(DIMENSIONS)
        for x, y, z in zip(w, w[1:], w[2:]):
            v += np.roll(letter(ord(x)), 2).astype(int) * np.roll(letter(ord(y)), 1) * letter(ord(z))
        return v / np.linalg.norm(v)

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcde  é1" if k % 2 else "cdefgh  .") for _ in range(80)) for k in range(40)]
    langs = ["xx" if k % 2 else "yy" for k in range(40)]
    table = docs(spark, texts, langs)
    got = {r.doc_id: r for r in identify(table, profiles(table, 10**6)).collect()}
    means = {x: sum(plain(t) for t, y in zip(texts, langs) if x == y) for x in ("xx", "yy")}
    for k, t in enumerate(texts):
        cosine = {x: float(plain(t) @ m / np.linalg.norm(m)) for x, m in means.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert got[k].lang_pred == best and got[k].score == pytest.approx(max(cosine[best], 0), abs=1e-5)


def test_quality_is_plain_ftrl(spark):
    from quillstone.llm.quality import SCALE, fit, score

    def grams(text):
        words = re.findall(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]+", text)

        def shape(w):
            if w[0].isdigit():
                return 5
            if not w[0].isalpha():
                return w
            upper = sum(c.isupper() for c in w)
            return 1 if not upper else 2 if upper == len(w) > 1 else 3 if upper == 1 and w[0].isupper() else 4

        s = [shape(w) for w in words]
        return [("1", w) for w in words] + [("2", a, b) if a != b else ("2",) for a, b in zip(words, words[1:])] + [("3", *t) for t in zip(s, s[1:], s[2:])]

    def share(text):
        g = grams(text)
        return {x: SCALE * g.count(x) / len(g) for x in sorted(set(g), key=str)}

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["red", "Sea", "GO", "12", "!!", "fog"] if k % 2 else ["red", "sky", "9", "Sea", "."]) for _ in range(12)) for k in range(60)]
    table = docs(spark, texts)
    rows = table.select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label"))
    got = {r.doc_id: r.score for r in score(table, fit(rows, 10**6)).collect()}
    order = [r.doc_id for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)).alias("d")).orderBy("d").collect()]
    z, n = {}, {}

    def weight(i):
        return 0.0 if abs(z.get(i, 0)) <= 0.02 else (np.sign(z[i]) * 0.02 - z[i]) / ((1 + np.sqrt(n[i])) / 0.5 + 0.5)

    def logit(x):
        return weight("bias") + sum(weight(i) * v for i, v in x.items())

    for _ in range(3):
        for k in order:
            x = share(texts[k])
            p = 1 / (1 + np.exp(-logit(x)))
            now = {i: weight(i) for i in [*x, "bias"]}
            for i, v in [*x.items(), ("bias", 1.0)]:
                g = (p - k % 2) * v
                sigma = (np.sqrt(n.get(i, 0) + g * g) - np.sqrt(n.get(i, 0))) / 0.5
                z[i], n[i] = z.get(i, 0) + g - sigma * now[i], n.get(i, 0) + g * g
    assert {k: pytest.approx(1 / (1 + np.exp(-logit(share(t)))), abs=1e-9) for k, t in enumerate(texts)} == got


def spots(text):
    from quillstone.llm.spotsigs import ANCHORS

    words, parts = re.findall(r"[a-z0-9]+", (text or "").lower()), []
    if not words:
        return {text} if text else set()
    run = []
    for k, w in enumerate(words):
        run.append(w)
        if w not in ANCHORS or k == len(words) - 1:
            parts.append(run)
            run = []
    found = {(tuple(p), q[-1] if q else None) for p, q in zip(parts, [*parts[1:], None]) if len(p) > 1}
    return found or {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_is_jaccard_of_plain_sets(spark):
    from quillstone.llm.spotsigs import fingerprint_edits, ranges, similar_sets

    rng = random.Random(6)
    pool = ["the", "of", "is", "a", "und", *(f"w{k}" for k in range(12))]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(60)] + ["", None, "...", "house", "the", "of the"]
    texts += [texts[3] + " the new end", texts[4], texts[5] + " w1"]
    got = {r.doc_id: r for r in fingerprint_edits(docs(spark, texts), 5).collect()}
    for k, t in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[k].near_edited == pytest.approx(jaccard(spots(t), spots(edited))), (t, edited)
        assert got[k].near_next == pytest.approx(jaccard(spots(t), spots(after)))
    assert len({r.fingerprint for r in got.values()}) == len({frozenset(spots(t)) for t in texts})
    assert ranges(docs(spark, texts)) >= 16
    for threshold in (0.8, 0.4):
        members, links = similar_sets(docs(spark, texts), threshold)
        by = {r.doc_id: r.class_id for r in members.collect()}
        assert all(by[i] == min(j for j in range(len(texts)) if spots(texts[j]) == spots(texts[i])) for i in by) and len(by) == len(texts)
        want = {(i, j) for i in set(by.values()) for j in set(by.values()) if i < j and spots(texts[i]) and spots(texts[j]) and jaccard(spots(texts[i]), spots(texts[j])) >= threshold}
        assert {(r.a, r.b) for r in links.collect()} == want and (threshold > 0.5 or want)


def test_packing_fixes_many_pairs_at_once():
    from quillstone.llm.packing import plan, reduce_instance

    counts = {600: 10**9, 500: 10**9, 401: 10**9, 350: 10**9}
    start = time.time()
    fixed, left = reduce_instance(counts, 1024)
    assert len(fixed) < 60 and time.time() - start < 5 and len(plan(counts)) < 100
    for x, n in counts.items():
        assert sum(times * lengths.count(x) for lengths, times in plan(counts)) == n
    assert len(plan({x: 50_000 for x in range(1, 1025)})) < 200_000


def test_clashing_names_stay(spark):
    from quillstone.llm.language import keep_known
    from quillstone.llm.nearcopies import keep_dissimilar
    from quillstone.llm.quality import keep_good
    from quillstone.llm.substrings import stripped

    passage = prose("p", 40)
    texts = [prose(i, 90) for i in range(8)] + [f"x {passage}", f"{passage} y", prose(1, 90), None, ""]
    table = docs(spark, texts)
    for name in ("digest128", "kept_text", "rid", "sid", "key", "no", "h", "size", "fps", "low", "n", "label", "score", "component", "copies", "starts", "a", "b"):
        table = table.withColumn(name, F.concat(F.lit(name), "doc_id"))
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    for kept in (keep_known(table), keep_good(table, labels), keep_dissimilar(table), stripped(table)):
        rows = kept.collect()
        assert kept.columns == table.columns and rows
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in table.columns[5:])


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    import pyarrow as pa

    from quillstone.llm import arrowtext, simhash

    texts = pa.array(["one two  three", "", "four", prose(1, 300)])
    whole, print_ = arrowtext.Words(texts).hashes(7), simhash.fingerprint(texts[3].as_py())
    monkeypatch.setattr(arrowtext, "CHUNK", 11)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert (arrowtext.Words(texts).hashes(7) == whole).all() and simhash.fingerprint(texts[3].as_py()) == print_


def test_large_batches_are_worked_in_small_parts(spark, monkeypatch):
    taken = {}
    frame = docs(spark, ["a"]).withColumn("quillstone_mark", F.lit(0).cast("long"))
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: taken.setdefault(schema, run) and self)
    language.identify(frame, (["en"], np.ones((1, language.DIMENSIONS), np.float32)))
    quality.score(frame, np.zeros((1 << quality.BITS) + 1))
    nearcopies._signatures(frame, 5, nearcopies.SEEDS)
    runs = [*taken.values(), substrings._scan(35, 8)]
    texts = [prose(i, 1000, 5000) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts), pa.array([0] * 1000)], ["doc_id", "text", "quillstone_mark"])
    most = []
    for run in runs:
        tracemalloc.start()
        assert sum(got.num_rows for got in run([batch])) == 1000
        most.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert len(most) == 4 and max(most) < 80, most


def test_written_tables_bound_the_rows_of_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(given):
        for batch in given:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    found = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long")
    for rows, most in [(600, 600), (20_000, 5000)]:
        with batch_rows(spark, rows):
            got = [r.n for r in Scratch(spark, "test").keep(found).collect()]
        assert sum(got) == 5000 and max(got) == most and spark.conf.get(key) == before
