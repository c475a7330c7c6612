"""Budget windows against a plain restatement, with paragraphs over 1,500 characters."""

import math
import random
import re
from collections import Counter

from quillstone.operators import claims as K


def pieces(text):
    out = []
    for p, paragraph in enumerate(x.strip() for x in text.split("\n\n") if len(x.strip()) > 15):
        if len(paragraph) <= 1500:
            out.append((p, paragraph))
            continue
        open_, k = [], 0
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            open_.append(sentence)
            if len(" ".join(open_)) >= 800:
                out.append((p * 100 + k, " ".join(open_)))
                open_, k = [], k + 1
        if open_:
            out.append((p * 100 + k, " ".join(open_)))
    return out


def window(claim, sources, budget=380):
    cost = lambda t: int(len(t.split()) * 1.35) + 5
    heads = [f"[Källa {i + 1}: {s['citation']}]\n" for i, s in enumerate(sources)]
    whole = "\n\n".join(h + s["text"].strip() for h, s in zip(heads, sources))
    if cost(whole) <= budget:
        return whole
    chunks = [(s, p, t) for s, source in enumerate(sources) for p, t in pieces(source["text"])]
    words = [re.findall(r"\w+", t.lower()) for _, _, t in chunks]
    df, mean = Counter(w for ws in words for w in set(ws)), sum(map(len, words)) / len(words)

    def score(ws):
        tf = Counter(ws)
        return sum(math.log((len(chunks) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for w in re.findall(r"\w+", claim.lower()) if w in tf)

    taken, total = [], 0
    for i in sorted(range(len(chunks)), key=lambda i: -round(score(words[i]), 6)):
        c = cost(heads[chunks[i][0]] + chunks[i][2])
        if total + c <= budget or not taken:
            taken, total = [*taken, chunks[i]], total + c
        if total >= budget:
            break
    taken.sort(key=lambda c: c[:2])
    return "\n\n".join(heads[s] + "\n\n".join(t for x, _, t in taken if x == s) for s in sorted({c[0] for c in taken}))


def test_long_paragraphs(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abdefgiklmnorstu", k=6)) for _ in range(400)]

    def paragraph(n):
        return " ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 15))).capitalize() + rng.choice(".!?") for _ in range(n))

    rows = []
    for i in range(25):
        sources = [{"citation": f"C{k}", "text": "\n\n".join(paragraph(rng.choice([1, 3, 25, 60])) for _ in range(rng.randrange(1, 6)))} for k in range(rng.randrange(1, 4))]
        rows.append((f"r{i}", " ".join(rng.choice(vocabulary) for _ in range(12)), sources))
    frame = spark.createDataFrame(rows, "row_id string, claim string, sources array<struct<citation:string,text:string>>")
    assert any(len(p) > 1500 for _, _, s in rows for x in s for p in x["text"].split("\n\n"))
    assert {r.row_id: r.premise for r in K.windows(frame).collect()} == {r: window(c, s) for r, c, s in rows}
    # the relevant part of a paragraph that is too long as a whole reaches the scorer
    long = "Hyran är en sak som nämns. " * 3 + paragraph(80) + " Nyckelordet gäller uppsägning av lokalen. " + paragraph(80)
    one = spark.createDataFrame([("a", "nyckelordet gäller uppsägning", [{"citation": "A", "text": long}])], frame.schema)
    premise = K.windows(one).first().premise
    assert "Nyckelordet" in premise and len(premise) < len(long) / 4
