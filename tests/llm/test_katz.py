"""Katz backoff against a plain restatement with dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from quillstone.llm.katz import K, Unigram, discounts, score


def words(text):
    return [*(text or "").encode().lower().split(), None]


class Plain:
    def __init__(self, texts, order):
        self.count = [Counter() for _ in range(order)]
        for t in texts:
            w = words(t)
            self.count[0].update((x,) for x in w)
            for m in range(2, order + 1):
                marked = [b""] + w
                self.count[m - 1].update(tuple(marked[i : i + m]) for i in range(len(marked) - m + 1))
        self.d = [discounts([sum(v == r for v in c.values()) for r in range(1, K + 2)]) for c in self.count]
        self.n = sum(self.count[0].values())
        self.after = defaultdict(list)
        for c in self.count:
            for g, k in c.items():
                self.after[g[:-1]].append((g[-1], k))

    def p(self, h, w):
        """h: a tuple of words, the mark of the beginning among them."""
        seen = self.after[h]
        if not seen:
            return self.p(h[1:], w) if h else 1.0
        d, n = self.d[len(h)], sum(c for _, c in seen)
        lost = sum((1 - d[min(c, K + 1)]) * c for _, c in seen)
        total = n if lost > 0 else n + 1
        if c := self.count[len(h)][*h, w]:
            return d[min(c, K + 1)] * c / total
        left = (lost if lost > 0 else 1.0) / total
        return left / (1 - sum(self.p(h[1:], x) for x, _ in seen)) * self.p(h[1:], w) if h else left

    def score(self, text):
        w = words(text)
        before = lambda i: tuple(([b""] + w)[max(0, i + 2 - len(self.count)) : i + 1]) if len(self.count) > 1 else ()
        return sum(math.log10(self.p(before(i), x)) for i, x in enumerate(w))


TEXTS = ["the cat sat on the mat", "The cat sat on the hat", "a dog sat", "", None, "the the the the the the the the the the", "cat", "the cat sat on the mat", "a cat and a dog and a cat", "unseen words here\tand\nthere", "x y x y x y x y x y x y x y x y"] * 2


@pytest.mark.parametrize(("hot", "order"), [(1 << 17, 3), (3, 3), (1 << 17, 1), (2, 2), (2, 4)])
def test_scores_match_plain(spark, hot, order):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "the cat", "y"), (5, "the cat sat", "z")]
    got = score(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), hot=hot, order=order).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    model = Plain([t for i, t, _ in rows if not held(i)], order)
    want = []
    for i, t, _ in rows:
        w = words(t)
        want.append((str(i), held(i), len(w), sum(model.count[0][x,] > 0 for x in w), model.n, sum(math.log10((model.count[0][x,] + 1) / (model.n + len(model.count[0]) + 1)) for x in w), model.score(t)))
    key = lambda r: (r[0], r[2], round(r[6], 6))
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for a, b in zip(sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_shares_add_up_to_one():
    model = Plain(TEXTS, 3)
    kinds = [w for w, in model.count[0]] + [b"never seen"]
    for h in [*model.after, (b"never seen",), (b"the", b"never seen")]:
        if len(h) < 3:
            assert sum(model.p(h, w) for w in kinds) == pytest.approx(1)
    assert Unigram(0, 0, [0] * (K + 1)).unseen == 1


def test_empty_table(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
