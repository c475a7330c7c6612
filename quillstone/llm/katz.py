"""Katz backoff language model: Good-Turing discounts, exactly normalised weights, partitioned tables.

``order`` words at most make an n-gram (3 by default).  p(w | h) is the
discounted share of (h, w) where that n-gram was seen and otherwise
alpha(h) * p(w | h without its first word); where h was not seen, p(w | h) is
p(w | h without its first word).  p(w) is the discounted share of w or, for an
unseen word, all that the discounts left.  alpha(h) is ``(1 - sum of discounted
shares after h) / (1 - sum of the shorter context's p over words seen after
h)``, from the full sums, so the probabilities of the vocabulary and the unseen
word add up to one after every h.  A text begins with one mark: its first word
has a context of that mark, its second of the mark and a word, and so on.

Texts are read once and kept as blocks of word numbers.  Each block sends the
n-grams that it holds, with their training counts, to the partition that owns
them, and gets totals back in the same order:

1. word counts, by word hash; the blocks are written anew with the words' numbers and totals;
2. counts of n-grams of each further length, by their context (all words but
   the last); a context with more than ``max(HOT, tokens / 2**20)``
   occurrences is spread over several partitions by the words after it.  There
   are at most 2**20 such contexts of a length, so their sums may be collected;
3. every block evaluates its own tokens.

An owner also says which n-grams no other block holds.  All that follows such
an n-gram stands in the same block, so longer ones that begin with it are
counted there and not sent.

What is sent are compressed columns of integers, so shuffles stay near the
size of the texts.  Owners are half as many as blocks, up to 2**14; from there
on their number grows as the root of the blocks'.

Counts above ``K`` are not discounted.  Where Good-Turing numbers are missing
or out of range, absolute discounts stand in; where nothing after h is
discounted, one unseen event is added to h's count.  Words are told apart by
64-bit hashes, n-grams by exact numbers from then on (spread contexts, by a
64-bit hash of these).

Nulls: a null text is empty and has its end token only; a row with a null
doc_id is not held out.  Equal rows count each.  Without training rows every
score is 0.  An empty table gives an empty result.  Tables are written when
``score`` is called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.llm.arrowtext import U64, Words, mix, pair, slices
from quillstone.storage import Scratch

K = 5
HOT = 1 << 17
BLOCK_BYTES = 8_000_000
ORDER = 3
#: Owners are half as many as blocks up to this number.
OWNERS = 1 << 14
_SEED = 31337
_END = U64(0x5E17D0C5)
#: The number of the context before the first word.
_BEGIN = np.int64(-1)


def packed(x: np.ndarray) -> bytes:
    """Integers as compressed byte columns."""
    return len(x).to_bytes(8, "little") + bytes([x.itemsize]) + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(b: bytes, kind) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    n, size = int.from_bytes(b[:8], "little"), b[8]
    raw = np.frombuffer(pa.decompress(b[9:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(kind)


def _held(doc_id, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def blocks(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """Texts as numbers of their block's words, most frequent first; ``counts`` are those of the training texts."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", BLOCK_BYTES):
            words = Words(batch.column(1), lower=True)
            n, size = batch.num_rows, np.diff(words.first)
            ids = batch.column(0).to_pylist()
            held = np.array([_held(i, folds, fold) for i in ids])
            # an end token closes each text
            hashes = np.full(len(words) + n, _END, U64)
            hashes[np.arange(len(words)) + np.repeat(np.arange(n), size)] = words.hashes(_SEED)
            kinds, number = np.unique(hashes, return_inverse=True)
            order = np.argsort(-np.bincount(number, minlength=len(kinds)), kind="stable")
            rank = np.empty(len(kinds), np.uint32)
            rank[order] = np.arange(len(kinds), dtype=np.uint32)
            number = rank[number]
            learn = np.repeat(~held, size + 1)
            counts = np.bincount(number[learn], minlength=len(kinds)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 24) + k], pa.int64()),
                    pa.array([ids], pa.list_(batch.schema.field(0).type)),
                    *(pa.array([x], pa.binary()) for x in (held.tobytes(), packed((size + 1).astype(np.uint32)), packed(number), packed(kinds[order]), packed(counts))),
                ],
                ["block", "doc_ids", "held", "sizes", "tokens", "words", "counts"],
            )
            k += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"block long, doc_ids array<{kind}>, held binary, sizes binary, tokens binary, words binary, counts binary")


def _frequencies(totals: np.ndarray) -> list[int]:
    """Number of kinds seen 1 ... K + 1 times."""
    return np.bincount(np.minimum(totals, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def discounts(n: list[int]) -> np.ndarray:
    """d[r] for counts r = 0 ... K + 1 (d[0] unused, 1 beyond K), from the numbers of kinds seen 1 ... K + 1 times."""
    d = np.ones(K + 2)
    one, two = n[0], n[1]
    absolute = one / (one + 2 * two) if one and two else 0.5
    common = (K + 1) * n[K] / one if one else 0.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common != 1 else 0.0
        d[r] = good if 0 < good < 1 else 1 - absolute / r
    return d


class Unigram:
    """p(w) from the count of w: ``tokens`` in all, ``kinds`` seen, and the numbers of kinds seen 1 ... K + 1 times."""

    def __init__(self, tokens: int, kinds: int, frequencies: list[int]):
        self.tokens, self.kinds = tokens, kinds
        self.d = discounts(frequencies)
        lost = sum((1 - self.d[r]) * r * frequencies[r - 1] for r in range(1, K + 1))
        self.total = tokens if lost > 0 else tokens + 1
        self.unseen = (lost if lost > 0 else 1.0) / self.total if tokens else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, K + 1)] * count / max(self.total, 1), self.unseen)


def _first_requests(parts: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpacked(row["words"], U64), unpacked(row["counts"], np.uint32)
                to = (words % U64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edge = np.searchsorted(to[order], np.arange(parts + 1))
                out = [(b, row["block"], packed(words[order[i:j]]), packed(counts[order[i:j]])) for b, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "words", "counts"])

    return run


_ANSWER = "level int, part int, block long, numbers binary, counts binary, alone binary, lost binary, after binary, sums binary, stats array<long>"
_REQUEST = "part int, block long, heads array<binary>, size binary, spread binary, w binary, counts binary, lower binary, totals binary, stats array<long>"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], _KINDS[t]) for i, (n, t) in enumerate(fields)})


def _first_answers(key, table):
    """Totals of the words of one partition, whether one block alone holds each, and its rank (most frequent first)."""
    part = key[0].as_py()
    words = [unpacked(x, U64) for x in table.column("words").to_pylist()]
    counts = np.concatenate([unpacked(x, np.uint32) for x in table.column("counts").to_pylist()])
    kinds, number = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(number, counts, len(kinds)).astype(np.int64)
    alone = np.bincount(number, minlength=len(kinds)) == 1
    order = np.argsort(-total, kind="stable")
    rank = np.empty(len(kinds), np.uint32)
    rank[order] = np.arange(len(kinds), dtype=np.uint32)
    edge = np.cumsum([0, *map(len, words)])
    rows = [
        (1, part, b, packed(rank[number[i:j]]), packed(total[number[i:j]]), packed(alone[number[i:j]]), b"", b"", b"", None)
        for b, i, j in zip(table.column("block").to_pylist(), edge[:-1], edge[1:])
    ]
    return _table(_ANSWER, [*rows, (1, part, None, *[b""] * 6, [int(total.sum()), int((total > 0).sum()), *_frequencies(total)])])


def _heads(columns: list[np.ndarray]) -> np.ndarray:
    """Where a new row begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _key(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value for each context."""
    key = columns[0].view(U64)
    for c in columns[1:]:
        key = pair(key, c.view(U64))
    return key


class _Grams:
    """The different n-grams of one length in a block.

    ``of``: n-gram at each token, -1 where the text is too short for one.
    ``prefix``, ``suffix``: n-grams one shorter.  ``columns``: their words.
    ``total``: training count in all blocks, ``alone``: no other block holds
    it, ``share``: discounted share, ``p``: probability of the last word.
    """

    def __init__(self, of, columns, total=None, alone=None, share=None):
        self.of, self.columns, self.total, self.alone, self.share, self.p = of, columns, total, alone, share, share


def _numbered(parts: int, schema: pa.Schema):
    """Blocks whose words have numbers and totals in place of hashes."""

    def run(key, left, right):
        answers, out = right.to_pylist(), []
        for row in left.to_pylist():
            words = unpacked(row["words"], U64)
            number, total, alone = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
            to = (words % U64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(parts + 1))
            for a in answers:
                b = a["part"]
                at = order[edges[b] : edges[b + 1]]
                number[at] = unpacked(a["numbers"], np.uint32).astype(np.int64) * parts + b
                total[at], alone[at] = unpacked(a["counts"], np.int64), unpacked(a["alone"], bool)
            out.append({**row, "numbers": packed(number), "totals": packed(total), "alone": packed(alone)})
        return pa.Table.from_pylist(out, schema)

    return run


class _Block:
    """A block with the totals of its words; ``add`` forms its longer n-grams in the order in which they are sent, ``resolve`` takes their totals."""

    def __init__(self, row: dict, answers: list[dict], parts: int, begins: int, edge: float, unigram: Unigram):
        self.parts, self.edge, self.answers = parts, edge, answers
        self.tokens = unpacked(row["tokens"], np.uint32).astype(np.int32)
        self.sizes = unpacked(row["sizes"], np.uint32).astype(np.int64)
        self.held = np.frombuffer(row["held"], bool)
        self.learn = np.repeat(~self.held, self.sizes)
        self.start = np.cumsum(self.sizes) - self.sizes
        # the mark before the first word has the last place
        self.number = np.append(unpacked(row["numbers"], np.int64), _BEGIN)
        total, alone = np.append(unpacked(row["totals"], np.int64), begins), np.append(unpacked(row["alone"], bool), False)
        n = self.kinds = len(self.number) - 1
        self.grams = [_Grams(self.tokens, [np.arange(n + 1, dtype=np.int32)], total, alone, unigram.p(total))]

    def add(self) -> _Grams:
        low, n, level = self.grams[-1], self.kinds, len(self.grams) + 1
        before = np.empty_like(low.of)
        before[1:] = low.of[:-1]
        before[self.start] = n if level == 2 else -1
        valid = before >= 0
        kinds, inverse = np.unique(before[valid].astype(np.int64) * (n + 1) + self.tokens[valid], return_inverse=True)
        g = _Grams(np.full(len(before), -1, np.int32), None)
        g.of[valid] = inverse
        g.prefix, g.word = (kinds // (n + 1)).astype(np.int32), (kinds % (n + 1)).astype(np.int32)
        g.suffix = np.empty(len(kinds), np.int32)
        g.suffix[inverse] = low.of[valid]
        g.count = np.bincount(inverse[self.learn[valid]], minlength=len(kinds)).astype(np.uint32)
        g.columns = [*(c[g.prefix] for c in low.columns), g.word]
        at = np.flatnonzero(~low.alone[g.prefix])
        h, w = [self.number[c[at]] for c in g.columns[:-1]], self.number[g.word[at]]
        spread = np.maximum(1, np.ceil(low.total[g.prefix[at]] / self.edge)).astype(np.int64)
        salt = mix(w.view(U64)) % spread.view(U64)
        part = (mix(_key(h) + salt * U64(0x9E3779B97F4A7C15)) % U64(self.parts)).astype(np.int64)
        # n-grams of a context stand together already
        order = np.argsort(part.astype(np.uint16) if self.parts < 1 << 16 else part, kind="stable")
        g.sent, g.h, g.w, g.spread = at[order], [x[order] for x in h], w[order], spread[order]
        g.edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        self.grams.append(g)
        return g

    def resolve(self, d: np.ndarray, hot: tuple) -> None:
        level, low, g = len(self.grams), self.grams[-2], self.grams[-1]
        contexts = len(low.total)
        local = low.alone[g.prefix]
        g.total, g.alone = g.count.astype(np.int64), local.copy()
        after, sums, lost = np.zeros((K, contexts), np.uint32), np.zeros(contexts), np.zeros(contexts, bool)
        for a in self.answers:
            if a["level"] == level:
                i, j = g.edges[a["part"]], g.edges[a["part"] + 1]
                at = g.sent[i:j]
                g.total[at], g.alone[at] = unpacked(a["counts"], np.int64), unpacked(a["alone"], bool)
                head = _heads([x[i:j] for x in g.h])
                h = g.prefix[at[head]]
                lost[h] = unpacked(a["lost"], bool)
                h = h[_backing(g.total[at], head)]
                after[:, h] = unpacked(a["after"], np.uint32).reshape(K, len(h))
                sums[h] = unpacked(a["sums"], np.float64)
        if len(hot[0]):
            many = np.flatnonzero(g.spread > 1)
            where = np.searchsorted(hot[0], _key([x[many] for x in g.h]))
            h = g.prefix[g.sent[many]]
            after[:, h], sums[h], lost[h] = hot[1][:, where], hot[2][where], hot[1][:, where].any(0)
        at = np.flatnonzero(local & (g.total > 0))
        h = g.prefix[at]
        for r in range(1, K + 1):
            after[r - 1] += np.bincount(h[g.total[at] == r], minlength=contexts).astype(np.uint32)
        sums += np.bincount(h, low.share[g.suffix[at]], contexts)
        g.totals, alpha = alphas(low.total, lost | after.any(0), after, sums, d)
        g.share = d[np.minimum(g.total, K + 1)] * g.total / np.maximum(g.totals[g.prefix], 1)
        lower = low.p[g.suffix]
        g.p = np.where(low.total[g.prefix] > 0, np.where(g.total > 0, g.share, alpha[g.prefix] * lower), lower)
        # what is left serves the next length
        g.h = g.w = g.spread = g.sent = None


def _block(row: dict, answers: list[dict], parts: int, begins: int, edge: float, shared) -> _Block:
    """A block with all n-grams whose totals are known."""
    unigram, levels = shared.value
    block = _Block(row, answers, parts, begins, edge, unigram)
    for d, hot in levels:
        block.add()
        block.resolve(d, hot)
    return block


def _requests(parts: int, begins: int, edge: float, shared):
    """N-grams one longer than those whose totals are known, for their owners."""

    def run(rows, answers):
        out = []
        for row in rows:
            block = _block(row, answers, parts, begins, edge, shared)
            low, g = block.grams[-1], block.add()
            for b in range(parts):
                i, j = g.edges[b], g.edges[b + 1]
                if j > i:
                    at, h = g.sent[i:j], [x[i:j] for x in g.h]
                    head = _heads(h)
                    size = np.diff(np.append(head, j - i)).astype(np.uint32)
                    totals = packed(low.totals[low.prefix[g.suffix[at[head]]]]) if len(h) > 1 else b""
                    spread = (g.spread[i:j][head] > 1).astype(np.uint8)
                    out.append((b, row["block"], [packed(x[head]) for x in h], packed(size), packed(spread), packed(g.w[i:j]), packed(g.count[at]), packed(low.total[g.suffix[at]]), totals, None))
            own = _frequencies(g.count[low.alone[g.prefix]])
            if any(own):
                out.append((row["block"] % parts, None, [], *[b""] * 6, own))
        return _table(_REQUEST, out)

    return run


def _owned(level: int, shared):
    """Totals of the n-grams of one partition; per context, the kinds seen 1 ... K times after it and the sum of the shorter context's p over all words seen after it."""

    def lower(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        # a seen n-gram's shorter ones were seen, too: p is their share
        unigram, levels = shared.value
        return unigram.p(counts) if level == 2 else levels[-1][0][np.minimum(counts, K + 1)] * counts / np.maximum(totals, 1)

    def run(key, table):
        part = key[0].as_py()
        rows = table.to_pylist()
        stats = np.sum([r["stats"] for r in rows if r["stats"]] or [[0] * (K + 1)], axis=0)
        rows = [r for r in rows if r["block"] is not None]
        if not rows:
            return _table(_ANSWER, [(level, part, None, *[b""] * 6, [0, 0, *map(int, stats)])])
        size = [unpacked(r["size"], np.uint32) for r in rows]
        all_sizes = np.concatenate(size)
        h = [np.repeat(np.concatenate([unpacked(r["heads"][c], np.int64) for r in rows]), all_sizes) for c in range(level - 1)]
        column = lambda name, kind: np.concatenate([unpacked(r[name], kind) for r in rows])
        w, counts = column("w", np.int64), column("counts", np.uint32)
        order = np.lexsort((w, *h[::-1]))
        new = _heads([x[order] for x in (*h, w)])
        gram = np.empty(len(w), np.int64)
        gram[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(w))))
        total = np.bincount(gram, counts, len(new)).astype(np.int64)
        alone = np.bincount(gram, minlength=len(new)) == 1
        one = order[new]
        ph = [x[one] for x in h]
        head = _heads(ph)
        context = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(new))))
        totals = np.repeat(column("totals", np.int64), all_sizes)[one] if level > 2 else None
        # p is summed in the order of w: the same for all that ask
        after = np.stack([np.add.reduceat((total == r).astype(np.int64), head) for r in range(1, K + 1)])
        lost = after.any(0)
        sums = np.add.reduceat(np.where(total > 0, lower(column("lower", np.int64)[one], totals), 0.0), head)
        out, at = [], 0
        for r, n in zip(rows, size):
            starts = np.cumsum(n, dtype=np.int64)
            mine = gram[at : at + int(starts[-1])]
            where = context[mine[starts - n]]
            back = where[_backing(total[mine], starts - n)]
            out.append((level, part, r["block"], b"", packed(total[mine]), packed(alone[mine]), packed(lost[where]), packed(after[:, back].reshape(-1).astype(np.uint32)), packed(sums[back]), None))
            at += len(mine)
        out.append((level, part, None, *[b""] * 6, [0, 0, *(int(a + b) for a, b in zip(stats, _frequencies(total)))]))
        many = np.flatnonzero(np.repeat(column("spread", np.uint8), all_sizes)[one][head])
        if len(many):
            keys = _key([x[head][many] for x in ph])
            out.append((-level, part, None, packed(keys), b"", b"", b"", packed(after[:, many].reshape(-1).astype(np.uint32)), packed(sums[many]), None))
        return _table(_ANSWER, out)

    return run


def alphas(h_count: np.ndarray, lost: np.ndarray, after: np.ndarray, sums: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context: the denominator of its shares, and its backoff weight where ``after`` and ``sums`` are given."""
    total = np.where(lost, h_count, h_count + 1)
    left = sum((1 - d[r]) * r * after[r - 1] for r in range(1, K + 1))
    return total, np.where(lost, left, 1.0) / np.maximum(total, 1) / np.maximum(1 - sums, 1e-300)


def _backing(totals: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Contexts (by their first n-grams' places) after which an unseen word is asked for: only these need their backoff weight."""
    return np.logical_or.reduceat(totals == 0, head)


def _evaluate(parts: int, begins: int, edge: float, shared, kind: pa.DataType):
    def run(rows, answers):
        unigram = shared.value[0]
        ids, cols = [], []
        for row in rows:
            block = _block(row, answers, parts, begins, edge, shared)
            p = block.grams[0].p[block.tokens]
            for g in block.grams[1:]:
                there = g.of >= 0
                p[there] = g.p[g.of[there]]
            log = np.log10(np.maximum(p, 1e-300))
            c = block.grams[0].total[block.tokens]
            base = np.log10((c + 1) / (unigram.tokens + unigram.kinds + 1))
            ids += row["doc_ids"]
            cols.append((block.held, block.sizes, np.add.reduceat(c > 0, block.start, dtype=np.int64), np.add.reduceat(base, block.start), np.add.reduceat(log, block.start)))
        held, n, known, base, score = (np.concatenate(x) for x in zip(*cols)) if cols else [np.zeros(0)] * 5
        return pa.table(
            {
                "doc_id": pa.array(ids, kind),
                "held_out": pa.array(held.astype(bool)),
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(ids), unigram.tokens, np.int64)),
                "base_score": pa.array(base.astype(np.float64)),
                "score": pa.array(score.astype(np.float64)),
            }
        )

    return run


def owners(blocks: int, least: int) -> int:
    half = blocks // 2
    return max(least, half if half <= OWNERS else int((half * OWNERS) ** 0.5))


def score(docs: DataFrame, folds: int = 7, fold: int = 2, hot: int = HOT, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    The model is learned from the rows whose crc32 of the id is not ``fold``
    modulo ``folds``, with n-grams of ``order`` words at most.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz")
    texts = scratch.keep(blocks(docs, folds, fold))
    parts = owners(texts.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked = texts.select("block", "words", "counts").mapInArrow(_first_requests(parts), "part int, block long, words binary, counts binary")
    words = scratch.keep(asked.repartition(parts, "part").groupBy("part").applyInArrow(_first_answers, _ANSWER))
    stats = _stats(words)
    if stats is None:
        return spark.createDataFrame([], schema)
    unigram, levels = Unigram(stats[0], stats[1], stats[2:]), []
    begins = sum(r[0] for r in texts.select("held").mapInArrow(_training_texts, "n long").groupBy().sum().collect() if r[0])
    edge = max(float(hot), stats[0] / 2**20)
    plain = texts.drop("words", "counts")
    fields = [(f.name, to_arrow_type(f.dataType)) for f in plain.schema.fields] + [(n, pa.binary()) for n in ("numbers", "totals", "alone")]
    numbered = _meet(texts, words.where("block is not null"), parts).applyInArrow(_numbered(parts, pa.schema(fields)), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", numbers binary, totals binary, alone binary")
    numbered = scratch.keep(numbered)
    scratch.drop(texts, words)
    answers, shared = None, spark.sparkContext.broadcast((unigram, levels))
    for level in range(2, order + 1):
        asked = _at_blocks(numbered, answers, parts, _requests(parts, begins, edge, shared), _REQUEST)
        found = scratch.keep(asked.repartition(parts, "part").groupBy("part").applyInArrow(_owned(level, shared), _ANSWER))
        levels = [*levels, (discounts(_stats(found)[2:]), _hot_contexts(found))]
        shared = spark.sparkContext.broadcast((unigram, levels))
        got = found.where("block is not null")
        answers = got if answers is None else answers.unionByName(got)
    return _at_blocks(numbered, answers, parts, _evaluate(parts, begins, edge, shared, to_arrow_type(docs.schema["doc_id"].dataType)), schema)


def _meet(texts: DataFrame, answers: DataFrame, parts: int):
    return texts.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block"))


def _at_blocks(texts: DataFrame, answers: DataFrame | None, parts: int, run, schema: str) -> DataFrame:
    """``run(rows, answers)`` for each block; without answers, no shuffle."""

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run(batch.slice(i, 1).to_pylist(), []).to_batches()

    def met(key, left, right):
        return run(left.to_pylist(), right.to_pylist())

    return texts.mapInArrow(each, schema) if answers is None else _meet(texts, answers, parts).applyInArrow(met, schema)


def _training_texts(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int((~np.frombuffer(x, bool)).sum()) for x in batch.column(0).to_pylist()], pa.int64())], ["n"])


def _stats(table: DataFrame) -> list[int] | None:
    """Sums of the partitions' statistics; one row comes back."""
    flat = table.where("stats is not null").select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    got = {r[0]: r[1] for r in flat.collect()}
    return [int(got[i]) for i in range(K + 3)] if got else None


def _hot_contexts(table: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all partitions for the contexts that are spread; 2**20 at most."""

    def rows(batches):
        for batch in batches:
            for x in batch.to_pylist():
                h = unpacked(x["numbers"], np.int64)
                after = unpacked(x["after"], np.uint32).reshape(K, len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(v) for v in after), pa.array(unpacked(x["sums"], np.float64))], ["h", *(f"n{r}" for r in range(1, K + 1)), "s"])

    flat = table.where("level < 0").select("numbers", "after", "sums").mapInArrow(rows, "h long, " + ", ".join(f"n{r} long" for r in range(1, K + 1)) + ", s double")
    got = flat.groupBy("h").agg(*(F.sum(c).alias(c) for c in flat.columns[1:])).collect()
    key = np.array([r[0] for r in got], np.int64).view(U64)
    by = np.argsort(key)
    return key[by], np.array([r[1:-1] for r in got], np.int64).reshape(len(got), K).T[:, by], np.array([r[-1] for r in got])[by]
