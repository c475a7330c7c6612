"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

A word is a run of letters, of digits, or of other visible characters.
N-grams are words, word pairs (a word and itself again are one pair whatever
the word), and triples of word shapes (upper case, capitalised, lower case,
digits, the signs themselves).  Each has a weight at a hash; a text's score is
the logistic function of a bias plus the mean weight of its n-grams.

Nulls: a null text counts as empty; an empty text gets the score of the bias;
rows with a null label teach nothing.  Equal texts get equal scores.  Without
any label every score is 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstone.llm.arrowtext import SLICE, U64, Words, mix, pair, slices
from quillstone.llm.language import held_out

BITS = 18
#: Labelled texts that the model is fitted on, about: a hash of the id picks them.
SAMPLE = 6000
THRESHOLD = 0.3
SCALE = 40.0
_SEED = 60493
#: Kinds of bytes: 0 blank, 1 letter, 2 digit, 3 other.
_KIND = np.full(256, 3, np.int8)
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


class _Tokens(Words):
    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        if not len(self.data):
            return
        kind = _KIND[self.data]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[self.off[:-1][self.off[:-1] < len(kind)]] = True
        at = np.flatnonzero(new)
        to = np.append(at[1:], len(kind))
        seen = kind[at] > 0
        self.start, self.end = at[seen], to[seen]
        self.kind = kind[self.start]
        self.first = np.searchsorted(self.start, self.off)


def ngrams(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, and the text of each (in order)."""
    tok = _Tokens(texts)
    n = len(tok)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = tok.hashes(_SEED)
    owner = np.searchsorted(tok.first, np.arange(n), "right") - 1
    upper = (tok.data >= 65) & (tok.data <= 90)
    total = np.concatenate([[0], np.cumsum(upper)])
    count, size, lead = total[tok.end] - total[tok.start], tok.end - tok.start, upper[tok.start]
    shape = np.where(count == 0, 1, np.where((count == size) & (size > 1), 2, np.where(lead & (count == 1), 3, 4))).astype(U64)
    shape = np.where(tok.kind == 3, h, np.where(tok.kind == 2, U64(5), shape))
    two = np.where(h[:-1] == h[1:], U64(7), pair(h[:-1], h[1:]))
    three = pair(pair(shape[:-2], shape[1:-1]), shape[2:]) if n > 2 else np.zeros(0, U64)
    in_two, in_three = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    values = np.concatenate([h, mix(two[in_two] + U64(11)), mix(three[in_three] + U64(13))])
    owners = np.concatenate([owner, owner[:-1][in_two], owner[:-2][in_three]])
    return (values >> U64(64 - bits)).astype(np.int64), owners


def _features(hashes: np.ndarray, owners: np.ndarray, n: int):
    """Distinct hashes of each text and their shares."""
    order = np.lexsort((hashes, owners))
    o, h = owners[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(o)))
    size = np.bincount(owners, minlength=n)
    offsets = np.searchsorted(o[at], np.arange(n + 1))
    return offsets, h[at], count / size[o[at]]


class FTRL:
    """Follow the regularised leader, per coordinate, for logistic loss; coordinate 0 of ``extra`` is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        n = (1 << bits) + 1
        self.z, self.n = np.zeros(n), np.zeros(n)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        i, x = np.append(i, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def fit(labelled: DataFrame, sample: int = SAMPLE, epochs: int = 3, bits: int = BITS) -> np.ndarray:
    """Weights (the bias last) from rows ``doc_id, text, label``; about ``sample`` of them, drawn by a hash of the id."""
    labelled = labelled.where("label is not null")
    n = labelled.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 30))
    picked = labelled.where(draw < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30)))).select(draw.alias("draw"), "label", "text")

    def features(batches):
        for batch in slices(batches, "text", SLICE):
            offsets, h, x = _features(*ngrams(batch.column(2), bits), batch.num_rows)
            lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in (h.astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *lists], ["draw", "label", "at", "share"])

    def train(batches):
        rows = []
        for batch in batches:
            for y, a, s in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                rows.append((float(y), a.values.to_numpy(), s.values.to_numpy() * SCALE))
        model = FTRL(bits)
        for _ in range(epochs):
            for y, i, x in rows:
                model.update(i, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float64).tobytes()], pa.binary())], ["weights"])

    found = picked.mapInArrow(features, "draw long, label int, at array<int>, share array<double>")
    # the sample is bounded, and its order must not depend on the partitions
    rows = found.repartition(1).sortWithinPartitions("draw", "label").mapInArrow(train, "weights binary").collect()
    return np.frombuffer(rows[0][0]) if rows else np.zeros((1 << bits) + 1)


def score(docs: DataFrame, weights: np.ndarray, keep: bool = False, bits: int = BITS) -> DataFrame:
    """``doc_id, score`` for each row; with ``keep`` all columns of ``docs``, then ``quillstone_score``."""
    new = "quillstone_score" if keep else "score"
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed length
    given = docs if keep else docs.select("doc_id", "text")
    stay = [c for c in given.columns if keep or c != "text"]

    def run(batches):
        w = shared.value
        for batch in slices(batches, "text", SLICE):
            hashes, owners = ngrams(batch.column(batch.schema.get_field_index("text")), bits)
            n = batch.num_rows
            size = np.maximum(np.bincount(owners, minlength=n), 1)
            logit = SCALE * np.bincount(owners, w[hashes], minlength=n) / size + w[-1]
            got = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in stay), got], [*stay, new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in stay), f"{new} double"])
    return given.mapInArrow(run, schema)


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows ``doc_id, text, label``: labelled, and not held out."""
    return docs.where(~held_out()).select("doc_id", "text").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    weights = fit(labelled_texts(docs, labels), sample)
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows that score ``threshold`` or more; all columns stay."""
    weights = fit(labelled_texts(docs, labels), sample)
    return score(docs, weights, keep=True).where(F.col("quillstone_score") >= threshold).select(*docs.columns)
