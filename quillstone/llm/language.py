"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector, the same everywhere.  A trigram is the
elementwise product of its letters' vectors, rotated by their place; a text
is the sum of its trigrams; a language is the sum of its training texts'
unit vectors.  A text gets the language of greatest cosine.

Nulls: a null text or one without a letter is ``und`` with score 0; rows with
a null lang teach nothing.  Ties go to the first language by name.  Equal
texts get equal results.  Without any training row every text is ``und``; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillstone.llm.arrowtext import SLICE, slices

DIMENSIONS = 1024
#: Training texts that are used of each language, about: a hash of the id picks them.
PER_LANGUAGE = 4000
UNKNOWN = "und"
#: Cells of a dense table of texts and trigrams; beyond it they are added one by one, with the same sums.
DENSE = 1 << 25


@cache
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_letters: dict[int, np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    got = _letters.get(code)
    if got is None:
        if len(_letters) > 20_000:
            _letters.clear()
        got = _letters[code] = np.random.default_rng([20240229, code]).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1
    return got


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of trigram vectors, and whether a text has a letter."""
    n = len(texts)
    parts = [f" {(x or '').lower()} ".encode("utf-32-le", "replace") for x in texts]
    size = np.array([len(p) // 4 for p in parts])
    code = np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(n), size)
    is_letter = _alphabetic()[code]
    # what is no letter counts as a blank, runs of them as one
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1] | (text[1:] != text[:-1])
    code, text, is_letter = np.where(is_letter, code, 32)[keep], text[keep], is_letter[keep]
    has = np.zeros(n, bool)
    has[text[is_letter]] = True
    used = np.flatnonzero(np.bincount(code, minlength=33))
    place = np.zeros(int(used[-1]) + 1, np.int64)
    place[used] = np.arange(len(used))
    c, k = place[code], len(used)
    tri = (c[:-2] * k + c[1:-1]) * k + c[2:]
    inside = (text[:-2] == text[2:]) & has[text[:-2]]
    tri, owner = tri[inside], text[:-2][inside]
    if k**3 <= 1 << 22:
        kinds = np.flatnonzero(np.bincount(tri, minlength=1))
        spot = np.zeros(k**3, np.int64)
        spot[kinds] = np.arange(len(kinds))
        tri = spot[tri]
    else:
        kinds, tri = np.unique(tri, return_inverse=True)
    base = np.stack([letter(int(x)) for x in used])
    out = np.zeros((n, DIMENSIONS), np.float32)
    first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)

    def grams(x: np.ndarray) -> np.ndarray:
        return first[x // (k * k)] * second[x // k % k] * base[x % k]

    if n * len(kinds) <= min(DENSE, 64 * len(tri)):
        count = np.bincount(owner * len(kinds) + tri, minlength=n * len(kinds)).reshape(n, len(kinds)).astype(np.float32)
        for at in range(0, len(kinds), 4096):
            out += count[:, at : at + 4096] @ grams(kinds[at : at + 4096]).astype(np.float32)
        return out, has
    # few trigrams are shared: each text's own ones are added, in blocks of fixed size
    both, times = np.unique(owner * len(kinds) + tri, return_counts=True)
    for at in range(0, len(both), 8192):
        who, what = np.divmod(both[at : at + 8192], len(kinds))
        terms = grams(kinds[what]) * times[at : at + 8192, None].astype(np.float32)
        head = np.flatnonzero(np.diff(who, prepend=-1))
        out[who[head]] += np.add.reduceat(terms, head, axis=0)
    return out, has


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


def profiles(train: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and their unit vectors, from rows ``doc_id, text, lang``."""
    train = train.where("lang is not null and text is not null")
    # one number for each language, sent along as a literal: no text is shuffled by language
    share = {r[0]: min(1.0, per_language / r[1]) for r in train.groupBy("lang").count().collect()}
    if not share:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    picked = train.where(draw < F.element_at(F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)]), F.col("lang"))).select("text", "lang")

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            found, has = vectors(batch.column(0).to_pylist())
            names = np.array(batch.column(1).to_pylist(), object)
            unit = _unit(found)
            for name in sorted({*names[has]}):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([unit[has & (names == name)].sum(0).astype(np.float64).tolist()])], ["lang", "sums"])

    sums = picked.mapInArrow(run, "lang string, sums array<double>")
    flat = sums.select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = flat.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.transform("v", lambda s: s["x"]).alias("v")).orderBy("lang").collect()
    return [r[0] for r in rows], _unit(np.array([r[1] for r in rows]).reshape(len(rows), DIMENSIONS)).astype(np.float32)


def identify(docs: DataFrame, learned: tuple[list[str], np.ndarray], keep: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; with ``keep`` all columns of ``docs``, then ``quillstone_lang`` and ``quillstone_score``."""
    names, protos = learned
    new = ["quillstone_lang", "quillstone_score"] if keep else ["lang_pred", "score"]
    shared = docs.sparkSession.sparkContext.broadcast((names, protos))  # a vector of fixed length for each language
    given = docs if keep else docs.select("doc_id", "text")
    stay = [c for c in given.columns if keep or c != "text"]

    def run(batches):
        names, protos = shared.value
        labels = np.array([*names, UNKNOWN], object)
        for batch in slices(batches, "text", SLICE):
            found, has = vectors(batch.column(batch.schema.get_field_index("text")).to_pylist())
            if len(names):
                cosine = _unit(found) @ protos.T
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
            else:
                best, score = np.zeros(len(has), int), np.zeros(len(has))
            known = has & bool(len(names))
            got = [pa.array(labels[np.where(known, best, len(names))].tolist(), pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in stay), *got], [*stay, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in stay), f"{new[0]} string, {new[1]} double"])
    return given.mapInArrow(run, schema)


def held_out(folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text falls in the fold; a null id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from the rows that are not held out."""
    learned = profiles(docs.where(~held_out()).select("doc_id", "text", "lang"), per_language)
    return identify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows whose text has a language; all columns stay."""
    learned = profiles(docs.where(~held_out()).select("doc_id", "text", "lang"), per_language)
    return identify(docs, learned, keep=True).where(F.col("quillstone_lang") != UNKNOWN).select(*docs.columns)
