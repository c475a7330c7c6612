"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprint bit positions get the nonzero vectors of GF(2)^(r+1), in turn.
Each nonzero vector v of that space gives one table whose mask keeps the
positions with inner product 1.  Any r positions leave some v orthogonal to
all their vectors, so every pair of fingerprints within radius r agrees on
the whole mask of that table: no such pair is missed.

Nulls: a null text counts as empty; a null doc_id is carried and never
becomes a component id while its component has another one.  Texts without
words have fingerprint zero and link like any other.  Equal rows stay, each
with the same component.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillstone.llm.arrowtext import slices
from quillstone.operators.components import connected_components
from quillstone.storage import Scratch

#: Buckets up to this many distinct fingerprints compare pairs; larger ones link through shared keys, which is exact as well.
PAIRWISE = 24
#: Shingles of a text that are unpacked at a time; fingerprints do not depend on it.
CHUNK = 100_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, seed)
    ends, ones, n = ends[shingle - 1 :], np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        values = [digest(line[a : b - 1], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        ones += np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, more: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``more``, and ``fp``: the fingerprint as a signed long."""

    def run(batches):
        for batch in slices(batches, "text"):
            got = [fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", *more, "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *more))
    return docs.select("doc_id", "text", *more).mapInArrow(run, f"{kinds}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each nonzero vector of GF(2)^(radius + 1)."""
    size = 1 << (radius + 1)
    given = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, g in enumerate(given) if (g & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints ``fp`` whose components are those of all pairs within the radius.

    A bucket of few fingerprints compares its pairs.  In a larger one each
    fingerprint is keyed by itself with every ``radius`` of the bits outside
    the mask cleared: members of one key differ in those bits only, so a star
    to the smallest loses no link and costs no square.
    """
    masks = covering_masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "key"))
    size = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(size, ["t", "key"])
    few = members.where(F.col("n") <= pairwise)
    a, b = few.select("t", "key", F.col("fp").alias("u")), few.select("t", "key", F.col("fp").alias("v"))
    near = a.join(b, ["t", "key"]).where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v")
    free = [[i for i in range(64) if not m >> i & 1] for m in masks]
    holes = F.array(*[F.array(*[F.lit(_signed(sum(1 << i for i in c))) for c in combinations(f, radius)]) for f in free])
    # the hole masks are picked by table number
    many = members.where(F.col("n") > pairwise).select("t", "key", "fp", F.posexplode(F.element_at(holes, F.col("t") + 1)).alias("hole", "mask"))
    many = many.select("t", "hole", "fp", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    low = many.groupBy("t", "hole", "rest").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    star = many.join(low, ["t", "hole", "rest"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(star).distinct()


def _labelled(fps: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """Rows ``fp, doc_id, ...`` with their ``component`` (a fingerprint) and ``component_id``."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = scratch.keep(links(distinct.select("fp"), radius))
    found = connected_components(edges)
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(lowest, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits)``, component_id`` (smallest reachable doc_id)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.keep(fingerprints(docs, shingle, seed))
    return _labelled(fps, scratch, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group of near duplicates, the one of smallest doc_id; all columns stay."""
    scratch = Scratch(docs.sparkSession, "simhash")
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    fps = scratch.keep(fingerprints(docs.select("doc_id", "text", mark.alias("quillstone_mark")), shingle, seed, more=("quillstone_mark",)))
    kept = _labelled(fps, scratch, radius).groupBy("component").agg(F.min(F.struct("doc_id", "quillstone_mark")).alias("k")).select(F.col("k.doc_id").alias("quillstone_id"), "k.quillstone_mark")
    return chosen(docs.withColumn("quillstone_mark", mark), kept).select(*docs.columns)


def chosen(marked: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows ``doc_id, quillstone_mark, ...`` that ``kept`` names by ``quillstone_id, quillstone_mark``, once each."""
    rows = marked.join(kept, marked["doc_id"].eqNullSafe(kept["quillstone_id"]) & (marked["quillstone_mark"] == kept["quillstone_mark"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "quillstone_mark"])
