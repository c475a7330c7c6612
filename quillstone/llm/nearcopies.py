"""Near copies: covering SimHash tables, then the exact Jaccard similarity of word shingles.

A text is the set of its five-word shingles (all its words, where they are
fewer), as 64-bit hashes.  Texts of one set are one.  Each set has ``SEEDS``
SimHash fingerprints, and each of these the covering tables of
``simhash.covering_masks(RADIUS)``: two sets meet for sure where any pair of
their fingerprints lies within the radius, and most that lie a little beyond
meet as well.  Sets that meet are compared exactly; groups are the components
of the pairs of at least the similarity.  ``recall`` gives the share of pairs
of a similarity that meet; no pair of lower similarity is ever linked.

Pairs inside a component need no comparison.  So each set is first compared
with one member of its buckets, the one in most buckets, then with others, in
turns of at most one comparison a set; what is open then (pairs of different
components that share a bucket) is compared in full.  Fingerprints that differ
too much for the similarity (by three standard deviations over all their bits)
spare the exact comparison.

Nulls: a null text counts as empty; texts without words are alike; a null
doc_id is carried.  An empty table gives an empty result.  Intermediate tables
are written when the plan is built.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillstone.llm.arrowtext import ROWS, SLICE, U64, Words, mix, slices
from quillstone.llm.simhash import _signed as signed_mask, chosen, covering_masks
from quillstone.operators.components import connected_components
from quillstone.storage import Scratch, batch_rows

SEEDS, RADIUS = 8, 4
#: Turns of comparing each open set with one other before all open pairs are; groups do not depend on it.
TURNS = 2
#: Sets of fewer shingles are always compared exactly.
FEW = 32
_STEP = U64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, n: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and where each text's begin (one more than texts)."""
    words = Words(texts, lower=True)
    h, first = words.hashes(seed), words.first
    count = np.diff(first)
    salt = np.arange(1, n + 1, dtype=U64) * _STEP
    total = np.zeros(len(h), U64)
    for k in range(n):
        total[: max(len(h) - k, 0)] += mix(h[k:] + salt[k])
    keep = np.arange(len(h)) + n <= np.repeat(first[1:], count)
    for d in np.flatnonzero((count > 0) & (count < n)):
        at, m = first[d], int(count[d])
        keep[at] = True
        total[at] = np.add.reduce(mix(h[at : at + m] + salt[:m])) ^ U64(m)
    return mix(total[keep]), np.concatenate([[0], np.cumsum(np.where(count > 0, np.maximum(count - n + 1, 1), 0))])


def fingerprints(values: np.ndarray, first: np.ndarray, seeds: int = SEEDS) -> np.ndarray:
    """``seeds`` SimHash fingerprints of each of the sets ``values[first[i]:first[i + 1]]``; those of empty sets are zero."""
    out = np.zeros((len(first) - 1, seeds), U64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    size = np.diff(first)[full]
    # ones are counted in the eight bytes of a word, in runs of 255 values at most
    runs = -(-size // 255)
    run = np.cumsum(runs) - runs
    start = np.repeat(first[full], runs) + 255 * (np.arange(runs.sum()) - np.repeat(run, runs))
    lanes, salts = U64(0x0101010101010101), np.arange(seeds, dtype=U64) * _STEP
    for s in range(seeds):
        h = mix(values + salts[s])
        for k in range(8):
            ones = np.add.reduceat((h >> U64(k)) & lanes, start).view(np.uint8).reshape(-1, 8)
            more = np.add.reduceat(ones.astype(np.int64), run, axis=0) * 2 > size[:, None]
            out[full, s] |= np.ascontiguousarray(more.view(np.uint8)).view(U64)[:, 0] << U64(k)
    return out


def recall(similarity: float, seeds: int = SEEDS, radius: int = RADIUS, bits: int = 64) -> float:
    """The expected share of pairs of sets of equal size and this similarity that meet."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    rank = radius + 1
    one = 0.0
    for d in range(bits + 1):
        # random vectors span the space, so that no table is left, with this probability
        span = math.prod(1 - 2.0 ** (i - d) for i in range(rank)) if d >= rank else 0.0
        one += math.comb(bits, d) * p**d * (1 - p) ** (bits - d) * (1 - span)
    return 1 - (1 - one) ** seeds


def most_apart(similarity: float, bits: int) -> int:
    """Differing bits that two sets of this similarity have more than once in 700 times, and more similar ones more rarely."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))


def _signatures(docs: DataFrame, n: int, seeds: int) -> DataFrame:
    """``doc_id, quillstone_mark, key`` (of the set)``, size, fps``."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            values, first = shingles(batch.column(1), n)
            sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
            sizes = np.array([len(x) for x in sets], np.int32)
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            got = fingerprints(np.concatenate(sets) if sets else values, np.concatenate([[0], np.cumsum(sizes)]), seeds).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * seeds), pa.array(got.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes), lists], ["doc_id", "quillstone_mark", "key", "size", "fps"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "quillstone_mark").mapInArrow(run, f"doc_id {kind}, quillstone_mark long, key binary, size int, fps array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``no, set`` (sorted hashes) of ``no, text``."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            values, first = shingles(batch.column(1), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(values[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["no", "set"])

    return docs.select("no", "text").mapInArrow(run, "no long, set binary")


def _keys(fps: Column, radius: int) -> Column:
    """The keys of all tables of all fingerprints."""
    masks = F.array(*[F.lit(signed_mask(m)) for m in covering_masks(radius)])
    return F.flatten(F.transform(fps, lambda fp, s: F.transform(masks, lambda m: F.xxhash64(s, m, fp.bitwiseAND(m)))))


def _in_company(batches):
    """Of rows ``h, no`` in order of h: those that share their h with another row."""
    h, no, before = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        if batch.num_rows:
            h, no = np.concatenate([h, batch.column(0).to_numpy()]), np.concatenate([no, batch.column(1).to_numpy()])
            same = h[1:] == h[:-1]
            good = same.copy()
            good[1:] |= same[:-1]
            good[:1] |= before
            # the last row waits for the next batch
            yield pa.RecordBatch.from_arrays([pa.array(h[:-1][good]), pa.array(no[:-1][good])], ["h", "no"])
            before = bool(same[-1]) if len(same) else before
            h, no = h[-1:], no[-1:]
    if before:
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(no)], ["h", "no"])


def _with_first(batches):
    """Of rows ``h, rank, no, label`` in order of h: each with the first of its h, where their labels differ."""
    h = first = None
    for batch in batches:
        if batch.num_rows:
            now, rank, no, label = (batch.column(k).to_numpy() for k in range(4))
            new = np.ones(len(now), bool)
            new[1:] = now[1:] != now[:-1]
            new[0] = first is None or now[0] != h
            head = np.flatnonzero(new)
            lead = np.stack([rank[head], no[head], label[head]])
            at = np.cumsum(new) - 1
            if not new[0]:
                # the first group goes on from the batch before
                lead, at = np.concatenate([first, lead], axis=1), at + 1
            h, first = now[-1], lead[:, -1:]
            good = lead[2][at] != label
            yield pa.RecordBatch.from_arrays([pa.array(no[good]), pa.array(lead[0][at][good]), pa.array(lead[1][at][good])], ["no", "rank", "v"])


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u, v, good``: whether the sets of each pair have the similarity."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(good, pa.bool_())], ["u", "v", "good"])

    def end(name: str, other: str) -> DataFrame:
        return sets.select(F.col("no").alias(name), F.col("set").alias(other))

    return pairs.join(end("u", "a"), "u").join(end("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, good boolean")


def _may_be_similar(similarity: float, seeds: int) -> Column:
    """False where sizes or fingerprints (``size, fp0 ...`` against ``size_v, fp0_v ...``) rule the similarity out."""
    low, high = F.least("size", "size_v"), F.greatest("size", "size_v")
    apart = sum(F.bit_count(F.col(f"fp{s}").bitwiseXOR(F.col(f"fp{s}_v"))) for s in range(seeds))
    return (low / high >= similarity) & ((low < FEW) | (apart <= most_apart(similarity, 64 * seeds)))


def keep_dissimilar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, seeds: int = SEEDS, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, the one of smallest doc_id; all columns stay."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "nearcopies")
    marked = docs.withColumn("quillstone_mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    with batch_rows(spark, ROWS):
        signed = scratch.keep(_signatures(marked, shingle, seeds))
    # numbers are fixed once the table is written
    distinct = scratch.keep(signed.groupBy("key", "size", "fps").agg(F.min(F.struct("doc_id", "quillstone_mark")).alias("low")).withColumn("no", F.monotonically_increasing_id()).drop("key"))
    scratch.drop(signed)
    prints = distinct.select("no", "size", "fps")
    # a small table becomes many rows here: dealt out first, so that all tasks share the work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = distinct.where("size > 0").repartition(parts, "no").select(F.explode(_keys(F.col("fps"), radius)).alias("h"), "no")
    met = each.repartition("h").sortWithinPartitions("h").mapInArrow(_in_company, "h long, no long")
    # one row a set, with its buckets: as many as there are tables, at most
    nodes = scratch.keep(met.groupBy("no").agg(F.collect_list("h").alias("hs")))
    needed = distinct.join(nodes, "no", "left_semi").select("no", F.col("low.doc_id").alias("quillstone_id"), F.col("low.quillstone_mark").alias("quillstone_mark"))
    plain = marked.select("doc_id", "text", "quillstone_mark")
    texts = plain.join(needed, plain["doc_id"].eqNullSafe(needed["quillstone_id"]) & (plain["quillstone_mark"] == needed["quillstone_mark"])).select("no", "text")
    with batch_rows(spark, ROWS):
        sets = scratch.keep(_sets(texts, shingle).dropDuplicates(["no"]))
    # empty tables of the JVM: those of Python rows start Python workers of another kind, which stay
    none = spark.range(0)
    edges = none.select(F.col("id").alias("u"), F.col("id").alias("v"))
    found = none.select(F.col("id").alias("node"), F.col("id").alias("component"))
    for turn in range(TURNS + 1):
        named = nodes.join(found.withColumnRenamed("node", "no"), "no", "left").select("no", F.size("hs").alias("degree"), F.coalesce("component", "no").alias("label"), "hs")
        rows = named.select("no", "degree", "label", F.explode("hs").alias("h"))
        # only buckets of more than one component have pairs left
        inside = rows.groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("inside"), F.count("*").alias("labels")).where("labels > 1")
        left = inside.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        if not left["pairs"]:
            break
        last = turn == TURNS or turn > 0 and left["pairs"] <= 2 * left["rows"]
        if last:
            # a pair that its fingerprints rule out leaves the join at once
            ends = ["no", "label", "size", *(f"fp{s}" for s in range(seeds))]
            full = named.join(prints, "no").select("no", "label", "size", *(F.col("fps")[s].alias(f"fp{s}") for s in range(seeds)), F.explode("hs").alias("h"))
            full = full.join(inside.select("h"), "h")
            other = full.select("h", *(F.col(c).alias("v" if c == "no" else f"{c}_v") for c in ends))
            pairs = full.join(other, (full["h"] == other["h"]) & (F.col("label") < F.col("label_v")) & _may_be_similar(similarity, seeds)).select(F.least("no", "v").alias("u"), F.greatest("no", "v").alias("v")).distinct()
        else:
            # the set in most buckets comes first in turn 0, a drawn one later
            rank = F.col("degree").cast("long") if turn == 0 else F.xxhash64("no", F.lit(turn))
            ordered = rows.select("h", rank.alias("rank"), "no", "label").repartition("h").sortWithinPartitions("h", F.desc("rank"), "no")
            met = ordered.mapInArrow(_with_first, "no long, rank long, v long")
            pairs = met.groupBy("no").agg(F.max(F.struct("rank", "v")).alias("c")).select(F.col("no").alias("u"), "c.v")
        with batch_rows(spark, ROWS):
            compared = scratch.keep(_compared(pairs, sets, similarity))
        edges = edges.unionByName(compared.where("good").select("u", "v"))
        found = scratch.keep(connected_components(edges))
        if last:
            break
    kept = distinct.join(found.withColumnRenamed("node", "no"), "no", "left").groupBy(F.coalesce("component", "no").alias("component")).agg(F.min("low").alias("k"))
    return chosen(marked, kept.select(F.col("k.doc_id").alias("quillstone_id"), "k.quillstone_mark")).select(*docs.columns)
