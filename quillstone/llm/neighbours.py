"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative
quantisation) turns vectors into 64-bit codes.  Codes are cut into eight
substrings, each with its own index.  Two codes within Hamming radius r agree
on some substring up to r // 8 bits, so probing all substring values that
near retrieves every code within r; those are ranked again by exact distance.
The radius is the one that held 99.5 % of the true neighbours in the sample,
where neighbours are farther than among all rows.  Where a shard yields fewer
than k codes its radius grows.

All rows are indexed, in shards of bounded size; the stated queries meet each
shard in blocks.  Equal vectors are indexed once with their k + 1 smallest
ids, which is all that any query can need of them.

Vectors that are null, empty, zero, of a length other than the most frequent
one, or that hold null or non-finite components take no part; rows with a
null id neither.  Rows of equal id and vector count once.  Distances that tie
go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillstone.storage import Scratch

BITS, PARTS = 64, 8
#: Vectors that the rotation and the radius are learned from.
SAMPLE = 20_000
SHARD_ROWS = 50_000
BLOCK_QUERIES = 2_000
HELD = 0.995
_VALUES = np.arange(256, dtype=np.uint8)
_APART = np.bitwise_count(_VALUES[:, None] ^ _VALUES[None])


class Codes:
    """The learned rotation: ``mean``, ``axes`` (dimension x 64) and the Hamming ``radius``."""

    def __init__(self, sample: np.ndarray, k: int, rounds: int = 30, seed: int = 7):
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float64)
        self.mean = x.mean(0)
        centred = x - self.mean
        _, _, axes = np.linalg.svd(centred.T @ centred)
        d = min(BITS, x.shape[1])
        main = axes[:d].T
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        flat = centred @ main
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ v).T
        more = rng.normal(size=(x.shape[1], BITS - d))
        self.axes = np.concatenate([main @ turn, more], axis=1)
        self.radius = self._radius(x, k)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x.astype(np.float64) - self.mean) @ self.axes > 0, axis=1, bitorder="little")

    def _radius(self, x: np.ndarray, k: int, queries: int = 256) -> int:
        codes, apart = self.encode(x), []
        for i in range(0, len(x), max(1, len(x) // queries)):
            far = ((x - x[i]) ** 2).sum(1)
            far[i] = np.inf
            near = np.argpartition(far, min(k, len(x) - 1))[:k]
            apart.append(np.bitwise_count(codes[near] ^ codes[i]).sum(1))
        return int(np.quantile(np.concatenate(apart), HELD))


class Shard:
    """The substring indexes of some rows."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(PARTS)]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius."""
        found = np.zeros(len(self.codes), bool)
        for j in range(PARTS):
            at, order = self.start[j], self.order[j]
            for v in np.flatnonzero(_APART[code[j]] <= radius // PARTS):
                found[order[at[v] : at[v + 1]]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]

    def candidates(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        rows = self.within(code, radius)
        while len(rows) < min(least, len(self.codes)):
            radius += PARTS
            rows = self.within(code, radius)
        return rows


def _usable(table: DataFrame) -> DataFrame:
    """``vec_id, embedding``, the rows that take part; embedding as doubles."""
    fine = "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    good = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("embedding") == (sizes[0][0] if sizes else 0))


def nearest(table: DataFrame, is_query, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows to each row where ``is_query`` holds."""
    spark = table.sparkSession
    scratch = Scratch(spark, "neighbours")
    good = _usable(table)
    ids = good.distinct().withColumn("at", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    distinct = scratch.keep(ids.groupBy("embedding").agg(F.sort_array(F.collect_list(F.col("vec_id").cast("long"))).alias("ids")))
    n = distinct.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    drawn = distinct.select("embedding", F.xxhash64("embedding").alias("h")).orderBy("h").limit(SAMPLE).collect()  # bounded
    learned = Codes(np.array([r[0] for r in drawn]), k)
    shards = -(-n // shard_rows)

    def index(key, table):
        x = np.array(table.column("embedding").to_pylist())
        ids = table.column("ids").to_pylist()
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())} | {c: pa.array([v.tobytes()], pa.binary()) for c, v in (("x", x), ("codes", learned.encode(x)), ("size", size), ("ids", flat))})

    def block(key, table):
        ids, q = np.array(table.column("vec_id").to_pylist(), np.int64), np.array(table.column("embedding").to_pylist())
        return pa.table({"query_ids": pa.array([ids.tobytes()], pa.binary()), "q": pa.array([q.tobytes()], pa.binary())})

    by_shard = distinct.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
    indexed = by_shard.groupBy("shard").applyInArrow(index, "shard int, x binary, codes binary, size binary, ids binary")
    asked = good.where(is_query).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").distinct()
    blocks = -(-max(asked.count(), 1) // BLOCK_QUERIES)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int"))
    queries = asked.groupBy("block").applyInArrow(block, "query_ids binary, q binary")
    met = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(indexed, "shard")

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                size, flat = np.frombuffer(row["size"], np.int64), np.frombuffer(row["ids"], np.int64)
                first = np.concatenate([[0], np.cumsum(size)])
                x = np.frombuffer(row["x"]).reshape(len(size), -1)
                shard = Shard(np.frombuffer(row["codes"], np.uint8).reshape(len(size), -1))
                ids = np.frombuffer(row["query_ids"], np.int64)
                qs = np.frombuffer(row["q"]).reshape(len(ids), -1)
                out = []
                for query, q, code in zip(ids.tolist(), qs, learned.encode(qs)):
                    rows = shard.candidates(code, learned.radius, k + 1)
                    far = np.sqrt(((x[rows] - q) ** 2).sum(1))
                    edge = np.partition(far, k)[k] if len(far) > k else np.inf
                    near = np.flatnonzero(far <= edge)
                    found = [(float(far[i]), int(v)) for i in near for v in flat[first[rows[i]] : first[rows[i] + 1]] if v != query]
                    out += [(query, v, s) for s, v in sorted(found)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], ["query_id", "vec_id", "score"])

    near = met.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
