"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Piece lengths lie in 1..capacity, so an instance is a histogram of at most
``capacity`` counts, whatever the corpus.  ``plan`` works on that histogram:

1. Reduction.  For the longest piece j left, a set {j} or {j, k} is fixed for
   good when it provably dominates every other set that holds j: nothing fits
   beside j; or k fills the rest exactly; or k is the longest that fits and
   no two others fit in its place; or three others can't fit and k is at
   least as long as the best two others together.
2. Remainder.  Best-fit decreasing, a whole length class at a time.

The plan is a list of patterns (lengths, how often).  Pieces get their places
by their rank within their length, which is counted in two distributed steps.

Nulls: a null text is empty and still has its end token; a null doc_id is
carried.  Equal rows are packed once each.  An empty table packs nothing.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillstone.llm.arrowtext import ROWS, SLICE, slices
from quillstone.llm.bpe import byte_letters
from quillstone.storage import Scratch, batch_rows

CAPACITY = 1024
END_ID = 2
#: Cached words of a worker in each of two generations; results do not depend on it.
CACHED = 250_000


#: Fixed value: the word pattern of byte-level BPE files.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Cache(dict):
    """Token ids (as bytes) of a text part; parts after the first stand for a space and the part."""

    _PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")

    def __init__(self, plain, lead: str):
        self.plain, self.lead, self.old = plain, lead, {}

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()
        got = self.old.get(part)
        if got is None:
            if part[-1:] in (".", ",") and self._PLAIN.fullmatch(part, 0, len(part) - 1):
                got = self[part[:-1]] + self.plain(part[-1])
            else:
                got = self.plain(self.lead + part)
        if len(part) < 100:
            self[part] = got
        return got


class ByteTokenizer:
    """Ids of the tokenizers library for a byte-level BPE file, cached by word.

    Texts with white space runs, special-token strings or letters outside the
    Latin blocks go to the library whole.
    """

    #: Printable Latin text with single blanks and line ends.
    _KNOWN = re.compile(r"[\n\x20-\x7e\xa1-ɏ‐-‧€]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self._runs = ["  ", " \n", "\n ", "\n\n", *(x.content for x in self.whole.get_added_tokens_decoder().values())]
        self.whole.no_truncation()
        self.whole.no_padding()
        word = self._fast(path) or self._library
        self.first, self.later = _Cache(word, ""), _Cache(word, " ")

    def _fast(self, path: str):
        """A quicker encoder of single words with the same vocabulary, where token ids follow the order of the merges."""
        import tiktoken

        model = json.loads(Path(path).read_text())["model"]
        ids, shown = model["vocab"], byte_letters()
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [ids[a + b] for a, b in parts]
        if order != sorted(set(order)) or model.get("ignore_merges") or len(ids) < 256 + len(order):
            return None
        byte = {c: bytes([b]) for b, c in shown.items()}
        merged = {a + b for a, b in parts}
        ranks = {b"".join(byte[c] for c in t): i for t, i in ids.items() if t in merged or len(t) == 1 and t in byte}
        quick = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: array("I", quick.encode_ordinary(text)).tobytes()

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self._runs) or text[0] in " \n" or text[-1] in " \n" or not self._KNOWN.fullmatch(text):
            return self._library(text)
        lines = text.split("\n")
        new_line = self.first["\n"]
        later = self.later.__getitem__
        out = []
        for k, line in enumerate(lines):
            if k:
                out.append(new_line)
            head, *rest = line.split(" ")
            out.append(self.first[head])
            out += map(later, rest)
        return b"".join(out)


@cache
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents with their end token, cut where longer than a sequence; the first piece takes the odd length."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            tok, rows = tokenizer(path), []
            end = np.array([end_id], "<u4").tobytes()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tok.encode(text or "") + end
                n = len(ids) // 4
                at, size = 0, n % capacity or capacity
                k = 0
                while at < n:
                    rows.append((i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, size, k = at + size, capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """The sets fixed by dominance, and the counts that remain."""
    left = {k: n for k, n in counts.items() if n}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            left[x] -= times
            if not left[x]:
                del left[x]

    def smallest(without: int, k: int) -> list[int]:
        """The k shortest pieces once a piece ``without`` is set aside."""
        got: list[int] = []
        for x in sorted(left):
            got += [x] * min(k - len(got), left[x] - (x == without))
            if len(got) == k:
                break
        return got

    for j in sorted(left, reverse=True):
        while left.get(j):
            rest = capacity - j
            low = smallest(j, 3)
            if not low or low[0] > rest:
                take((j,), left[j])
                continue
            if rest in left and (rest != j or left[j] > 1):
                take((j, rest), left[j] // 2 if rest == j else min(left[j], left[rest]))
                continue
            keys = sorted(left)
            k = keys[bisect.bisect_right(keys, rest) - 1]
            if k == j and left[j] < 2:
                k = max((x for x in keys if x <= rest and x != j), default=0)
            only_one = len(low) < 2 or low[0] + low[1] > rest
            two_at_most = len(low) < 3 or sum(low) > rest
            if only_one or two_at_most and k >= _best_pair(left, j, rest):
                # what was tested sees at most three pieces of a length, so it holds while four are left
                spare = (left[j] - 4) // 2 if k == j else min(left[j], left[k]) - 4
                take((j, k), max(spare, 1))
                continue
            break
    return fixed, left


def _best_pair(left: dict[int, int], j: int, rest: int) -> int:
    """The largest total up to ``rest`` of two pieces other than one piece j."""
    keys = [x for x in sorted(left) if x != j or left[x] > 1]
    best, lo, hi = 0, 0, len(keys) - 1
    while lo <= hi:
        total = keys[lo] + keys[hi]
        if total > rest or lo == hi and left[keys[lo]] - (keys[lo] == j) < 2:
            hi -= 1
        else:
            best = max(best, total)
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over length classes: patterns and how often."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((lengths, times))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                    n %= each
                else:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            lengths, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = min(room // length, n)
            used = min(times, n // each)
            put(room - each * length, lengths + (length,) * each, used)
            if times > used:
                put(room, lengths, times - used)
            n -= each * used
    return [x for room in sorted(open_) for x in open_[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length, runs ``(rank of the first piece, its sequence, its offset)``: piece rank r of a run lies ``r - first`` sequences on."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            rank = seen.get(x, 0)
            runs.setdefault(x, []).append((rank, sequence, at))
            seen[x] = rank + times
            at += x
        sequence += times
    return runs, sequence


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    # a file's rows get ranks within (part, length); parts and lengths are few, so the sums below are small
    with batch_rows(spark, ROWS):
        cut = scratch.keep(pieces(docs, path, capacity, end_id))
    numbered = cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_slots(spark))).cast("int"))
    sums = numbered.groupBy("length", "slot").agg(F.count("*").alias("n"))
    by_length = {r[0]: r[1] for r in sums.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs, _ = places(plan(by_length, capacity))
    below = sums.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = numbered.withColumn("in_slot", F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(below.select("length", "slot", F.coalesce("base", F.lit(0)).alias("base")), ["length", "slot"])

    def locate(batches):
        where = {k: (np.array([x[0] for x in v]), np.array([x[1] for x in v]), np.array([x[2] for x in v])) for k, v in shared.value.items()}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, seq, off = where[int(x)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = seq[k] + rank[rows] - first[k], off[k]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    shared = spark.sparkContext.broadcast(runs)  # bounded by the number of patterns, not by the corpus
    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("in_slot")).alias("rank")).mapInArrow(
        locate, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def _slots(spark) -> int:
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
