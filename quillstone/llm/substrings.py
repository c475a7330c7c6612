"""Repeated word windows by level-wise doubling.

A window of ``length`` words can only start elsewhere if every part of it
does.  So lengths 8, 16, 32, ... are tested in turn, and only windows whose
part at one length repeats are looked at again at twice that length, until
the windows themselves are compared or no candidate is left.

At each length, a window is tested by one part only: the one with the least
hash.  Equal windows choose equal parts, so a chosen part that occurs once
proves that its windows occur once.  This keeps about one part in
``length - part + 1`` words.  Hashes of parts only let candidates through;
the last step compares whole windows by 128-bit hashes.  It counts a window
once in each block of segments (1 MB of text), so a frequent window has as
many rows as there are blocks, however often it occurs; the segments of a
block then look up which of their windows repeat.

No table here is broadcast: the planner, which goes by the files and leaves
out how many rows ``explode`` makes and how long lists are, takes 6.8 million
parts for 2.3 MB.

Exact copies of a text are recognised by a 128-bit digest first and take part
as one text that is known to repeat.

Nulls: a null text has no words; a null doc_id is carried.  Equal rows are
copies of each other.  Texts shorter than a window keep all their words.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quillstone.llm.arrowtext import ROWS, SLICE, U64, Words, pair, slices
from quillstone.storage import Scratch, batch_rows

WINDOW = 35
FIRST = 8
_SEED, _SEED_2 = 20240817, 977131
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` consecutive words at each start (n - length + 1 of them), by doubling."""
    size = 1
    while size * 2 <= length:
        h = pair(h[:-size], h[size:])
        size *= 2
    if size < length:
        h = pair(h[: len(h) - (length - size)], h[length - size :])
    return h


def _least(h: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """The minimum over ``width`` consecutive values at each start."""
    size = 1
    while size * 2 <= width:
        h = least(h[:-size], h[size:])
        size *= 2
    if size < width:
        h = least(h[: len(h) - (width - size)], h[width - size :])
    return h


def chosen(hashes: np.ndarray, first: np.ndarray, part: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the words of several texts (``first``: n + 1 word numbers): whether a window starts at each word, the hash of its
    chosen part, and per word the hash of the part that starts there where some window chose it (else all ones)."""
    n = len(hashes)
    valid, value, picked = np.zeros(n, bool), np.full(n, _NONE), np.full(n, _NONE)
    if n < window:
        return valid, value, picked
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    valid = room >= window
    parts = _runs(hashes, part)
    width = window - part + 1
    low = _least(parts, width)
    value[: len(low)] = low
    value[~valid] = _NONE
    # a part is chosen if the largest least value over the windows that hold it is its own
    reach = np.where(valid, value, U64(0))
    padded = np.concatenate([np.zeros(width - 1, U64), reach])
    most = _least(padded, width, np.maximum)
    mine = most[: len(parts)] == parts
    picked[: len(parts)][mine] = parts[mine]
    return valid, value, picked


def _per_text(picked: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct chosen parts of each text: offsets, hashes, whether they occur there twice."""
    at = np.flatnonzero(picked != _NONE)
    text = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((picked[at], text))
    t, h = text[order], picked[at][order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    where = np.flatnonzero(new)
    count = np.diff(np.append(where, len(t)))
    return np.searchsorted(t[where], np.arange(len(first))), h[where].view(np.int64), count > 1


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _scan(window: int, part: int):
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            texts = batch.column(batch.schema.get_field_index("text"))
            words = Words(texts)
            _, _, picked = chosen(words.hashes(_SEED), words.first, part, window)
            offsets, hashes, twice = _per_text(picked, words.first)
            digest = [hashlib.sha256(b" ".join(x.encode().split())).digest() if x else _EMPTY for x in texts.to_pylist()]
            columns = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(words.first)), pa.array(digest, pa.binary()), _lists(offsets, pa.array(hashes)), _lists(offsets, pa.array(twice))],
                [*names, "n_words", "digest", "parts", "twice"],
            )

    return run


_EMPTY = hashlib.sha256(b"").digest()


def _cut(window: int, part: int, base: bool):
    """Rows with the repeated parts ``alive`` to the segments whose windows all chose one of them, in numbered blocks."""

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for block, batch in enumerate(slices(batches, "text", 1_000_000), first):
            texts = batch.column(batch.schema.get_field_index("text"))
            words = Words(texts)
            valid, value, _ = chosen(words.hashes(_SEED), words.first, part, window)
            alive = batch.column(batch.schema.get_field_index("alive"))
            ids = batch.column(batch.schema.get_field_index("sid")).to_pylist()
            starts = batch.column(batch.schema.get_field_index("start")).to_pylist()
            raw = words.data.tobytes()
            out = []
            for k, (sid, begin) in enumerate(zip(ids, starts)):
                a, b = words.first[k], words.first[k + 1]
                good = valid[a:b] & np.isin(value[a:b], np.asarray(alive[k].values).view(U64))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
                for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    lo, hi = int(words.start[a + i]), int(words.end[a + j - 1 + window - 1])
                    out.append((sid, begin + i, raw[lo:hi]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string()), pa.array([block] * len(out), pa.int64())], ["sid", "start", "text", "block"])

    return run


def _parts(window: int, part: int):
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            words = Words(batch.column(batch.schema.get_field_index("text")))
            _, _, picked = chosen(words.hashes(_SEED), words.first, part, window)
            offsets, hashes, twice = _per_text(picked, words.first)
            take = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            ids = batch.column(batch.schema.get_field_index("sid")).to_numpy()[take]
            starts = batch.column(batch.schema.get_field_index("start")).to_numpy()[take]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(starts), pa.array(hashes), pa.array(twice)], ["sid", "start", "part", "twice"])

    return run


def _hashed(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words at which a window starts, and its 128-bit hash in two halves."""
    room = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words))
    at = np.flatnonzero(room >= window)
    if not len(at):
        return at, np.zeros(0, U64), np.zeros(0, U64)
    return at, _runs(words.hashes(_SEED), window)[at], _runs(words.hashes(_SEED_2), window)[at]


def _windows(window: int):
    """Segments to their windows, with the number of times in the block; a window may come in several rows of a block."""

    def run(batches):
        for batch in slices(batches, "text", 1_000_000):
            words = Words(batch.column(batch.schema.get_field_index("text")))
            at, a, b = _hashed(words, window)
            if not len(at):
                continue
            block = batch.column(batch.schema.get_field_index("block")).to_numpy()[np.searchsorted(words.first, at, "right") - 1]
            order = np.argsort(a, kind="stable")
            a, b, block = a[order], b[order], block[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (block[1:] != block[:-1])
            where = np.flatnonzero(new)
            n = np.diff(np.append(where, len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(a[where].view(np.int64)), pa.array(b[where].view(np.int64)), pa.array(block[where]), pa.array(n)], ["a", "b", "block", "n"])

    return run


def _among(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each pair (a[i], b[i]) is among the pairs (x, y)."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    low, high = np.searchsorted(x, a), np.searchsorted(x, a, "right")
    found = np.zeros(len(a), bool)
    for k in range(int((high - low).max(initial=0))):
        some = np.flatnonzero(low + k < high)
        found[some] |= y[low[some] + k] == b[some]
    return found


def _covered(window: int):
    """The segments of a block and its repeated windows to the stretches of words (``stop`` excluded) that runs of such windows cover."""

    def run(rows: pa.Table, again: pa.Table) -> pa.Table:
        words = Words(rows["text"].combine_chunks() if again.num_rows else pa.array([""] * rows.num_rows, pa.string()))
        at, a, b = _hashed(words, window)
        hit = np.zeros(len(words) + 2, bool)
        hit[at + 1] = _among(a, b, again["a"].to_numpy().view(U64), again["b"].to_numpy().view(U64))
        # a run ends with its text
        edge = np.zeros(len(words) + 1, bool)
        edge[words.first] = True
        begin = np.flatnonzero(hit[1:-1] & (~hit[:-2] | edge[:-1]))
        end = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[1:]))
        text = np.searchsorted(words.first, begin, "right") - 1
        shift = rows["start"].to_numpy()[text] - words.first[text]
        return pa.table({"sid": rows["sid"].to_numpy()[text], "start": begin + shift, "stop": end + shift + window})

    return run


def _strip():
    """Texts with the stretches that repeated windows cover to what is left of them."""

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            texts = batch.column(batch.schema.get_field_index("text"))
            words = Words(texts)
            starts, stops = (batch.column(batch.schema.get_field_index(x)) for x in ("starts", "stops"))
            raw, removed, digest, left = words.data.tobytes(), [], [], []
            for k in range(batch.num_rows):
                a, b = int(words.first[k]), int(words.first[k + 1])
                cover = np.zeros(b - a + 1, np.int32)
                np.add.at(cover, np.asarray(starts[k].values), 1)
                np.subtract.at(cover, np.asarray(stops[k].values), 1)
                keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                removed.append(b - a - len(keep))
                lo, hi = words.start[keep].tolist(), words.end[keep].tolist()
                digest.append(hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(lo, hi)])).digest())
                # white space after a kept word stays with it
                edge = np.flatnonzero(np.diff(np.concatenate([[-2], keep, [b + 2]])) > 1)
                spans = []
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    first, last = int(keep[i]), int(keep[j - 1])
                    spans.append(raw[int(words.start[first]) : int(words.start[last + 1]) if last + 1 < b else int(words.off[k + 1])])
                left.append(b"".join(spans))
            names = ["digest128", "n_removed", "kept_digest", "kept_text"]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("digest128")), pa.array(removed, pa.int64()), pa.array(digest, pa.binary()), pa.array(left, pa.binary()).cast(pa.string())], names)

    return run


def _with_digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest128"), F.xxhash64("doc_id", text).alias("rid"))


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that no estimate turns into a broadcast."""
    return left.join(right.hint("merge"), on, how)


def _alive(parts: DataFrame, key: list[str]) -> DataFrame:
    """Of rows ``key, part, twice``: the repeated parts, gathered by key."""
    found = parts.groupBy("part").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.max("twice").alias("twice")).where("lo <> hi or twice").select("part")
    return _join(parts, found, "part").groupBy(*key).agg(F.collect_set("part").alias("alive"))


def repeated(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``(all texts, changed texts)``.

    The first has ``doc_id, digest128, rid, n_words, digest`` for each row and
    ``copies`` (rows with its text); the second, for each text without copies
    that loses words, ``digest128, n_removed, kept_digest, kept_text``.  A
    text with copies loses all its words if it has a window at all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    keyed = _with_digest(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = min(FIRST, window)
    with batch_rows(spark, ROWS):
        scan = scratch.keep(keyed.mapInArrow(_scan(window, part), f"doc_id {kind}, digest128 binary, rid long, n_words long, digest binary, parts array<long>, twice array<boolean>"))
    tid = F.xxhash64("digest128").alias("sid")  # may only let candidates through
    parts = scan.select(tid, F.explode(F.arrays_zip("parts", "twice")).alias("x")).select("sid", F.col("x.parts").alias("part"), F.col("x.twice").alias("twice"))
    alive = _alive(parts, ["sid"])
    texts = scan.groupBy("digest128").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
    wanted = _join(texts.withColumn("sid", F.xxhash64("digest128")), alive, "sid").select("rid", "digest128", "copies", "alive")
    # rows of one id and text are one here
    base = scratch.keep(_join(keyed.select("rid", "text", "digest128"), wanted, ["rid", "digest128"]).withColumn("sid", F.monotonically_increasing_id()))
    seg = scratch.keep(base.select("sid", F.lit(0).cast("long").alias("start"), "text", "alive").mapInArrow(_cut(window, part, True), "sid long, start long, text string, block long"))
    while part * 2 <= window:
        part *= 2
        found = seg.mapInArrow(_parts(window, part), "sid long, start long, part long, twice boolean")
        # segments of one text may share words at their ends, so a part in two of them only may pass
        again = found.groupBy("part").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("part")
        alive = _join(found, again, "part").groupBy("sid", "start").agg(F.collect_set("part").alias("alive"))
        new = scratch.keep(_join(seg, alive, ["sid", "start"]).mapInArrow(_cut(window, part, False), "sid long, start long, text string, block long"))
        scratch.drop(seg)
        seg = new
    every = seg.mapInArrow(_windows(window), "a long, b long, block long, n long")
    again = every.withColumn("n", F.sum("n").over(Window.partitionBy("a", "b"))).where("n > 1").select("block", "a", "b")
    gone = seg.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_covered(window), "sid long, start long, stop long")
    gone = gone.groupBy("sid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    single = base.where("copies = 1").select("sid", "digest128", "text")
    with batch_rows(spark, ROWS):
        changed = scratch.keep(_join(single, gone, "sid").mapInArrow(_strip(), "digest128 binary, n_removed long, kept_digest binary, kept_text string"))
    scratch.drop(seg, base)
    rows = _join(scan.select("doc_id", "digest128", "rid", "n_words", "digest"), texts.where("copies > 1").select("digest128", "copies"), "digest128", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return rows, changed


def _gone(window: int):
    return (F.col("copies") > 1) & (F.col("n_words") >= window)


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row."""
    rows, changed = repeated(docs, window)
    both = _join(rows, changed.drop("kept_text"), "digest128", "left")
    gone = _gone(window)
    return both.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(gone, F.lit(bytearray(_EMPTY))).otherwise(F.coalesce("kept_digest", "digest")))).alias("kept_sha256"),
    )


def stripped(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated windows cut out of ``text`` (``n_chars`` follows where present); all rows and columns stay.

    Texts that lose nothing, null ones too, are left as they are.
    """
    rows, changed = repeated(docs.select("doc_id", "text"), window)
    new = changed.select(F.col("digest128").alias("quillstone_digest"), F.col("kept_text").alias("quillstone_text"))
    gone = rows.where(_gone(window)).select(F.col("digest128").alias("quillstone_digest"), F.lit("").alias("quillstone_text")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("quillstone_digest", F.unhex(F.substring(F.sha2(text, 256), 1, 32)))
    joined = _join(marked, new.unionByName(gone), "quillstone_digest", "left").withColumn("text", F.coalesce("quillstone_text", "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("quillstone_text").isNull(), F.col("n_chars")).otherwise(F.length("quillstone_text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)
