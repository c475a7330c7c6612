"""SpotSigs fingerprints, with built-in functions only.

Words are lower-cased runs of letters and digits.  A run of common words (the
anchors) with the content word after it and the next content word is one
signature; a text's set of them, hashed, is compared by Jaccard likeness.  A
text without an anchor has one signature made of all its words, or of all its
characters where it has no word.

Nulls: a null text is empty and has no signature; two empty sets are alike
(1).  Equal texts have equal sets and fingerprints.  A null doc_id comes
first in the order of documents; rows of equal doc_id follow each other by
text.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux ce ces cette dans de des du elle en est et il la le les ne par pas pour qui que se son sur un une "
    "als auf auch aus das dem den der des die ein eine einer er es für hat ich im in ist mit nicht sich sie sind und von werden wie zu zur "
    "al como con de del el ella en es la las lo los más no o para por que se su sus un una y"
).split()
#: Sets of at most this likeness ratio apart in length can't reach the threshold.
THRESHOLD = 0.8


def with_signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the sorted set of signature hashes of a text column.

    Each step is a column of its own that the next ones use more than once,
    so it is computed once for a row.
    """
    anchors = "|".join(sorted(set(ANCHORS), key=lambda x: (-len(x), x)))
    words, glued, parts = (f"quillstone_{x}" for x in ("words", "glued", "parts"))
    rows = rows.withColumn(words, F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))
    # an anchor is glued to what follows it: "of~the~house stands"
    rows = rows.withColumn(glued, F.regexp_replace(words, rf"(?<![^ ])({anchors}) ", r"$1~"))
    rows = rows.withColumn(parts, F.split(glued, " ", -1))

    def one(this: Column, after: Column) -> Column:
        return F.when(this.contains("~"), F.xxhash64(this, F.substring_index(after, "~", -1)))

    spots = F.array_compact(F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), one))
    whole = F.when(F.col(words) != "", F.array(F.xxhash64(words))).when(F.col(text) != "", F.array(F.xxhash64(text))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(out, F.when(F.col(glued).contains("~"), F.sort_array(F.array_distinct(spots))).otherwise(whole)).drop(words, glued, parts)


def fingerprint(sigs: Column) -> Column:
    """32 hex digits of a signature set."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(sigs)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), sigs)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total).cast("double")


#: Code points of text in a range of documents, about, and ranges at most (beyond, they grow with the table; a window spills).
RANGE_CHARS, RANGES = 16_000_000, 1 << 16


def ranges(docs: DataFrame) -> int:
    """How many ranges hold the table."""
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    least = max(16, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(RANGES, max(least, -(-chars // RANGE_CHARS)))


def place_of(cuts: list, column: str) -> Column:
    """The number of the last of the sorted cuts that is not above the column (0 below all), found in two steps of the root of their number."""
    step = max(1, math.isqrt(len(cuts)))
    whole, coarse = F.array(*map(F.lit, cuts)) if len(cuts) == 1 else F.lit(cuts), cuts[::step]
    block = F.greatest(F.size(F.filter(F.lit(coarse) if len(coarse) > 1 else F.array(F.lit(coarse[0])), lambda b: b <= F.col(column))) - 1, F.lit(0))
    inside = F.size(F.filter(F.slice(whole, block * step + 1, F.lit(step)), lambda b: b <= F.col(column)))
    return F.coalesce(F.greatest(block * step + inside - 1, F.lit(0)), F.lit(0))


def boundaries(docs: DataFrame, parts: int) -> tuple[list, bool]:
    """Ids that cut the table into about ``parts`` even ranges (the least id first), and whether an id is null."""
    row = docs.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(parts)], 20 * parts).alias("at"),
        F.min("doc_id").alias("low"),
        F.max(F.col("doc_id").isNull().cast("int")).alias("null"),
    ).first()
    return sorted({*(row["at"] or []), *([] if row["low"] is None else [row["low"]])}), bool(row["null"])


def with_next(docs: DataFrame, columns: dict[str, str], parts: int | None = None, more=lambda part: part) -> DataFrame:
    """``docs`` with ``next_<name>`` for each of ``columns``, taken from the next row by doc_id and text; the first follows the last.

    ``more`` may add columns to rows that are dealt out already.

    The table is cut into ranges of ids, as many as its texts need; the rows
    of a range's first id also go to the range before it, so no window spans
    more than a range and no row is sent twice otherwise.
    """
    cuts, null = boundaries(docs, parts or ranges(docs))
    if not cuts:
        cuts = [0]
    at = F.lit(cuts) if len(cuts) > 1 else F.array(F.lit(cuts[0]))
    place = place_of(cuts, "doc_id")
    last = len(cuts) - 1
    first = F.col("doc_id").isNull() if null else F.col("doc_id") == cuts[0]
    own = F.struct(place.alias("range"), F.lit(0).alias("guest"))
    before = F.struct((place - 1).alias("range"), F.lit(1).alias("guest"))
    around = F.struct(F.lit(last).alias("range"), F.lit(2).alias("guest"))
    homes = F.array_compact(F.array(own, F.when((place > 0) & F.array_contains(at, F.col("doc_id")), before), F.when(first, around)))
    spread = docs.withColumn("home", F.explode(homes)).select(*docs.columns, "home.range", "home.guest").repartition(len(cuts), "range")
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    moved = more(spread).select("*", *(F.lead(c).over(order).alias(f"next_{k}") for k, c in columns.items()))
    return moved.where("guest = 0").drop("guest", "range")


def fingerprint_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses.

    The edited text has the last quarter of the code points replaced by as
    many from the start of the next document.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(given, {"body": "text", "sigs": "sigs"}, parts, lambda part: with_signatures(part, "text", "sigs"))
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_body", F.lit(1), k))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_sets(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``doc_id, class_id`` for each row, and pairs ``a < b`` of classes with their likeness of ``threshold`` or more.

    Rows of equal signature sets are one class (named by the least doc_id).
    Sets are dealt to partitions by length: lengths whose ratio may reach the
    threshold meet in the same or the next one.  Within these, only sets that
    share one of their rarest signatures are compared: a set of n has to
    share at least one of its n - ceil(threshold * n) + 1 rarest.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = with_signatures(texts, "text", "sigs").select("doc_id", "sigs").withColumn("fp", fingerprint(F.col("sigs")))
    named = sets.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs"))
    members = sets.select("doc_id", "fp").join(named.select("fp", "class_id"), "fp").select("doc_id", "class_id")
    some = named.where(F.size("sigs") > 0).select("class_id", "sigs", F.size("sigs").alias("n"))
    each = some.select("class_id", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("df"))
    rare = each.join(often, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig")))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9)
    head = rare.where(F.col("rank") <= keep).select("class_id", "n", "sig", part.alias("part"))
    low = head.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("own"))
    high = head.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), "sig", "part")
    fits = (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9) & ((F.col("own") < F.col("part")) | (F.col("a") < F.col("b")))
    pairs = low.join(high, ["sig", "part"]).where(fits & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = some.select(F.col("class_id").alias("a"), F.col("sigs").alias("x")), some.select(F.col("class_id").alias("b"), F.col("sigs").alias("y"))
    links = pairs.join(a, "a").join(b, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness")).where(F.col("likeness") >= threshold)
    return members, links
