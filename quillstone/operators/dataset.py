"""Building and auditing labelled datasets."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from quillstone.functions import text as T
from quillstone.functions.numbers import hash_share
from quillstone.operators.components import connected_components, sharing_components
from quillstone.storage import Scratch

# The four labels, and the longest pair.
LABELS = ("supported", "unsupported", "incorrect", "misleading")
MAX_TOKENS = 8192


def validation_errors(claim: Column, sources: Column, label: Column, tokens: Column, origin: Column) -> Column:
    """Codes of all that is wrong with a row; ``sources``: array of struct(text, source_id, document_id)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    codes = [
        F.array(F.when(blank(claim), F.lit("empty_claim"))),
        F.array(F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, F.lit("empty_sources"))),
        F.transform(sources, lambda s: F.when(blank(s["text"]), F.lit("empty_source_text"))),
        F.transform(sources, lambda s: F.when(blank(s["source_id"]), F.lit("empty_source_id"))),
        F.array(F.when(~F.coalesce(label.isin(*LABELS), F.lit(False)), F.concat(F.lit("invalid_label_"), F.coalesce(label, F.lit("None"))))),
        F.array(F.when(tokens > MAX_TOKENS, F.concat(F.lit("token_length_exceeded_"), tokens.cast("string")))),
        F.transform(sources, lambda s: F.when((origin != "") & (s["document_id"] == origin), F.lit("self_citation"))),
    ]
    return F.array_compact(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in codes]))


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("quillstone_n", n).where("quillstone_n = 1").drop("quillstone_n")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def conflicting(rows: DataFrame, key: Column, label: Column) -> DataFrame:
    """Keys with more than one label: ``key, labels`` (sorted, joined by /), ``n``."""
    grouped = rows.groupBy(key.alias("key")).agg(F.sort_array(F.collect_set(label)).alias("labels"), F.count("*").alias("n"))
    return grouped.where(F.size("labels") > 1).select("key", F.array_join("labels", "/").alias("labels"), "n")


def overlaps(values: DataFrame, shown: int = 5) -> DataFrame:
    """Of ``split, kind, value``: for each kind and two splits that share values, how many, and the first five."""
    v = values.where("value is not null and value <> ''").distinct()
    a, b = v.select("kind", "value", F.col("split").alias("a")), v.select("kind", "value", F.col("split").alias("b"))
    met = a.join(b, ["kind", "value"]).where("a < b").select("a", "b", "kind", "value")
    counts = met.groupBy("a", "b", "kind").agg(F.count("*").alias("n"))
    # no more than the rows that are shown leave a partition
    first = met.withColumn("i", F.row_number().over(Window.partitionBy("a", "b", "kind").orderBy("value"))).where(F.col("i") <= shown)
    examples = first.groupBy("a", "b", "kind").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("examples"))
    return counts.join(examples, ["a", "b", "kind"]).select("a", "b", "kind", "n", "examples")


def cross_role(values: DataFrame, one: str, other: str) -> DataFrame:
    """Values that have role ``one`` in a split and ``other`` in another."""
    v = values.where("value is not null and value <> ''").distinct()
    a, b = v.where(F.col("kind") == one).select("value", F.col("split").alias("a")), v.where(F.col("kind") == other).select("value", F.col("split").alias("b"))
    return a.join(b, "value").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value").distinct().groupBy("a", "b").agg(F.count("*").alias("n"))


def hash_partition(key: Column, ratios: dict[str, float], salt: str) -> Column:
    """The split whose cumulative ratio first exceeds the key's hash share; the last one takes the rest."""
    share, out, edge = hash_share(key, salt), None, 0.0
    names = list(ratios)
    for name in names[:-1]:
        edge += ratios[name]
        out = F.when(share < edge, name) if out is None else out.when(share < edge, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def digits_code(number: Column) -> Column:
    """Codes of whole numbers from 0 to 10^17 - 1, in the order of their digits as text."""
    text = number.cast("string")
    return F.shiftleft(F.rpad(text, 17, "0").cast("long"), 5).bitwiseOR(F.length(text).cast("long"))


def code_digits(code: Column) -> Column:
    return F.substring(F.lpad(F.shiftright(code, 5).cast("string"), 17, "0"), F.lit(1), code.bitwiseAND(31).cast("int"))


def component_of(edges: DataFrame, left: str, right: str, strict: bool = False) -> DataFrame:
    """``left, component`` for each left node of a bipartite table; ``strict`` puts both sides in one namespace."""
    a, b = F.col(left).cast("string"), F.col(right).cast("string")
    if strict:
        return connected_components(edges.select(a.alias("u"), b.alias("v")))
    # right nodes only link left ones, of which a component has the smallest; numbers stand for the texts where they keep their order
    ends = edges.agg(F.min(left).alias("least"), F.max(left).alias("most")).first() if isinstance(edges.schema[left].dataType, IntegralType) else None
    coded = ends is not None and ends["least"] is not None and 0 <= ends["least"] and ends["most"] < 10**17
    whole = isinstance(edges.schema[right].dataType, IntegralType)
    found = sharing_components(edges.select((digits_code(F.col(left)) if coded else a).alias("u"), (F.col(right) if whole else b).alias("p")))
    text = code_digits if coded else lambda c: c
    return found.select(text(F.col("node")).alias(left), F.concat(F.lit("doc:"), text(F.col("component"))).alias("component"))


def pack_components(sizes: list[tuple], ratios: dict[str, float]) -> dict:
    """Components, largest first, each to the split with the least share of its target; ties in order of declaration.

    ``sizes`` has a row for each component; ``split_components`` does the same to a table of any length.
    """
    total = sum(n for _, n in sizes)
    target = _targets(total, ratios)
    filled = dict.fromkeys(ratios, 0)
    out = {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        best = min(ratios, key=lambda p: filled[p] / target[p])
        out[name] = best
        filled[best] += n
    return out


def _targets(total: int, ratios: dict[str, float]) -> dict[str, float]:
    return {p: max(total * r, 1) for p, r in ratios.items()}


def advance(filled: dict[str, int], target: dict[str, float], n: int, times: int) -> dict[str, int]:
    """What the splits hold once ``times`` more components of size ``n`` are packed.

    The greedy rule merges the splits' rising fill shares, so any set of
    placements that are among the next ``times`` can go first.  Filling up to a
    common level gives each split's number but for one a split; all but so many
    are placed at once, and the rule itself places the rest.
    """
    filled, most = dict(filled), len(filled)
    if not n:
        return filled
    order = sorted(filled, key=lambda p: filled[p] / target[p])
    for k in range(1, most + 1):
        level = (sum(filled[p] for p in order[:k]) + n * times) / sum(target[p] for p in order[:k])
        if k == most or level <= filled[order[k]] / target[order[k]]:
            break
    for p in order[:k]:
        sure = max(0, int((level * target[p] - filled[p]) / n) - most - 1)
        filled[p] += sure * n
        times -= sure
    for _ in range(times):
        filled[min(filled, key=lambda p: filled[p] / target[p])] += n
    return filled


def split_components(sizes: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """``component, n, split`` from ``component, n``: every component placed as ``pack_components`` does.

    Components are dealt by range in packing order.  Those of one size are
    alike, so the driver works out what the splits hold where each part begins
    from the number of components of each size (at most about the root of twice
    the rows); each part then goes on from there, row by row.
    """
    spark = sizes.sparkSession
    order = [F.desc("n"), F.asc_nulls_last("component")]
    kept = Scratch(spark, "split").keep(sizes.select("component", F.col("n").cast("long").alias("n")).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    classes = sorted(kept.groupBy("n").agg(F.count("*").alias("k")).collect(), reverse=True)
    parts = sorted(kept.groupBy("part").agg(F.count("*").alias("k")).collect())
    target = _targets(sum(n * k for n, k in classes), ratios)
    first, at = [], 0
    for part, k in parts:
        first.append((at, part))
        at += k
    starts, filled, at = {}, dict.fromkeys(ratios, 0), 0
    for n, k in classes:
        while len(starts) < len(first) and first[len(starts)][0] < at + k:
            begin, part = first[len(starts)]
            starts[part] = advance(filled, target, n, begin - at)
        filled = advance(filled, target, n, k)
        at += k

    def place(batches):
        now, held = None, {}
        for batch in batches:
            split = []
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist()):
                if part != now:
                    now, held = part, dict(starts[part])
                best = min(held, key=lambda p: held[p] / target[p])
                held[best] += n
                split.append(best)
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("n"), pa.array(split, pa.string())], ["component", "n", "split"])

    kind = sizes.schema["component"].dataType.simpleString()
    return kept.repartition("part").sortWithinPartitions("part", *order).mapInArrow(place, f"component {kind}, n long, split string")


def assert_share(sizes: DataFrame, most: float = 0.06) -> DataFrame:
    """``sizes`` with a guard: fails where the largest component has more than ``most`` of all rows."""
    total = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    bad = F.col("top") > F.col("total") * most
    return total.select("total", "top", F.assert_true(~bad, F.lit("a component is too large")).alias("ok"))


def stratified_sample(rows: DataFrame, by: list[str], id_col: str, size: int, groups: int | None = None) -> DataFrame:
    """``size`` rows: an equal quota of each stratum, filled up from the others, all in order of a hash of the id."""
    n = groups or rows.select(*by).distinct().count()
    quota = max(1, size // max(n, 1))
    draw = F.md5(F.col(id_col).cast("string").cast("binary"))
    ranked = rows.withColumn("quillstone_n", F.row_number().over(Window.partitionBy(*by).orderBy(draw, id_col)))
    order = [F.when(F.col("quillstone_n") <= quota, 0).otherwise(1), draw, F.col(id_col)]
    return ranked.orderBy(*order).limit(size).drop("quillstone_n")


def _ring(rows: DataFrame, by: list[str], id_col: str, other: str) -> DataFrame:
    """``rows`` with ``pos``, their place among the ``total`` rows of their stratum in order of ``other`` and a hash, and ``start, size`` of their ``other``.

    Rows are numbered within slots of the hash, and slots are counted, so no
    task holds a stratum.
    """
    marked = rows.select(*by, id_col, other, F.md5(F.col(id_col).cast("string").cast("binary")).alias("draw")).withColumn("slot", F.substring("draw", 1, 2))
    slots = marked.groupBy(*by, other, "slot").agg(F.count("*").alias("k"))
    groups = slots.groupBy(*by, other).agg(F.sum("k").alias("size"))
    stratum = Window.partitionBy(*by)
    groups = groups.withColumn("total", F.sum("size").over(stratum)).withColumn("start", F.sum("size").over(stratum.orderBy(other)) - F.col("size"))
    below = slots.withColumn("below", F.sum("k").over(Window.partitionBy(*by, other).orderBy("slot")) - F.col("k")).drop("k")
    inside = marked.withColumn("i", F.row_number().over(Window.partitionBy(*by, other, "slot").orderBy("draw", id_col)) - 1)
    placed = inside.join(below, [*by, other, "slot"]).join(groups, [*by, other])
    return placed.select(*by, id_col, other, "total", "start", "size", (F.col("start") + F.col("below") + F.col("i")).alias("pos"))


def negatives(rows: DataFrame, by: list[str], id_col: str, other: str) -> DataFrame:
    """For each row another one with a different ``other``: drawn by a hash of its id from all such rows of its stratum or, where it has none, of the table.

    Rows lie on a ring in order of ``other``; a row's draw steps past the block
    of its own ``other``, so every other row is as likely.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("negative:"), F.col(id_col).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")

    def drawn(asked: DataFrame, ring: DataFrame, key: list[str]) -> DataFrame:
        at = (F.col("start") + F.col("size") + draw % (F.col("total") - F.col("size"))) % F.col("total")
        found = ring.select(*key, F.col("pos").alias("at"), F.col(id_col).alias("negative"))
        return asked.where("total > size").withColumn("at", at).join(found, [*key, "at"]).select(id_col, "negative")

    ring = _ring(rows, by, id_col, other)
    first = drawn(ring, ring, by)
    alone = ring.where("total = size").select(id_col)
    whole = _ring(rows.withColumn("quillstone_all", F.lit(0)), ["quillstone_all"], id_col, other)
    rest = drawn(whole.join(alone, id_col, "left_semi"), whole, ["quillstone_all"])
    return rows.select(*by, id_col).join(first.unionByName(rest), id_col, "left").select(*by, id_col, "negative")


def without_stubs(sources: Column, stub) -> Column:
    """Whether a row has a source that is no stub."""
    return ~F.forall(sources, stub)


def is_stub(text: Column, unit_type: Column) -> Column:
    """A source without content: blank, or of an EU court unit a bare heading, a short text, or a short preamble."""
    clean = F.coalesce(F.trim(text), F.lit(""))
    heading = clean.rlike(r"(?U)^Prövning av (tolkningsfråg\w+|talan)\s*$")
    preamble = clean.rlike(r"^(I mål|I de förenade|DOMSTOLENS|TRIBUNALENS|Mål \d|In Case|EUROPAPARLAMENTET|Avis juridique|Rådets|Kommissionens)")
    return (clean == "") | (F.coalesce(unit_type, F.lit("")).startswith("cjeu") & (heading | (F.length(clean) < 600) | (preamble & (F.length(clean) < 1500))))


def drop_covered(uris: Column) -> Column:
    """URIs without chapters of which a section is there, and without whole documents of which a part is there."""
    return F.filter(uris, lambda u: ~F.exists(uris, lambda v: (v != u) & F.when(u.contains("#"), v.startswith(F.concat(u, F.lit("P")))).otherwise(v.startswith(F.concat(u, F.lit("#"))))))


def audit(rows: DataFrame) -> dict[str, DataFrame]:
    """The auditor's checks over rows ``id, split, claim, sources, label, origin_document_id, origin_claim_id``; each is empty if all is well."""
    source = rows.select("split", F.explode("sources").alias("s"))
    values = rows.select("split", F.lit("origin_document").alias("kind"), F.col("origin_document_id").alias("value"))
    values = values.unionByName(rows.select("split", F.lit("origin_claim").alias("kind"), F.col("origin_claim_id").alias("value")))
    values = values.unionByName(rows.select("split", F.lit("claim_text").alias("kind"), F.trim("claim").alias("value")))
    for kind, c in (("source_id", F.col("s.source_id")), ("source_document", F.col("s.document_id")), ("source_text", F.when(F.trim("s.text") != "", T.text_fingerprint(F.col("s.text"))))):
        values = values.unionByName(source.select("split", F.lit(kind).alias("kind"), c.alias("value")))
    pair = F.sha2(F.to_json(F.struct(F.trim("claim").alias("claim"), F.transform("sources", lambda s: F.struct(F.trim(s["citation"]).alias("citation"), F.trim(s["source_id"]).alias("source_id"), T.collapsed(s["text"]).alias("text"))).alias("sources"))), 256)
    return {
        "synthetic_label_marker": rows.where(F.exists("sources", lambda s: F.lower(s["citation"]).contains("intilliggande"))).select("id", "label"),
        "conflicting_exact_pairs": conflicting(rows, pair, F.col("label")),
        "duplicate_row_ids": duplicate_keys(rows, "id"),
        "partition_leakage": overlaps(values),
        "origin_source_cross_role": cross_role(values, "origin_document", "source_document"),
    }
