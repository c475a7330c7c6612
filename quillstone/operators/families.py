"""Row families, neighbours of units, repairs, teacher decisions, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.functions.uri import citation_for_unit
from quillstone.operators.dataset import is_stub

MARKER = "(intilliggande)"


def adjacent_unit(source_id: Column) -> Column:
    """The next page, paragraph number or section of the same document; NULL where a unit has no number."""
    def step(pattern: str) -> Column:
        number = F.regexp_extract(source_id, pattern, 2)
        return F.when(source_id.rlike(pattern), F.concat(F.regexp_extract(source_id, pattern, 1), (number.try_cast("int") + 1).cast("string")))

    return F.coalesce(step(r"^(.*#sid)(\d+)$"), step(r"^(.*#point-)(\d+)$"), step(r"^(.*#p)(\d+)$"), step(r"^(.*#(?:K\d+[a-z]?)?P)(\d+)$"))


def with_adjacent(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Rows ``id, source_id`` with the text of the next unit where ``units(source_id, text)`` has it."""
    u = units.select(F.col("source_id").alias("adjacent_id"), F.col("text").alias("adjacent_text"))
    return rows.withColumn("adjacent_id", adjacent_unit(F.col("source_id"))).join(u, "adjacent_id", "left")


def expand_family(rows: DataFrame) -> DataFrame:
    """Each authentic row and the variants that its columns allow: ``topic_match``, ``adjacent``, ``reordered_sources``, ``contradiction``, ``overstatement``.

    Generated texts come as columns ``contradiction`` and ``overstatement``; NULL gives no variant.
    """
    def variant(kind: str, label: str | Column, claim: Column, sources: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(kind).alias("transformation"), (F.lit(label) if isinstance(label, str) else label).alias("label"), claim.alias("claim"), sources.alias("sources")))

    claim, sources = F.col("claim"), F.col("sources")
    all_ = F.array_compact(
        F.array(
            variant("authentic", F.col("label"), claim, sources, F.lit(True)),
            variant("topic_match", "unsupported", claim, F.array("negative"), F.col("negative").isNotNull()),
            variant("adjacent", "unsupported", claim, F.array("adjacent"), F.col("adjacent").isNotNull()),
            variant("reordered_sources", F.col("label"), claim, F.reverse(sources), F.size(sources) > 1),
            variant("contradiction", "incorrect", F.col("contradiction"), sources, F.col("contradiction").isNotNull()),
            variant("overstatement", "misleading", F.col("overstatement"), sources, F.col("overstatement").isNotNull()),
        )
    )
    return rows.select(F.col("id").alias("parent_id"), F.explode(all_).alias("v")).select(F.concat("parent_id", F.lit("-"), "v.transformation").alias("id"), "parent_id", "v.*")


def repair(rows: DataFrame) -> DataFrame:
    """Rows whose sources are all stubs go; markers are taken out of citations, which then name their unit; a whole judgment goes where a point of it is there.

    ``sources``: array of struct(citation, source_id, document_id, unit_type, text).
    """
    kept = rows.where(~F.forall("sources", lambda s: is_stub(s["text"], s["unit_type"])))
    pinned = F.transform(F.filter("sources", lambda s: s["unit_type"].isin("case_pinpoint", "cjeu_pinpoint")), lambda s: s["document_id"])
    kept = kept.withColumn("pinned", pinned)
    kept = kept.withColumn("sources", F.filter("sources", lambda s: ~((s["unit_type"] == "case_judgment") & F.array_contains("pinned", s["document_id"])))).drop("pinned")

    def clean(s: Column) -> Column:
        plain = F.trim(F.replace(s["citation"], F.lit(MARKER), F.lit("")))
        return s.withField("citation", F.when(s["citation"].contains(MARKER), citation_for_unit(plain, s["source_id"], s["unit_type"])).otherwise(s["citation"]))

    return kept.withColumn("sources", F.transform("sources", clean))


def propagate(rows: DataFrame, repaired: DataFrame, family: str = "origin_claim_id") -> DataFrame:
    """Texts repaired in one row of a family replace those of the same source in its siblings."""
    fixed = repaired.select(family, "source_id", "text").groupBy(family).agg(F.map_from_entries(F.collect_set(F.struct("source_id", "text"))).alias("fixed"))
    joined = rows.join(fixed, family, "left")
    return joined.withColumn("sources", F.transform("sources", lambda s: s.withField("text", F.coalesce(F.try_element_at("fixed", s["source_id"]), s["text"])))).drop("fixed")


def teacher_decision(label: Column, teacher: Column, top: Column, rule: Column, reviewer: Column, least: float = 0.8) -> Column:
    """``struct(decision, label, by)``: a reviewer's word, then a rule, then agreement; an unsure teacher keeps the row."""
    def said(decision: str, value: Column, by: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), value.cast("string").alias("label"), F.lit(by).alias("by"))

    return (
        F.when(reviewer.isNotNull(), said("relabel", reviewer, "reviewer"))
        .when(rule.isNotNull(), said("relabel", rule, "rule"))
        .when((teacher == label) | (top < least), said("keep", label, "teacher"))
        .otherwise(said("reject", F.lit(None), "teacher"))
    )


def rewrite_label(kind: Column, effect: Column) -> Column:
    """Label of a rewritten claim by kind and judged effect; other combinations are thrown away."""
    return F.when((kind == "paraphrase") & (effect == "same"), "supported").when((kind == "contradiction") & (effect == "opposite"), "incorrect").when((kind == "overstatement") & (effect == "stronger"), "misleading")


def batches(rows: DataFrame, length: str, id_col: str, size: int, edges: tuple[int, ...] = (512, 2048, 4096), seed: str = "0") -> DataFrame:
    """``bucket, batch``: rows of like length in batches of ``size``, in an order drawn by seed."""
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(F.col(length) <= e, i).otherwise(bucket)
    order = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    marked = rows.withColumn("bucket", bucket)
    return marked.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("bucket").orderBy(order, id_col)) - 1) / size).cast("int"))
