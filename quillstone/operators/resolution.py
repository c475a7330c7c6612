"""Resolving citations to texts: judgments and assessments from node tables, dockets and parties from snapshots.

Node tables are those of ``structure.flatten_tree``: nodes in document order
with their depth, so a subtree is a range of numbers.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quillstone.functions import labels as L, text as T

# How a lower court's text begins, and which courts a phrase names.
LOWER_COURT = r"(?iu)^\s*(?:HovR|Hovrätten|TR|Tingsrätten|Kammarrätten|Förvaltningsrätten|Länsrätten|Svea|Göta|Skatterättsnämnden|Inskrivningsmyndigheten)(?!\p{L})"
COURTS = [("högsta domstolen", "nja"), ("hd", "nja"), ("högsta förvaltningsdomstolen", "hfd"), ("hfd", "hfd"), ("arbetsdomstolen", "ad")]


def with_ends(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``until``: the first later node that is not below."""
    later = nodes.select(F.col("doc_id").alias("later_doc"), F.col("node_id").alias("next_id"), F.col("depth").alias("next_depth"))
    mine = nodes.select("doc_id", "node_id", "depth")
    ends = mine.join(later, F.expr("later_doc = doc_id and next_id > node_id and next_depth <= depth")).groupBy("doc_id", "node_id").agg(F.min("next_id").alias("until"))
    return nodes.join(ends, ["doc_id", "node_id"], "left").withColumn("until", F.coalesce("until", F.lit(2**62)))


def subtree_texts(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, node_id, text``: the texts of each head and all below it, in order."""
    h = heads.select("doc_id", F.col("node_id").alias("head"), "until")
    inside = h.join(nodes.select("doc_id", "node_id", "text"), "doc_id").where("node_id >= head and node_id < until and text <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "\n\n")
    return inside.groupBy("doc_id", F.col("head").alias("node_id")).agg(joined.alias("text"))


def judgments(nodes: DataFrame) -> DataFrame:
    """``doc_id, text, reason``: the deciding court's reasons and decision.

    Of the judgment nodes outside proposals, the last that does not open with
    a lower court's name decides; dissents are cut, and a court that follows
    its referent's proposal has it put first.
    """
    n = with_ends(nodes)
    doms, proposals = n.where("type = 'dom'"), n.where("type = 'betankande'")
    p = proposals.select(F.col("doc_id").alias("p_doc"), F.col("node_id").alias("p_id"), F.col("until").alias("p_until"))
    under = F.expr("p_doc = doc_id and node_id > p_id and node_id < p_until")
    free = doms.join(p, under, "left_anti")
    texts = subtree_texts(free, nodes).withColumnRenamed("text", "whole")
    ranked = free.join(texts, ["doc_id", "node_id"], "left").withColumn("own", ~F.coalesce(F.substring("whole", 1, 120).rlike(LOWER_COURT), F.lit(False)))
    order = Window.partitionBy("doc_id").orderBy(F.desc("own"), F.desc("node_id"))
    chosen = ranked.withColumn("k", F.row_number().over(order)).where("k = 1").select("doc_id", F.col("node_id").alias("d_id"), F.col("until").alias("d_until"))
    parts = n.where("type in ('domskal', 'domslut')").join(chosen, "doc_id", "left").where("d_id is null or (node_id > d_id and node_id < d_until)")
    outside = parts.join(p, under, "left_anti")
    said = subtree_texts(outside, nodes).join(outside.select("doc_id", "node_id", "type"), ["doc_id", "node_id"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((F.col("type") == "domslut").alias("last"), "node_id", "text"))), lambda x: x["text"]), "\n\n")
    own = said.groupBy("doc_id").agg(text.alias("text")).withColumn("text", T.cut_dissent(F.col("text")))
    proposed = subtree_texts(proposals, nodes).groupBy("doc_id").agg(F.max_by("text", "node_id").alias("proposal"))
    both = nodes.select("doc_id").distinct().join(own, "doc_id", "left").join(proposed, "doc_id", "left")
    adopts = F.substring("text", 1, 400).rlike(r"(?iu)i enlighet med betänkandet")
    full = F.when(adopts & F.col("proposal").isNotNull(), F.concat("proposal", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return both.select("doc_id", F.coalesce(full, F.lit("")).alias("text"), F.when(F.coalesce(full, F.lit("")) == "", "empty_unit").alias("reason"))


def assessments(nodes: DataFrame) -> DataFrame:
    """``doc_id, text``: from the first heading of the court's examination to the costs; without one, everything."""
    h = F.when(F.col("type") == "heading", F.lower(F.trim("text")))
    begins = h.rlike(r"(?u)^(?:[ivx]+\s*[–-]\s*)?(?:prövning|tolkningsfråg|den första frågan|bedömning|domstolens svar|frågan huruvida|den enda frågan)")
    ends = h.contains("rättegångskostnader")
    first = nodes.groupBy("doc_id").agg(F.min(F.when(begins, F.col("node_id"))).alias("a"))
    marked = nodes.join(first, "doc_id")
    last = marked.where((F.col("node_id") > F.col("a")) & ends).groupBy("doc_id").agg(F.min("node_id").alias("b"))
    inside = marked.join(last, "doc_id", "left").where("(a is null or node_id >= a) and (b is null or node_id < b) and text <> ''")
    return inside.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def _hits(docs: DataFrame, pattern: str, groups: list[str], before: int) -> DataFrame:
    """``doc_id, start, end, before`` and the groups of each match."""
    regex = re.compile(pattern)

    def run(frames):
        for f in frames:
            rows = [(d, m.start(), m.end(), t[max(0, m.start() - before) : m.start()], *(m[g] for g in groups)) for d, t in zip(f["doc_id"], f["text"]) if t for m in regex.finditer(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "before", *groups])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, before string, " + ", ".join(f"{g} string" for g in groups))


def dockets(docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``doc_id, start, end, uri`` of docket numbers that ``snapshot(number, court, decided, uri)`` has.

    The last court named in the 90 characters before must fit, and something
    must mark the number: its letters, the word for a case, or a date beside it.
    A date picks among several; what is left must be one.
    """
    hits = _hits(docs, r"(?<![\w-])(?P<letters>[A-ZÅÄÖ]{1,2})?[ ]?(?P<number>\d{1,5}-\d{2})(?![\w-])", ["letters", "number"], 90)
    low = F.lower("before")
    last = r"(?u).*(?<!\p{L})(" + "|".join(p for p, _ in sorted(COURTS, key=lambda x: -len(x[0]))) + r")(?::s|s)?(?!\p{L})(?!.*(?:tingsrätt|hovrätt|kammarrätt|förvaltningsrätt)).*$"
    court = F.try_element_at(F.create_map(*[F.lit(x) for p in COURTS for x in p]), F.regexp_extract(F.regexp_replace(low, r"\s+", " "), last, 1))
    date = F.regexp_extract("before", r"(\d{4}-\d{2}-\d{2})\D{0,3}$", 1)
    marked = hits.withColumns({"court": court, "date": date, "key": F.concat_ws(" ", "letters", "number")}).where(F.col("letters").isNotNull() | low.rlike(r"(?u)mål") | (F.col("date") != ""))
    s = snapshot.select(F.col("number").alias("key"), "court", F.col("decided").cast("string").alias("decided"), "uri")
    found = marked.join(s, ["key", "court"])
    w = Window.partitionBy("doc_id", "start")
    dated = found.withColumn("same", F.col("decided") == F.col("date")).withColumn("any", F.max(F.col("same").cast("int")).over(w)).where("any = 0 or same")
    return dated.withColumn("n", F.count("*").over(w)).where("n = 1").select("doc_id", "start", "end", "uri")


def applications(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """``doc_id, start, end, uri`` of application numbers that ``cases(appno, uri)`` has."""
    hits = _hits(docs, r"(?:[Aa]nsökan|[Aa]pplication)\s+(?:nr|no\.?|nos\.?)\s*(?P<appno>\d{3,6}/\d{2})", ["appno"], 0)
    return hits.join(cases.select("appno", "uri"), "appno").select("doc_id", "start", "end", "uri")


def party_names(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """``doc_id, start, end, uri`` of "X mot Y" where ``cases(applicant, respondent, uri)`` has exactly one such case.

    Every run of up to six words before "mot" is looked up; the longest wins.
    """
    hits = _hits(docs, r"(?P<left>(?:[\w.-]+[ ]){1,6})mot[ ](?P<right>[A-ZÅÄÖ][\w-]+(?:[ ][a-zA-ZÅÄÖåäö][\w-]+){0,3})", ["left", "right"], 0)
    words = F.split(F.trim("left"), " ")
    tails = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))
    heads = F.split("right", " ")
    fronts = F.transform(F.sequence(F.lit(1), F.size(heads)), lambda i: F.array_join(F.slice(heads, F.lit(1), i), " "))
    each = hits.select("doc_id", "start", "left", F.explode(tails).alias("a"), fronts.alias("fronts")).select("*", F.explode("fronts").alias("b"))
    keyed = each.withColumns({"applicant": L.folded_party(F.col("a")), "respondent": L.folded_party(F.col("b"))})
    c = cases.select(L.folded_party(F.col("applicant")).alias("applicant"), L.folded_party(F.col("respondent")).alias("respondent"), "uri")
    found = keyed.join(c, ["applicant", "respondent"]).withColumn("first", F.col("start") + F.length("left") - F.length("a") - 1)
    w = Window.partitionBy("doc_id", "start").orderBy(F.desc(F.length("a") + F.length("b")))
    best = found.withColumn("k", F.rank().over(w)).where("k = 1").withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "start"))).where("n = 1")
    return best.select("doc_id", F.col("first").alias("start"), (F.col("first") + F.length("a") + F.length("b") + 5).alias("end"), "uri")
