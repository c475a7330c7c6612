"""Evaluation runs, reports and small rules around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillstone.functions import text as T
from quillstone.functions.tables import pair_problem
from quillstone.operators.retrieval import bm25, top_k
from quillstone.operators.spans import segments

# Statuses that point the reader of a claim with this label the wrong way.
FORBIDDEN = {
    "supported": ["contradiction", "incorrect", "misleading", "missing"],
    "misleading": ["supported", "correct"],
    "incorrect": ["supported", "correct"],
    "nonsensical": ["supported", "correct", "contradiction", "incorrect"],
    "unsupported": ["supported", "correct"],
}
REVIEW, UNASSESSED = ["incorrect", "contradiction", "misleading", "missing"], ["abstain", "nonsensical", "pending"]
#: Four labels to three.
THREE_WAY = {"supported": "entailment", "unsupported": "neutral", "incorrect": "contradiction", "misleading": "neutral"}
#: Endings of definite forms of laws, by kind of act.
DEFINITE = {"lag": "en", "balk": "en", "förordning": "en", "kungörelse": "n", "stadga": "n"}
LEAST_LOG = -30.0


def _map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def skip_reason(claim: Column, pair_tokens: Column, claim_tokens: Column) -> Column:
    """Why a row is not scored: ``unassessable``, then ``unit_too_long``; NULL if it is."""
    return F.when(~T.assessable(claim)["ok"], "unassessable").when(pair_problem(pair_tokens, claim_tokens).isNotNull(), "unit_too_long")


def run_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``examples, assessed, argmax_correct, accepted, wrong_accepted, precision`` of ``expected, predicted, label``; a row without one of the first two is not assessed."""
    done = F.col("expected").isNotNull() & F.col("predicted").isNotNull()
    taken, right = done & (F.col("label") != "abstain"), F.col("expected") == F.col("predicted")
    sums = rows.groupBy(*(by or [])).agg(
        F.count("*").alias("examples"),
        F.count_if(done).alias("assessed"),
        F.count_if(done & right).alias("argmax_correct"),
        F.count_if(taken).alias("accepted"),
        F.count_if(taken & ~right).alias("wrong_accepted"),
    )
    return sums.withColumn("precision", F.when(F.col("accepted") > 0, (F.col("accepted") - F.col("wrong_accepted")) / F.col("accepted")))


def wrong_direction(gold: Column, status: Column, forbidden: dict[str, list[str]] | None = None) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(_map(forbidden or FORBIDDEN), gold), status), F.lit(False))


def matches_filter(chosen: Column, status: Column, semantic: Column) -> Column:
    """Whether a row of the report is shown under the filter all, review, unassessed or a status."""
    return F.when(chosen == "review", semantic.isin(REVIEW)).when(chosen == "unassessed", semantic.isin(UNASSESSED)).otherwise((chosen == "all") | (chosen == status))


def report_counters(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``total, review, unassessed, invalid`` of ``status, semantic``."""
    count = lambda name: F.count_if(matches_filter(F.lit(name), F.col("status"), F.col("semantic"))).alias(name)
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total"), count("review"), count("unassessed"), count("invalid"))


#: References in a partition of ``document_counts``, and parts into which the values of one document are dealt.
REFS, PARTS = 500_000, 16


def document_counts(refs: DataFrame, key: list[str], target: str, claim: str) -> DataFrame:
    """``targets`` (distinct) and ``claims`` of each document.

    Tasks hold about ``REFS`` references each, however many there are; the
    values of a large document are counted in ``PARTS`` parts.
    """
    n = max(1, -(-refs.count() // REFS))

    def distinct(value: str, name: str, other: str) -> DataFrame:
        rows = refs.select(*key, F.col(value).alias("quillstone_v"), F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int").alias("quillstone_part"))
        once = rows.repartition(n, *key, "quillstone_part").distinct()
        return once.groupBy(*key, "quillstone_part").agg(F.count("quillstone_v").alias(name)).select(*key, name, F.lit(0).cast("long").alias(other))

    parts = distinct(target, "targets", "claims").unionByName(distinct(claim, "claims", "targets"))
    return parts.repartition(n, *key).groupBy(*key).agg(F.sum("targets").alias("targets"), F.sum("claims").alias("claims"))


def shared(rows: DataFrame, key: str, resolve) -> DataFrame:
    """``rows`` with what ``resolve`` finds for a key: each distinct key is resolved once, and its answer goes to all rows."""
    return rows.join(resolve(rows.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")


def agreed(column: str) -> Column:
    """Aggregate: the value that all rows have, else NULL."""
    return F.when((F.count_distinct(column) == 1) & (F.count(column) == F.count("*")), F.max(column))


def row_citation(pin: Column, passages: Column) -> Column:
    """The pin's label, or the distinct labels (court and section) of the passages, or NULL."""
    label = F.transform(passages, lambda p: F.array_join(F.filter(F.array(p["court"], p["section"]), lambda x: x != ""), " · "))
    return F.coalesce(pin, F.nullif(F.array_join(F.array_distinct(F.filter(label, lambda x: x != "")), " · "), F.lit("")))


def letter_shares(entries: Column, letters: str = "ABCD") -> Column:
    """Shares of the letters from ``array<struct<token, logprob>>``: the best of each letter's tokens, -30 without one."""
    def best(x: str) -> Column:
        own = F.transform(F.filter(entries, lambda e: F.trim(e["token"]) == x), lambda e: e["logprob"])
        return F.exp(F.greatest(F.coalesce(F.array_max(own), F.lit(LEAST_LOG)), F.lit(LEAST_LOG)))

    weights = F.array(*map(best, letters))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: w / total)


def coerced_sources(source: Column, sources: Column) -> Column:
    """``sources``, or the one of older rows as a list."""
    return F.coalesce(sources, F.when(source.isNotNull(), F.array(source)))


def quotes(claim: Column, least: int = 20) -> Column:
    """Quoted texts of at least ``least`` characters, white space joined, in lower case."""
    found = F.regexp_extract_all(claim, F.lit(rf"[“”\"«']([^“”\"»']{{{least},}})[“”\"»']"), F.lit(1))
    return F.transform(found, lambda q: F.lower(T.collapsed(q)))


def has_quote(claim: Column, passage: Column) -> Column:
    plain = F.lower(T.collapsed(passage))
    return F.exists(quotes(claim), lambda q: F.contains(plain, q))


def joined_units(wanted: DataFrame, units: DataFrame) -> DataFrame:
    """``id, text, reason`` of ``id, fragments`` (in order) and ``id, fragment, text``: units joined; the first must exist, later ones may be missing."""
    each = wanted.select("id", F.posexplode("fragments").alias("i", "fragment"))
    met = each.join(units.select("id", "fragment", F.col("text").alias("unit")), ["id", "fragment"], "left")
    whole = met.groupBy("id").agg(
        F.bool_or((F.col("i") == 0) & F.col("unit").isNull()).alias("first_missing"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("unit") != "", F.struct("i", "unit")))), lambda u: u["unit"]), "\n\n").alias("text"),
    )
    bad = F.col("first_missing") | (F.trim("text") == "")
    return whole.select("id", F.when(bad, "").otherwise(F.trim("text")).alias("text"), F.when(bad, "pinpoint_not_found").alias("reason"))


def kept_targets(targets: Column, kinds: list[str] | None = None, whole: list[str] | None = None) -> Column:
    """Targets ``struct(uri, kind)`` of the kinds asked for; whole documents of the kinds in ``whole`` only.

    NULL where an occurrence loses all its targets: it goes; one that had none stays.
    """
    good = F.filter(targets, lambda t: (F.lit(kinds is None) | t["kind"].isin(kinds or [])) & (F.lit(whole is None) | F.contains(t["uri"], F.lit("#")) | t["kind"].isin(whole or [])))
    return F.when((F.size(targets) == 0) | (F.size(good) > 0), good)


def nearest_of_other(provisions: DataFrame, claims: DataFrame) -> DataFrame:
    """``query_id, doc_id, score``: the provision of another act that BM25 ranks first for ``query_id, text, act``; provisions are ``doc_id, text, act``."""
    scored = bm25(claims.select("query_id", "text"), provisions.select("doc_id", "text"))
    far = scored.join(claims.select("query_id", F.col("act").alias("own")), "query_id").join(provisions.select("doc_id", "act"), "doc_id").where("act <> own")
    return top_k(far, 1, ["query_id"]).select("query_id", "doc_id", "score")


def claim_segments(spans: DataFrame, key: list[str]) -> DataFrame:
    """Segments of ``id, kind, start, end`` with the ids of the claims and of the cites that cover them."""
    parts = segments(spans, key)
    kinds = spans.select(*key, F.col("id").alias("one"), "kind")
    named = parts.select(*key, "start", "end", F.explode("ids").alias("one")).join(kinds, [*key, "one"])
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("one"))))
    return named.groupBy(*key, "start", "end").agg(of("claim").alias("claims"), of("cite").alias("cites"))


def law_name(name: Column) -> Column:
    """In lower case, without a genitive s."""
    return F.regexp_replace(F.lower(name), "s$", "")


def law_number(number: Column) -> Column:
    """Fixed spellings of statute numbers: ``1736:0123 2`` and a blank for a point."""
    return F.replace(F.regexp_replace(F.regexp_replace(number, r"^(1736:0123) ?s\.? ?", "$1 "), r"(\d+:\d+)\.(\d)", "$1 $2"), F.lit("\n"), F.lit(" "))


def with_indefinite(names: DataFrame, heads: dict[str, str]) -> DataFrame:
    """``name, target`` and for names with a definite ending (the first of ``heads`` that fits) the indefinite form, unless it is a name already."""
    form = None
    for definite, indefinite in heads.items():
        new = F.expr("substring(name, 1, length(name) - {})".format(len(definite)))
        case = (F.col("name").endswith(definite), F.concat(new, F.lit(indefinite)))
        form = F.when(*case) if form is None else form.when(*case)
    more = names.select(form.alias("name"), "target").where("name is not null").groupBy("name").agg(F.min("target").alias("target"))
    return names.select("name", "target").unionByName(more.join(names, "name", "left_anti"))


def act_forms(title: Column, alternate: Column, sfs: Column) -> Column:
    """How texts name an act of this title, shorter title and number."""
    loose, compound = r"^(Lag|Förordning|Kungörelse)\s*\((\d{4}:[\p{L}\p{N}_]+)\)\s+(.+)$", r"^([A-ZÅÄÖ][\p{L}\p{N}_]*?)(lag|balk|förordning|kungörelse|stadga)\s*\(\d{4}:[\p{L}\p{N}_]+\)"
    kind = F.try_element_at(_map({"Lag": "lagen", "Förordning": "förordningen", "Kungörelse": "kungörelsen"}), F.regexp_extract(title, loose, 1))
    long = F.concat(kind, F.lit(" ("), sfs, F.lit(") "), F.regexp_replace(F.trim(F.regexp_extract(title, loose, 3)), r"\.+$", ""))
    head = F.regexp_extract(title, compound, 2)
    definite = F.concat(F.lower(F.concat(F.regexp_extract(title, compound, 1), head)), F.try_element_at(_map(DEFINITE), head))
    forms = F.array_compact(F.array(long, F.concat(definite, F.lit(" ("), sfs, F.lit(")")), definite, F.when(alternate.rlike(r"^[A-ZÅÄÖ][\p{L}\p{N}_]*$"), alternate)))
    return F.when(F.size(forms) > 0, forms).otherwise(F.array(F.regexp_replace(title, r"\.+$", "")))


def replicated(rows: DataFrame, weight: Column, times: int = 20) -> DataFrame:
    """Rows of true ``weight`` ``times`` times, numbered from 1; others once."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(weight, times).otherwise(1))))


def three_way(label: Column) -> Column:
    return F.try_element_at(_map(THREE_WAY), label)


def usable_provisions(provisions: DataFrame, repealed: DataFrame, low: int = 150, high: int = 1200, least: int = 3) -> DataFrame:
    """``act, uri, text`` of 150 to 1200 characters, of acts that are in force and have three such ones."""
    good = provisions.where(F.length("text").between(low, high)).join(repealed.select("act"), "act", "left_anti")
    enough = good.groupBy("act").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("act")
    return good.join(enough, "act", "left_semi").select("act", "uri", "text")
