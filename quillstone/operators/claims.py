"""Claims around citations, hypotheses, evidence and verdicts."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillstone.functions import numbers as N, text as T
from quillstone.operators import citations as C, policy as P, retrieval as R

_ABBREVIATION = re.compile(r"(?i)\b(?:" + "|".join(re.escape(a) for a in sorted(T.ABBREVIATIONS, key=len, reverse=True)) + ")$")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Sentences as half-open spans: cut behind . ! ? before white space and a capital or digit, and at paragraph breaks; not behind an abbreviation.

    An approximation of locale rules; slices of the spans are the sentences.
    """
    out, at = [], 0
    for m in re.finditer(r"[.!?][\"”')\]]*\s+(?=[\"”'(]*[A-ZÅÄÖ0-9])|\n\s*\n", text):
        if text[m.start()] in ".!?" and _ABBREVIATION.search(text[at : m.start() + 1]):
            continue
        if text[at : m.end()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


_LEANS = re.compile(r"(?i)^(?:han|hon)\b|^(?:detta|det|den|de)\s+(?:är|var|ska|kan|gäller|följer|innebär)\b")
_IMPERSONAL = re.compile(r"(?i)^det\s+(?:är|var|ska|kan|bör|måste)\s+(?:\w+\s+){0,2}att\b")
_SIGNALS = re.compile(r"(?i)(?<!\w)(?:se|jfr|även|bl|a|t|ex|och)(?!\w)|(?:detta|det)\s+följer\s+(?:även\s+|också\s+)?(?:av|enligt)")
_FRAMES = re.compile(r"(?i)^(?:(?:av|enligt)\s+\S+\s+)?(?:det\s+)?(?:framgår|följer|gäller|anges)\s+att\s+|^(?:högsta domstolen|hd|hfd|domstolen)\s+(?:fann|ansåg|uttalade|konstaterade)\s+att\s+")


def _bare(text: str, a: int, b: int, cited: list[tuple[int, int]]) -> bool:
    """Nothing but reference words is left of ``text[a:b]`` without its citations."""
    left, at = [], a
    for s, e in sorted(cited):
        if s < b and e > at:
            left.append(text[at : max(at, s)])
            at = min(e, b)
    return not re.sub(r"[\W_]", "", _SIGNALS.sub("", "".join([*left, text[at:b]])))


def claim_around(text: str, start: int, end: int, cited: list[tuple[int, int]], spans: list[tuple[int, int]] | None = None) -> tuple[int, int] | None:
    """The span of the claim that a citation supports: its sentence; the one before if only reference words are left; and one more where that leans back on an uncited one in the same paragraph.

    ``spans``: the sentences of the text, where they are known.
    """
    spans = sentence_spans(text) if spans is None else spans
    i = bisect.bisect_right(spans, (start, float("inf"))) - 1
    if i < 0 or start >= spans[i][1]:
        return None
    last = i
    if i and "\n\n" not in text[spans[i - 1][0] : spans[i][0]] and _bare(text, *spans[i], cited):
        i -= 1
    begin = spans[i][0]
    sentence = text[begin : spans[last][1]].strip()
    if i and _LEANS.search(sentence) and not _IMPERSONAL.search(sentence):
        a, b = spans[i - 1]
        if not re.search(r"\n\s*\n", text[a:begin]) and not any(s < b and e > a for s, e in cited):
            begin = a
    return begin, spans[last][1]


def hypothesis(claim: str, citations: list[str]) -> str:
    """The claim without citations in brackets, reference words and framing phrases."""
    for c in citations:
        claim = claim.replace(c, " ")
    claim = re.sub(r"\(\s*(?:[Ss]e|[Jj]fr)?[\s,;.]*\)", " ", claim)
    claim = re.sub(r"\s+([.,;])", r"\1", " ".join(claim.split()))
    return _FRAMES.sub("", claim).strip(" ,;") or claim.strip()


def _claims_of(text: str, refs: list[tuple[int, int, str, str]]) -> Iterator[tuple]:
    """``start, end, uri, claim, hypothesis`` for each ``(start, end, cited text, uri)``."""
    cited, spans, known = [r[:2] for r in refs], sentence_spans(text), {}
    for start, end, _, uri in refs:
        span = claim_around(text, start, end, cited, spans)
        if span:
            if span not in known:
                claim = text[slice(*span)].strip()
                known[span] = claim, hypothesis(claim, [r[2] for r in refs])
            yield *span, uri, *known[span]


_CLAIM = {"start": pa.int32(), "end": pa.int32(), "uri": pa.string(), "claim": pa.string(), "hypothesis": pa.string()}


def _in_python(docs: DataFrame, refs_of) -> DataFrame:
    """The claims of ``doc_id, text, ...``; ``refs_of(text, rest)`` gives the citations of a text."""

    def run(batches):
        for batch in batches:
            ids, rows, where = batch.column(0), [[] for _ in _CLAIM], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                for row in _claims_of(values[0], refs_of(*values)):
                    where.append(i)
                    for column, x in zip(rows, row):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(where, pa.int32())), *(pa.array(c, t) for c, t in zip(rows, _CLAIM.values()))], ["doc_id", *_CLAIM])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start int, end int, uri string, claim string, hypothesis string")


def claims(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, uri, claim, hypothesis`` for each citation of ``doc_id, text, refs``."""
    return _in_python(docs.select("doc_id", "text", "refs"), lambda text, refs: [(r["start"], r["end"], r["text"], r["uri"]) for r in refs])


def cited_claims(docs: DataFrame, scanner: C.Scanner | None = None) -> DataFrame:
    """The claims around the citations of ``doc_id, text``, which are found on the way: no text is joined or sent twice."""
    scanner = scanner or C.Scanner()
    return _in_python(C.hopeful(docs).select("doc_id", "text"), lambda text: [(r.start, r.end, text[r.start : r.end], r.uri) for r in scanner.parse(text)])


def usable_sources(sources: Column) -> Column:
    """Sources with text; a missing citation becomes its number."""
    named = F.transform(sources, lambda s, i: F.struct(F.coalesce(s["citation"], F.concat(F.lit("Källa "), (i + 1).cast("string"))).alias("citation"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text")))
    return F.filter(named, lambda s: s["text"] != "")


def windows(rows: DataFrame, budget: int = 380) -> DataFrame:
    """``row_id, premise``: sources of ``row_id, claim, sources`` within the token budget.

    Rows that fit are only formatted; the others are ranked by BM25 over their
    own chunks (long paragraphs in pieces), filled greedily, and put back in
    order of source and chunk number.
    """
    whole = rows.select("row_id", "claim", "sources", T.premise(F.col("sources")).alias("premise"))
    fits = whole.where(T.token_estimate(F.col("premise")) <= budget).select("row_id", "premise")
    large = whole.where(T.token_estimate(F.col("premise")) > budget)
    each = large.select("row_id", F.posexplode("sources").alias("s", "source")).select(F.struct("row_id", "s", F.col("source.citation").alias("citation")).alias("doc_id"), "source.text")
    chunks = R.chunks(each).select("doc_id.*", "p_idx", F.struct("doc_id.s", "p", "k").alias("doc_id"), "text")
    scored = R.bm25(large.select("row_id", F.col("row_id").alias("query_id"), F.col("claim").alias("text")), chunks.select("row_id", "doc_id", "text"), group="row_id")
    ranked = chunks.join(scored.select("row_id", "doc_id", "score"), ["row_id", "doc_id"], "left")
    head = F.concat(F.lit("[Källa "), (F.col("s") + 1).cast("string"), F.lit(": "), F.col("citation"), F.lit("]\n"))
    item = F.struct((-F.coalesce(F.round("score", 6), F.lit(0.0))).alias("neg"), "doc_id", T.token_estimate(F.concat(head, F.col("text"))).alias("cost"), "s", "p_idx", head.alias("head"), "text")
    ordered = ranked.groupBy("row_id").agg(F.sort_array(F.collect_list(item)).alias("r"))
    taken = ordered.withColumn("n", F.explode(R.greedy_fill(F.transform("r", lambda x: x["cost"]), budget))).select("row_id", "n", F.col("r")[F.col("n")].alias("c"))
    # pieces of one paragraph and later paragraphs may share a number; of these the better ranked goes first
    by_source = taken.groupBy("row_id", "c.s", "c.head").agg(F.sort_array(F.collect_list(F.struct("c.p_idx", "n", "c.text"))).alias("t"))
    texts = by_source.select("row_id", "s", F.concat("head", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")).alias("block"))
    return fits.unionByName(texts.groupBy("row_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "block"))), lambda x: x["block"]), "\n\n").alias("premise")))


@F.pandas_udf(ArrayType(DoubleType()))
def lexical_stub(premise: pd.Series, claim: pd.Series) -> pd.Series:
    """A deterministic stand-in for a trained scorer: word overlap and negation, as four logits. Its verdicts mean nothing."""
    def one(p: str, c: str) -> list[float]:
        a, b = set(re.findall(r"\w+", (p or "").lower())), set(re.findall(r"\w+", (c or "").lower()))
        share = len(a & b) / max(len(b), 1)
        flip = bool((a ^ b) & set(T.NEGATIONS))
        return [4 * share, 4 * (1 - share), 2.0 * flip * share, 1.0 * share * (1 - share)]

    return pd.Series([one(p, c) for p, c in zip(premise, claim)])


def verdicts(rows: DataFrame, scorer=lexical_stub, temperature: float = 1.0, thresholds: dict[int, float] | None = None, minimum_margin: float = 0.0) -> DataFrame:
    """``row_id, label, reason, probs`` of ``row_id, claim, sources, unresolved``.

    Claims that can't be judged and rows without sources never reach the
    scorer; ``scorer(premise, claim)`` gives four logits.
    """
    thresholds = thresholds or dict.fromkeys(range(4), 0.5)
    ready = rows.withColumns({"a": T.assessable(F.col("claim")), "sources": usable_sources(F.col("sources"))})
    early = F.when(~F.col("a.ok"), F.col("a.reason")).when(F.size("sources") == 0, "no_sources")
    marked = ready.withColumn("early", early)
    out = marked.where("early is not null").select("row_id", F.lit(None).cast("int").alias("label"), F.col("early").alias("reason"), F.lit(None).cast("array<double>").alias("probs"))
    live = marked.where("early is null")
    scored = live.join(windows(live.select("row_id", "claim", "sources")), "row_id").withColumn("logits", scorer("premise", "claim")).withColumn("probs", N.softmax(F.col("logits"), temperature))
    decided = P.four_label(N.argmax(F.col("probs")), F.array_max("probs"), N.margin(F.col("probs")), thresholds, minimum_margin, F.col("unresolved"))
    return out.unionByName(scored.select("row_id", decided.alias("d"), "probs").select("row_id", "d.label", "d.reason", "probs"))


def passage_chunks(paragraphs: DataFrame, most: int = 600, ahead: int = 3) -> DataFrame:
    """``doc_id, n, text``: each paragraph with up to three that follow, while group and role stay and the length allows."""
    order = Window.partitionBy("doc_id").orderBy("n")
    out, open_, length = F.col("text"), F.lit(True), F.length("text")
    for k in range(1, ahead + 1):
        more, same = F.lead("text", k).over(order), (F.lead("group", k).over(order) == F.col("group")) & (F.lead("role", k).over(order) == F.col("role"))
        open_ = open_ & F.coalesce(same & (length + F.length(more) + 2 <= most), F.lit(False))
        length = length + F.when(open_, F.length(more) + 2).otherwise(0)
        out = F.concat(out, F.when(open_, F.concat(F.lit("\n\n"), more)).otherwise(""))
    return paragraphs.select("doc_id", "n", "group", "role", out.alias("text"))


def select_evidence(passages: DataFrame, k: int = 5) -> DataFrame:
    """The best summary and the best decision first, then the best others: ``k`` of each document, by ``score`` then ``n``."""
    by_role = F.row_number().over(Window.partitionBy("doc_id", "role").orderBy(F.desc("score"), "n"))
    slot = F.when((F.col("role") == "summary") & (F.col("in_role") == 1), 0).when((F.col("role") == "decision") & (F.col("in_role") == 1), 1).otherwise(2)
    ranked = passages.where(F.col("role").isin("reasoning", "summary", "decision")).withColumn("in_role", by_role).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(slot, F.desc("score"), "n")))
    return ranked.where(F.col("rank") <= k).drop("in_role")
