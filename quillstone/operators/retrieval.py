"""BM25 ranking, budget windows and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillstone.functions import text as T


#: Terms of queries, counted once for each query, up to which they are sent to all tasks, and documents in a partition that they meet.
SENT, DOCS = 2**18, 2_000


def bm25(queries: DataFrame, corpus: DataFrame, k1: float = 1.5, b: float = 0.75, group: str | None = None, mode: str = "letter_digit") -> DataFrame:
    """``query_id, doc_id, score`` of all pairs that share a term.

    ``queries``: ``query_id, text``; ``corpus``: ``doc_id, text``; with
    ``group`` both have that column and every statistic is taken within it.
    Terms of a query count as often as they occur.  Of the corpus only
    its query terms are joined.  Up to ``SENT`` terms of queries without groups
    go to the documents, which are dealt out by ``doc_id`` first, so pairs are
    added up where they arise; else all is dealt out by term.
    """
    by = [group] if group else []
    words = T.tokens(F.col("text"), mode)
    sizes = corpus.select(*by, F.size(words).alias("dl")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    terms = queries.select(*by, "query_id", F.explode(T.tokens(F.col("text"), mode)).alias("term")).groupBy(*by, "query_id", "term").agg(F.count("*").alias("qtf"))
    few = not by and terms.limit(SENT + 1).count() <= SENT
    sent = F.broadcast if few else lambda x: x
    docs = (corpus.repartition(max(1, -(-corpus.count() // DOCS)), "doc_id") if few else corpus).select(*by, "doc_id", words.alias("words")).withColumn("dl", F.size("words"))
    wanted = terms.select(*by, "term").distinct()
    found = docs.select(*by, "doc_id", "dl", F.explode("words").alias("term")).join(sent(wanted), [*by, "term"], "left_semi")
    tf = found.groupBy(*by, "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    hits = tf.join(sent(df), [*by, "term"])
    hits = hits.join(sizes, by) if by else hits.crossJoin(F.broadcast(sizes))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1e-6))))
    weighed = hits.select(*by, "term", "doc_id", weight.alias("weight"))
    return sent(terms).join(weighed, [*by, "term"]).groupBy(*by, "query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))


def top_k(scored: DataFrame, k: int, by: list[str], digits: int = 6) -> DataFrame:
    """The k best of each group by rounded score, then doc_id, with ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("score", digits)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def greedy_fill(costs: Column, budget: int) -> Column:
    """0-based places taken from ranked costs: one is taken if it fits or nothing is taken yet, skipped if not; all ends when the budget is reached."""
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("total"), F.lit(0).alias("at"))

    def step(a: Column, cost: Column) -> Column:
        fits = ((a["total"] + cost <= budget) | (F.size(a["taken"]) == 0)) & (a["total"] < budget)
        return F.struct(
            F.when(fits, F.concat(a["taken"], F.array(a["at"]))).otherwise(a["taken"]).alias("taken"),
            F.when(fits, a["total"] + cost).otherwise(a["total"]).alias("total"),
            (a["at"] + 1).alias("at"),
        )

    return F.aggregate(costs, start, step)["taken"]


def paragraphs(text: Column) -> Column:
    """Paragraphs over 15 characters; else lines over 15; else the whole text."""

    def long(parts: Column) -> Column:
        return F.filter(F.transform(parts, F.trim), lambda p: F.length(p) > 15)

    double, single, whole = long(F.split(text, "\n\n")), long(F.split(text, "\n")), F.trim(text)
    rest = F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(double) > 0, double).when(F.size(single) > 0, single).otherwise(rest)


def group_sentences(text: Column, least: int = 800) -> Column:
    """Sentences joined until a piece has ``least`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, s: Column) -> Column:
        new = F.when(a["open"].isNull(), s).otherwise(F.concat(a["open"], F.lit(" "), s))
        full = F.length(new) >= least
        return F.struct(F.when(full, F.concat(a["done"], F.array(new))).otherwise(a["done"]).alias("done"), F.when(~full, new).alias("open"))

    def finish(a: Column) -> Column:
        return F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    return F.aggregate(T.sentences_simple(text), start, step, finish)


def chunks(docs: DataFrame, long: int = 1500) -> DataFrame:
    """``doc_id, p_idx, text``: paragraphs, those over ``long`` characters cut at sentences and numbered 100 * paragraph + piece."""
    paras = docs.select("doc_id", F.posexplode(paragraphs(F.coalesce("text", F.lit("")))).alias("p", "paragraph"))
    pieces = F.when(F.length("paragraph") > long, group_sentences(F.col("paragraph"))).otherwise(F.array("paragraph"))
    cut = paras.select("doc_id", "p", F.posexplode(pieces).alias("k", "text"), (F.length("paragraph") > long).alias("was_long"))
    return cut.select("doc_id", F.when(F.col("was_long"), F.col("p") * 100 + F.col("k")).otherwise(F.col("p")).cast("int").alias("p_idx"), F.col("p").alias("p"), F.col("k").alias("k"), "text")


def merge_short(docs: DataFrame, least: int = 120) -> DataFrame:
    """``doc_id, index, text``: chunks shorter than ``least`` go to the next chunk of the same document, at the end alone."""
    ordered = chunks(docs).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "k", "text"))), lambda x: x["text"]).alias("parts"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, s: Column) -> Column:
        new = F.when(a["open"].isNull(), s).otherwise(F.concat(a["open"], F.lit("\n\n"), s))
        full = F.length(new) >= least
        return F.struct(F.when(full, F.concat(a["done"], F.array(new))).otherwise(a["done"]).alias("done"), F.when(~full, new).alias("open"))

    def finish(a: Column) -> Column:
        return F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    return ordered.select("doc_id", F.posexplode(F.aggregate("parts", start, step, finish)).alias("index", "text"))
