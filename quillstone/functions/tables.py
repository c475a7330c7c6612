"""Table-valued and small helper functions for SQL users."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

from quillstone.functions import text as T
from quillstone.operators.citations import Scanner


class _Citations:
    """``citations(text)``: a row for each citation."""

    def __init__(self):
        self.scanner = Scanner()

    def eval(self, text: str):
        for r in self.scanner.parse(text or ""):
            yield r.start, r.end, text[r.start : r.end], r.uri, r.kind


def register(spark: SparkSession) -> None:
    """Makes ``citations`` available to SQL, for LATERAL joins."""
    spark.udtf.register("citations", F.udtf(_Citations, returnType="start int, end int, cited string, uri string, kind string"))


def inline_runs(runs: Column) -> Column:
    """Text of inline runs ``array<struct<text, uri>>``; linked ones in Markdown."""
    return F.array_join(F.transform(runs, lambda r: F.when(F.coalesce(r["uri"], F.lit("")) == "", r["text"]).otherwise(F.concat(F.lit("["), r["text"], F.lit("]("), r["uri"], F.lit(")")))), "")


def first_start(text: Column, options: list[str]) -> Column:
    """The longest of the options that the text starts with, case apart."""
    out = F.lit(None).cast("string")
    for o in sorted(options, key=len):
        out = F.when(F.lower(F.trim(text)).startswith(o.lower()), o).otherwise(out)
    return out


def framed(claim: Column, key: Column, templates: list[str]) -> Column:
    """A claim in one of the templates (with ``{}``), drawn by a hash of the key."""
    n = F.pmod(F.xxhash64(key), F.lit(len(templates))).cast("int")
    return F.replace(F.array(*map(F.lit, templates))[n], F.lit("{}"), claim)


def pair_problem(pair_tokens: Column, claim_tokens: Column, most: int = 512, claim_most: int = 150) -> Column:
    """Why a pair can't be scored whole; nothing is ever truncated."""
    return F.when(claim_tokens > claim_most, "claim_too_long").when(pair_tokens > most, "unit_too_long")


def overlapping_passages(text: Column, budget: int = 350) -> Column:
    """Sentences in passages of at most ``budget`` estimated tokens; each begins with the last sentence of the one before. A longer sentence stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("").alias("last"))

    def step(a: Column, s: Column) -> Column:
        joined = F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(" "), s))
        fits = (a["open"] == "") | (T.token_estimate(joined) <= budget)
        both = F.concat(a["last"], F.lit(" "), s)
        fresh = F.when(T.token_estimate(both) <= budget, both).otherwise(s)
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, joined).otherwise(fresh).alias("open"), s.alias("last"))

    def finish(a: Column) -> Column:
        return F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))

    return F.array_distinct(F.aggregate(T.sentences(text), start, step, finish))
