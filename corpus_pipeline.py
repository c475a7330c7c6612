"""Documents to packed sequences: language ID, quality, near-dedup, substring dedup, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and works on all rows that its predecessor kept.  ``run`` writes
each stage's rows as Parquet and rereads them for the next.

Rows without letters in their text go in the first stage, and with them null
and empty texts; the other cases are defined by the operators.  Texts that
the fourth stage empties stay as documents of no words.  An empty table packs
nothing.  No SQL can express the stages: the tests compare each operator with
a brute-force version, and look at ids and columns of ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.language import keep_known
from quillstone.llm.nearcopies import keep_dissimilar
from quillstone.llm.packing import pack
from quillstone.llm.quality import keep_good
from quillstone.llm.substrings import stripped
from quillstone.storage import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_dissimilar(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stripped(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
