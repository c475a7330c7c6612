"""Readers: JSON lines, partitions, numbered sentences, snapshots, input limits, file manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

#: Limits of a document to check.
MAX_BLOCKS, MAX_CHARACTERS = 5_000, 250_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a match of a pattern, is there, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """JSON lines under a stated schema; blank lines are skipped; a missing file may be an empty table."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of bad lines."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("row"))
    return parsed.where("row._bad is null").select("row.*").drop("_bad"), parsed.where("row._bad is not null").select("value")


def partitions(spark: SparkSession, paths: dict[str, str], schema: str, fallback: str | None = None) -> DataFrame:
    """Named partitions as one table with ``split`` and a 1-based ``position`` by split and id; the fallback file where none is there."""
    parts = [jsonl(spark, p, schema).withColumn("split", F.lit(name)) for name, p in paths.items() if exists(spark, p)]
    if not parts and fallback:
        parts = [jsonl(spark, fallback, schema, missing_ok=True).withColumn("split", F.lit("all"))]
    if not parts:
        return spark.createDataFrame([], f"{schema}, split string, position long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("split").orderBy("id")).cast("long"))


def sampled_files(spark: SparkSession, pattern: str, schema: str, limit: int | None = None, seed: str = "") -> DataFrame:
    """JSON documents of a directory with their ``path``; with a limit, that many files in order of a seeded hash of their paths."""
    docs = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())
    if limit is None:
        return docs
    chosen = docs.select("path").distinct().orderBy(F.sha2(F.concat(F.lit(seed), F.col("path")), 256)).limit(limit)
    return docs.join(chosen, "path", "left_semi")


def first_available(key: str, *tables: DataFrame) -> DataFrame:
    """The row of the first table that has the key: cache, then local, then remote snapshot."""
    out = tables[0].withColumn("origin", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.join(out.select(key), key, "left_anti").withColumn("origin", F.lit(i)))
    return out


def unwrapped(envelope: Column, *paths: str) -> Column:
    """The first of several JSON paths that an envelope has."""
    return F.coalesce(*(F.get_json_object(envelope, p) for p in paths))


def local_paths(uri: Column) -> Column:
    """Candidate file names of an identifier, best first."""
    base = F.substring_index(uri, "#", 1)
    return (
        F.when(base.rlike(r"^\d{4}:\d+$"), F.array(F.concat(F.lit("sfs/"), F.translate(base, ":", "/"), F.lit(".json"))))
        .when(base.startswith("celex/"), F.array(F.concat(base, F.lit(".json"))))
        .when(base.rlike(r"^dom/[a-z]+/\d{4}s\d+$"), F.array(F.concat(base, F.lit(".json")), F.concat(F.regexp_replace(base, r"(\d{4})s(\d+)$", "$1/s$2"), F.lit(".json"))))
        .when(base.startswith("dom/"), F.array(F.concat(F.translate(base, ":", "/"), F.lit(".json"))))
        .otherwise(F.array(F.concat(F.translate(base, ":", "-"), F.lit(".json"))))
    )


def numbered_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``page, n, text`` of lines ``[page.n] text``."""
    p = r"^\[(\d+)\.(\d+)\]\s*(.*)$"
    lines = spark.read.text(path).where(F.col("value").rlike(p))
    return lines.select(F.regexp_extract("value", p, 1).cast("int").alias("page"), F.regexp_extract("value", p, 2).cast("int").alias("n"), F.regexp_extract("value", p, 3).alias("text"))


def own_part(text: Column, begin: str, end: str) -> Column:
    """What stands between a line that begins a part and one that ends it."""
    part = F.regexp_extract(text, rf"(?ms)^{re.escape(begin)}[^\n]*\n(.*?)(?:^{re.escape(end)}|\z)", 1)
    return F.regexp_replace(part, r"^\s+|\s+$", "")


def input_problems(blocks: DataFrame) -> DataFrame:
    """``doc_id, problem``: empty, too_many_blocks or too_long; documents within the limits are not listed."""
    sums = blocks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max((F.trim("text") != "").cast("int")).alias("some"))
    problem = F.when(F.coalesce("some", F.lit(0)) == 0, "empty").when(F.col("n") > MAX_BLOCKS, "too_many_blocks").when(F.col("chars") > MAX_CHARACTERS, "too_long")
    return sums.select("doc_id", problem.alias("problem")).where("problem is not null")


def integrity(spark: SparkSession, pattern: str, manifest: DataFrame) -> DataFrame:
    """``name, problem``: missing, unexpected, size or digest, of files against ``name, bytes, sha256``."""
    files = spark.read.format("binaryFile").load(pattern).select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("got"), F.sha2("content", 256).alias("digest"))
    both = manifest.join(files, "name", "full")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("bytes").isNull(), "unexpected").when(F.col("got") != F.col("bytes"), "size").when(F.col("digest") != F.col("sha256"), "digest")
    return both.select("name", problem.alias("problem")).where("problem is not null")
