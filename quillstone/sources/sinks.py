"""Writers: ordered and partitioned JSON lines, bounded parts, resumable appends, rewrites, rejects, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F


def ordered_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """Files whose names follow the stated order; the same rows give the same bytes."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def split_jsonl(rows: DataFrame, path: str, by: str = "split") -> None:
    rows.write.mode("overwrite").partitionBy(by).json(path)


def with_parts(rows: DataFrame, key: list[str], order: list[str], bytes_: int) -> DataFrame:
    """``rows`` with ``part``: rows in order within a key, a new part whenever the JSON size passes another multiple of ``bytes_``."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns))) + 1
    before = F.sum(size).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("part", F.floor((before - 1) / bytes_).cast("int"))


def append_new(rows: DataFrame, path: str, key: list[str]) -> None:
    """Rows whose key the target doesn't hold yet are added; a repeated run adds nothing."""
    from quillstone.sources.files import exists

    spark = rows.sparkSession
    fresh = rows.dropDuplicates(key)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def rewrite(rows: DataFrame, path: str) -> None:
    """Replaces a table by rows that may be read from it: written beside it, then swapped."""
    spark = rows.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(new)
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.rename(fs_path(path), fs_path(old))
    fs.rename(fs_path(new), fs_path(path))
    fs.delete(fs_path(old), True)


def with_rejects(rows: DataFrame, reason, good: str, bad: str) -> None:
    """Rows without a reason go to ``good``, the others with it to ``bad``."""
    marked = rows.withColumn("reason", reason)
    marked.where("reason is null").drop("reason").write.mode("overwrite").parquet(good)
    marked.where("reason is not null").write.mode("overwrite").parquet(bad)


def summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """One JSON text with the number of rows and the counts of each grouping column."""
    counts = None
    for g in groups:
        one = rows.groupBy(F.coalesce(F.col(g).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(g).alias("name"), "value", "n")
        counts = one if counts is None else counts.unionByName(one)
    maps = counts.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("counts"))
    whole = maps.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", F.to_json("counts").alias("c"))))).alias("m"))
    return whole.select(F.to_json("m").alias("summary"))


def verdict_json(columns: list[str]):
    """A response body of the named columns."""
    return F.to_json(F.struct(*columns))
