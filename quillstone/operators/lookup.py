"""Lookups: valid time, longest prefix, carried state, existence, resumed work, fillers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def valid_at(rows: DataFrame, validity: DataFrame, key: list[str], when: str) -> DataFrame:
    """Each row with the value valid at ``when``: ``valid_from <= when < valid_until``, open where null; none before the first."""
    v = validity.select(*key, "valid_from", "valid_until", "value")
    inside = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(when))) & (F.col("valid_until").isNull() | (F.col(when) < F.col("valid_until")))
    same = [rows[k] == v[k] for k in key]
    hit = rows.join(v, [*same, inside], "left")
    return hit.select(*[rows[c] for c in rows.columns], v["value"])


def longest_prefix(rows: DataFrame, text: str, id_col: str, aliases: DataFrame) -> DataFrame:
    """``id, alias``: the longest alias that the text starts with at a word boundary.

    Every word-boundary prefix of a text is looked up by equality, so the
    work is the number of words and not the number of aliases.
    """
    words = F.split(F.lower(text), " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    each = rows.select(id_col, F.explode(prefixes).alias("alias"))
    hits = each.join(aliases.select(F.lower("alias").alias("alias")).distinct(), "alias")
    return hits.groupBy(id_col).agg(F.max_by("alias", F.length("alias")).alias("alias"))


def carried(value: Column, key: list[str], order: list) -> Column:
    """The last non-null value up to and with this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def unfinished(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in ``done``: work to resume."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def overridden(rows: DataFrame, layers: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """The value of the first layer that has the key, in order of priority; else the row's own."""
    out, names = rows, []
    for i, layer in enumerate(layers):
        names.append(f"quillstone_v{i}")
        out = out.join(layer.select(*key, F.col(value).alias(names[-1])), key, "left")
    return out.withColumn(value, F.coalesce(*names, value)).drop(*names)


def fillers(weights: DataFrame, key: str, weight: str, n: int, seed: str) -> DataFrame:
    """``n`` keys without replacement, half of them drawn by weight and half uniformly, the same for the same seed.

    A draw by weight takes the least of ``-ln(u) / weight`` with u from a hash of seed and key.
    """
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    half = weights.select(key, (-F.log(u) / F.greatest(weight, F.lit(1e-9))).alias("w"), u.alias("u"))
    first = half.orderBy("w", key).limit(n // 2).select(key)
    second = half.join(first, key, "left_anti").orderBy("u", key).limit(n - n // 2).select(key)
    return first.withColumn("kind", F.lit("weighted")).unionByName(second.withColumn("kind", F.lit("uniform")))


def prefix_key(uri: Column) -> Column:
    """16 hex digits of a URI's SHA-256; the first four name its bucket."""
    return F.substring(F.sha2(uri, 256), 1, 16)
