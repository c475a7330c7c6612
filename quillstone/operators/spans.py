"""Span algebra on half-open ``[start, end)`` intervals within a key.

Joins keep the key as an equality, so they are hash or merge joins with a
residual condition; folds work on the spans of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _spans(key: list[str]) -> Column:
    return F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("neg_end"), "id")))


def outermost(spans: DataFrame, key: list[str]) -> DataFrame:
    """``key, id, start, end``: by start, longest first, each span that does not overlap the last kept one."""
    start = F.array().cast("array<struct<start:bigint,end:bigint,id:bigint>>")

    def step(a: Column, s: Column) -> Column:
        new = F.struct(s["start"].cast("bigint").alias("start"), (-s["neg_end"]).cast("bigint").alias("end"), s["id"].cast("bigint").alias("id"))
        last = F.try_element_at(a, F.lit(-1))
        return F.when((F.size(a) > 0) & (s["start"] < last["end"]), a).otherwise(F.concat(a, F.array(new)))

    kept = spans.groupBy(*key).agg(_spans(key).alias("all")).select(*key, F.explode(F.aggregate("all", start, step)).alias("s"))
    return kept.select(*key, "s.id", "s.start", "s.end")


def merge_adjacent(spans: DataFrame, key: list[str], gap: int = 1) -> DataFrame:
    """Neighbours of one key at most ``gap`` apart that share a target become one span with all targets.

    The shared target is looked for in the grown set, so this is a fold and no window.
    """
    kind = "array<struct<start:bigint,end:bigint,targets:array<bigint>>>"
    ordered = spans.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("id").cast("bigint").alias("id"), F.col("targets").cast("array<bigint>").alias("targets")))).alias("all"))

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = (F.size(a) > 0) & (s["start"] >= last["end"]) & (s["start"] - last["end"] <= gap) & F.arrays_overlap(last["targets"], s["targets"])
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["targets"].alias("targets"))
        grown = F.struct(last["start"].alias("start"), s["end"].alias("end"), F.array_union(last["targets"], s["targets"]).alias("targets"))
        return F.when(joined, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(a, F.array(new)))

    merged = ordered.select(*key, F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("s"))
    return merged.select(*key, "s.start", "s.end", "s.targets")


def overlap_join(spans: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """Spans with the blocks ``block_id, b_start, b_end`` that they touch, clipped to them and relative to their start."""
    met = spans.join(blocks, key).where("b_start < end and b_end > start")
    return met.select(*key, "id", "block_id", (F.greatest("start", "b_start") - F.col("b_start")).alias("start"), (F.least("end", "b_end") - F.col("b_start")).alias("end"))


def without_overlap(spans: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Spans that touch none of the others."""
    o = others.select(*key, F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    same = [spans[k] == o[k] for k in key]
    return spans.join(o, [*same, o["o_start"] < spans["end"], o["o_end"] > spans["start"]], "left_anti")


def priority_merge(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """Span lists in order of priority: a later one gives only spans that touch nothing kept so far."""
    kept = lists[0]
    for more in lists[1:]:
        kept = kept.unionByName(without_overlap(more, kept, key))
    return kept


def segments(spans: DataFrame, key: list[str]) -> DataFrame:
    """Disjoint runs between neighbouring span ends, with the sorted ids of the spans that cover each; runs without a span are kept."""
    points = spans.select(*key, F.col("start").alias("p")).unionByName(spans.select(*key, F.col("end").alias("p"))).distinct()
    runs = points.withColumn("end", F.lead("p").over(Window.partitionBy(*key).orderBy("p"))).where("end is not null").withColumnRenamed("p", "start")
    s = spans.select(*key, F.col("id"), F.col("start").alias("s"), F.col("end").alias("e"))
    met = runs.join(s, key).where("s <= start and e >= end").groupBy(*key, "start", "end").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return runs.join(met, [*key, "start", "end"], "left").select(*key, "start", "end", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def nearest(left: DataFrame, right: DataFrame, key: list[str], reach: int, penalty: int = 1000) -> DataFrame:
    """Each left position with the nearest right one within ``reach``: following ones before preceding, ties kept."""
    met = left.join(right, key).where(F.abs(F.col("r_pos") - F.col("l_pos")) <= reach)
    distance = F.when(F.col("r_pos") >= F.col("l_pos"), F.col("r_pos") - F.col("l_pos")).otherwise(F.col("l_pos") - F.col("r_pos") + penalty)
    ranked = met.withColumn("distance", distance).withColumn("rank", F.rank().over(Window.partitionBy(*key, "l_id").orderBy("distance")))
    return ranked.where("rank = 1").drop("rank")


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], gap: int | None = None) -> DataFrame:
    """Each left row with the last right row at or before it (``r_pos <= l_pos``), found in one ordered pass over both."""
    columns = [c for c in left.columns if c not in key and c != "l_pos"]
    a = left.select(*key, F.col("l_pos").alias("pos"), F.lit(1).alias("side"), F.struct(*columns).alias("l"), F.lit(None).cast(right.schema["r_pos"].dataType).alias("r_pos"), F.lit(None).cast(right.schema["r_id"].dataType).alias("r_id"))
    b = right.select(*key, F.col("r_pos").alias("pos"), F.lit(0).alias("side"), F.lit(None).cast(a.schema["l"].dataType).alias("l"), "r_pos", "r_id")
    order = Window.partitionBy(*key).orderBy("pos", "side", "r_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("r_pos", "r_id")), ignorenulls=True).over(order)
    found = a.unionByName(b).withColumn("m", last).where("side = 1")
    near = F.col("m") if gap is None else F.when(F.col("pos") - F.col("m.r_pos") <= gap, F.col("m"))
    return found.withColumn("m", near).select(*key, F.col("pos").alias("l_pos"), "l.*", F.col("m.r_pos").alias("r_pos"), F.col("m.r_id").alias("r_id"))
