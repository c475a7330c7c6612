"""Connected components of an edge table, by alternating star contractions.

Every round replaces each node's neighbourhood by a star around its smallest
member (first over larger neighbours, then over smaller ones) until the edge
set stands still.  All steps are group-bys with partial aggregation and
equi-joins that AQE may split, so a hub with very many edges is no obstacle.
The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillstone.storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node of an edge; component is its smallest reachable node.

    Edges with a null end and loops to oneself give no links; a node that
    occurs only in loops is its own component.  Repeated edges count once.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    given = scratch.keep(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null").distinct())
    now, seen = given.where("u <> v"), None
    for _ in range(max_rounds):
        new = scratch.keep(_small_star(_large_star(now)))
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen is not None and hasattr(now, "_scratch_path"):
            scratch.drop(now)
        now = new
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    own = given.where("u = v").select(F.col("u").alias("node")).distinct().join(now.select(F.col("u").alias("node")).unionByName(roots.select("node")), "node", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).unionByName(own.select("node", F.col("node").alias("component"))).distinct()


def sharing_components(pairs: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes ``u`` of ``u, p``; nodes that share a ``p`` are linked, and component is the smallest node.

    Each ``p`` is a star around its smallest node, and each node takes the
    least of its stars' centres for its label.  Only labels that meet other
    centres are left to contract; where there are none, the labels are the
    components.
    """
    scratch = Scratch(pairs.sparkSession, "sharing")
    pairs = pairs.where("u is not null and p is not null")
    met = scratch.keep(pairs.join(pairs.groupBy("p").agg(F.min("u").alias("m")), "p").select("u", "m"))
    labels = scratch.keep(met.groupBy("u").agg(F.min("m").alias("label"), F.max("m").alias("most")))
    torn = labels.where("label <> most")
    if torn.isEmpty():
        return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
    links = met.join(torn.select("u", "label"), "u").where("label <> m").select(F.col("label").alias("u"), F.col("m").alias("v")).distinct()
    found = connected_components(links).withColumnRenamed("node", "label")
    scratch.drop(met)
    return labels.select("u", "label").join(found, "label", "left").select(F.col("u").alias("node"), F.coalesce("component", "label").alias("component"))
