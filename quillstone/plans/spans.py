"""Queries over spans, positions and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import spans as S
from quillstone.registry import query, table

_SPANS = """spans AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS id, CAST(l_partkey % 60 AS BIGINT) AS start, CAST(l_partkey % 60 + 1 + l_suppkey % 20 AS BIGINT) AS "end", l_returnflag AS flag FROM lineitem)"""


def _spans(spark, sf_dir):
    start = F.col("l_partkey") % 60
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("id"), start.cast("long").alias("start"), (start + 1 + F.col("l_suppkey") % 20).cast("long").alias("end"), F.col("l_returnflag").alias("flag")
    )


@query(f"""WITH RECURSIVE {_SPANS}, o AS (SELECT k, id, start, "end" AS e, row_number() OVER (PARTITION BY k ORDER BY start, "end" DESC, id) AS n FROM spans),
 f AS (SELECT k, id, start, e, n, true AS kept, e AS last FROM o WHERE n = 1
 UNION ALL SELECT o.k, o.id, o.start, o.e, o.n, o.start >= f.last, CASE WHEN o.start >= f.last THEN o.e ELSE f.last END FROM f JOIN o ON o.k = f.k AND o.n = f.n + 1)
 SELECT k, id, start, e AS "end" FROM f WHERE kept""")
def span_outermost(spark, sf_dir):
    return S.outermost(_spans(spark, sf_dir).drop("flag"), ["k"])


@query()
def span_merge_adjacent(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("targets", F.array(F.col("start") % 3, F.col("end") % 3)).drop("flag")
    return S.merge_adjacent(s, ["k"], gap=5).select("k", "start", "end", F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query(f"""WITH {_SPANS}, b AS (SELECT unnest([0, 1, 2, 3]) AS block_id)
 SELECT k, id, CAST(block_id AS INTEGER) AS block_id, greatest(start, block_id * 20) - block_id * 20 AS start, least("end", block_id * 20 + 20) - block_id * 20 AS "end"
 FROM spans JOIN b ON block_id * 20 < "end" AND block_id * 20 + 20 > start""")
def span_block_overlap(spark, sf_dir):
    s = _spans(spark, sf_dir).drop("flag")
    blocks = s.select("k").distinct().withColumn("block_id", F.explode(F.array(*map(F.lit, range(4)))))
    blocks = blocks.withColumn("b_start", F.col("block_id").cast("long") * 20).withColumn("b_end", F.col("block_id").cast("long") * 20 + 20)
    return S.overlap_join(s, blocks, ["k"])


@query(f"""WITH {_SPANS}, p AS (SELECT k, start AS p FROM spans UNION SELECT k, "end" FROM spans), r AS (SELECT k, p AS start, lead(p) OVER (PARTITION BY k ORDER BY p) AS e FROM p)
 SELECT r.k, r.start, r.e AS "end", coalesce(string_agg(DISTINCT CAST(s.id AS VARCHAR), ',' ORDER BY CAST(s.id AS VARCHAR)), '') AS ids
 FROM r LEFT JOIN spans s ON s.k = r.k AND s.start <= r.start AND s."end" >= r.e WHERE r.e IS NOT NULL GROUP BY ALL""")
def span_sweep_segments(spark, sf_dir):
    got = S.segments(_spans(spark, sf_dir).drop("flag"), ["k"])
    return got.select("k", "start", "end", F.array_join(F.sort_array(F.transform("ids", lambda x: x.cast("string"))), ",").alias("ids"))


@query(f"""WITH {_SPANS} SELECT k, id, start, "end" FROM spans a WHERE flag = 'N' AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.flag <> 'N' AND b.k = a.k AND b.start < a."end" AND b."end" > a.start)""")
def overlap_anti(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return S.without_overlap(s.where("flag = 'N'").drop("flag"), s.where("flag <> 'N'").drop("flag"), ["k"])


@query(f"""WITH {_SPANS}, a AS (SELECT * FROM spans WHERE flag = 'A'), b AS (SELECT * FROM spans x WHERE flag = 'N' AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = x.k AND a.start < x."end" AND a."end" > x.start)),
 ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), c AS (SELECT * FROM spans x WHERE flag = 'R' AND NOT EXISTS (SELECT 1 FROM ab WHERE ab.k = x.k AND ab.start < x."end" AND ab."end" > x.start))
 SELECT k, id, start, "end", flag FROM ab UNION ALL SELECT k, id, start, "end", flag FROM c""")
def priority_merge(spark, sf_dir):
    s = _spans(spark, sf_dir)
    return S.priority_merge([s.where(F.col("flag") == f) for f in "ANR"], ["k"])


_EVENTS = """l AS (SELECT user_id, event_id AS l_id, event_id AS l_pos FROM events WHERE event_type = (SELECT min(event_type) FROM events)), r AS (SELECT user_id, event_id AS r_id, event_id AS r_pos FROM events WHERE event_type = (SELECT max(event_type) FROM events))"""


def _two_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    left = e.where(F.col("event_type") == low).select("user_id", F.col("event_id").alias("l_id"), F.col("event_id").alias("l_pos"))
    return left, e.where(F.col("event_type") == high).select("user_id", F.col("event_id").alias("r_id"), F.col("event_id").alias("r_pos"))


@query(f"""WITH {_EVENTS}, m AS (SELECT l.user_id, l_id, r_id, CASE WHEN r_pos >= l_pos THEN r_pos - l_pos ELSE l_pos - r_pos + 1000 END AS distance FROM l JOIN r ON l.user_id = r.user_id AND abs(r_pos - l_pos) <= 2000)
 SELECT user_id, l_id, r_id, distance FROM (SELECT *, rank() OVER (PARTITION BY user_id, l_id ORDER BY distance) AS n FROM m) WHERE n = 1""")
def nearest_binding(spark, sf_dir):
    left, right = _two_kinds(spark, sf_dir)
    return S.nearest(left, right, ["user_id"], 2000).select("user_id", "l_id", "r_id", "distance")


@query(f"WITH {_EVENTS} SELECT l.user_id, l_id, r_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l_pos >= r_pos")
def asof_backward(spark, sf_dir):
    left, right = _two_kinds(spark, sf_dir)
    return S.asof_backward(left, right, ["user_id"]).select("user_id", "l_id", "r_id")
