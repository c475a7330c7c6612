"""Queries that rank, window and cut evidence."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillstone.functions import text as T
from quillstone.operators import retrieval as R
from quillstone.registry import query, table

_TOK = r"regexp_extract_all(lower(text), '\p{L}+|\d+')"


@query(rf"""WITH d AS (SELECT doc_id, {_TOK} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
 t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
 x AS (SELECT item_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL)
 SELECT item_id, doc_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM x) WHERE n <= 5""")
def bm25_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scored = R.bm25(queries, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return R.top_k(scored, 5, ["query_id"]).select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(rf"""WITH c AS (SELECT conv_id AS g, turn AS doc_id, {_TOK} AS w FROM conversations WHERE role <> 'user'), s AS (SELECT g, count(*) AS n, avg(len(w)) AS avgdl FROM c GROUP BY g),
 tf AS (SELECT g, doc_id, dl, term, count(*) AS tf FROM (SELECT g, doc_id, len(w) AS dl, unnest(w) AS term FROM c) GROUP BY ALL), df AS (SELECT g, term, count(*) AS df FROM tf GROUP BY ALL),
 q AS (SELECT g, query_id, term, count(*) AS qtf FROM (SELECT conv_id AS g, turn AS query_id, unnest({_TOK}) AS term FROM conversations WHERE role = 'user') GROUP BY ALL),
 x AS (SELECT g, query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-6)))), 6) AS score FROM q JOIN tf USING (g, term) JOIN df USING (g, term) JOIN s USING (g) GROUP BY ALL)
 SELECT g AS conv_id, query_id, doc_id, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g, query_id ORDER BY score DESC, doc_id) AS n FROM x) WHERE n <= 2""")
def bm25_per_group(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    queries = c.where("role = 'user'").select("conv_id", F.col("turn").alias("query_id"), "text")
    corpus = c.where("role <> 'user'").select("conv_id", F.col("turn").alias("doc_id"), "text")
    scored = R.bm25(queries, corpus, group="conv_id")
    return R.top_k(scored, 2, ["conv_id", "query_id"]).select("conv_id", "query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
 c AS (SELECT doc_id, i, CAST(floor(len(regexp_extract_all(t, '\S+')) * 1.35::DOUBLE) AS INTEGER) + 5 AS cost FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cost DESC, i) AS n FROM c),
 f AS (SELECT doc_id, n, i, cost AS total, true AS taken FROM o WHERE n = 1
 UNION ALL SELECT o.doc_id, o.n, o.i, CASE WHEN f.total + o.cost <= 380 THEN f.total + o.cost ELSE f.total END, f.total + o.cost <= 380 FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1 WHERE f.total < 380)
 SELECT doc_id, CAST(i AS INTEGER) AS place FROM f WHERE taken""")
def budget_window(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    ranked = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-T.token_estimate(F.col("t"))).alias("neg"), "i"))).alias("r"))
    taken = ranked.select("doc_id", "r", F.explode(R.greedy_fill(F.transform("r", lambda x: -x["neg"]), 380)).alias("n"))
    return taken.select("doc_id", F.col("r")[F.col("n")]["i"].alias("place"))


@query(r"""WITH b AS (SELECT doc_id, trim(text) AS whole, [trim(x, ' ') FOR x IN string_split(text, chr(10) || chr(10)) IF length(trim(x, ' ')) > 15] AS d, [trim(x, ' ') FOR x IN string_split(text, chr(10)) IF length(trim(x, ' ')) > 15] AS s FROM documents),
 p AS (SELECT doc_id, CASE WHEN len(d) > 0 THEN d WHEN len(s) > 0 THEN s WHEN whole <> '' THEN [whole] ELSE [] END AS p FROM b)
 SELECT doc_id, CAST(count(*) AS INTEGER) AS paragraphs, CAST(count(*) FILTER (length(x) > 1500) AS INTEGER) AS long_paragraphs FROM (SELECT doc_id, unnest(p) AS x FROM p) GROUP BY doc_id""")
def chunk_paragraphs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(R.paragraphs(F.col("text"))).alias("x"))
    return d.groupBy("doc_id").agg(F.count("*").cast("int").alias("paragraphs"), F.count_if(F.length("x") > 1500).cast("int").alias("long_paragraphs"))


@query()
def chunk_sentences(spark, sf_dir):
    return R.chunks(table(spark, sf_dir, "documents")).select("doc_id", "p_idx", "text")


@query(r"""WITH RECURSIVE c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY turn) AS i, text FROM (SELECT conv_id AS doc_id, turn, text FROM conversations WHERE length(trim(text)) > 15 AND length(text) <= 1500 AND NOT regexp_matches(text, '\n\s*\n'))),
 f AS (SELECT doc_id, i, text AS open, length(text) >= 120 AS done FROM c WHERE i = 1 UNION ALL SELECT c.doc_id, c.i, CASE WHEN f.done THEN c.text ELSE f.open || chr(10) || chr(10) || c.text END, length(CASE WHEN f.done THEN c.text ELSE f.open || chr(10) || chr(10) || c.text END) >= 120 FROM f JOIN c ON c.doc_id = f.doc_id AND c.i = f.i + 1),
 o AS (SELECT doc_id, i, open, done, max(i) OVER (PARTITION BY doc_id) AS last FROM f)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS index, trim(open) AS text FROM o WHERE done OR i = last""")
def chunk_merge_short(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(r"length(trim(text)) > 15 and length(text) <= 1500 and not text rlike '\\n\\s*\\n'")
    docs = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return R.merge_short(docs).withColumn("text", F.trim("text"))


@query(r"""WITH q AS (SELECT conv_id, turn, role, length(text) AS score FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY score DESC, turn) AS in_role FROM q),
 o AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN in_role = 1 AND role = 'system' THEN 0 WHEN in_role = 1 AND role = 'assistant' THEN 1 ELSE 2 END, score DESC, turn) AS n FROM r)
 SELECT conv_id, turn, role, CAST(n AS INTEGER) AS rank FROM o WHERE n <= 3""")
def passage_topk_reserved(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("score"))
    q = q.withColumn("in_role", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("score"), "turn")))
    slot = F.when((F.col("in_role") == 1) & (F.col("role") == "system"), 0).when((F.col("in_role") == 1) & (F.col("role") == "assistant"), 1).otherwise(2)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(slot, F.desc("score"), "turn"))
    return q.withColumn("rank", n.cast("int")).where("rank <= 3").select("conv_id", "turn", "role", "rank")
