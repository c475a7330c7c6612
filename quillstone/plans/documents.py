"""Queries over identifiers, citations, structure and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T, uri as U
from quillstone.operators import citations as C, claims as K, families as G, structure as S
from quillstone.registry import query, table

@query("""SELECT l_orderkey, l_linenumber, (1900 + l_orderkey % 120) || ':' || l_partkey || '#K' || l_linenumber || 'P' || l_suppkey || CASE WHEN l_linenumber % 2 = 0 THEN 'S' || l_linenumber WHEN l_linenumber % 3 = 0 THEN 'S1' ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN 'N2' ELSE '' END AS uri FROM lineitem""")
def statute_uri(spark, sf_dir):
    l, s = table(spark, sf_dir, "lineitem"), lambda c: c.cast("string")
    n = F.col("l_linenumber")
    law = F.concat(s(F.col("l_orderkey") % 120 + 1900), F.lit(":"), s(F.col("l_partkey")))
    uri = U.statute(law, s(n), s(F.col("l_suppkey")), F.when(n % 2 == 0, s(n)), F.when(n % 3 == 0, F.lit("2")), F.lit(None).cast("string"))
    return l.select("l_orderkey", "l_linenumber", uri.alias("uri"))


@query("""SELECT o_orderkey, 'celex/3' || (1950 + o_orderkey % 50) || CASE o_orderkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'R' ELSE 'D' END || lpad(CAST(o_custkey % 1000 AS VARCHAR), 4, '0') AS uri FROM orders""")
def celex_uri(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "direktiv").when(F.col("o_orderkey") % 3 == 1, "Regulation").otherwise("beslut")
    year, number = (F.col("o_orderkey") % 50 + 1950).cast("string"), (F.col("o_custkey") % 1000).cast("string")
    flip = (F.col("o_orderkey") % 2 == 0) & (F.col("o_custkey") % 1000 > 99)
    uri = U.celex_act(kind, F.when(flip, number).otherwise(year), F.when(flip, year).otherwise(number))
    return o.select("o_orderkey", uri.alias("uri"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'statute' WHEN 1 THEN 'echr' WHEN 2 THEN 'case' WHEN 3 THEN 'eu_case' ELSE 'prop' END AS source, CASE event_id % 5 WHEN 0 THEN 'provision' WHEN 4 THEN 'preparatory' ELSE 'judgment' END AS kind FROM events""")
def uri_source(spark, sf_dir):
    starts = ["1915:218#P", "dom/echr/001-", "dom/nja/2009s", "celex/62016CJ", "prop/2008/09:"]
    e = table(spark, sf_dir, "events")
    uri = F.concat(F.array(*map(F.lit, starts))[(F.col("event_id") % 5).cast("int")], F.col("event_id").cast("string"))
    source = U.source_of(uri)
    return e.select("event_id", source.alias("source"), U.target_kind(source).alias("kind"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 20 <= 10 THEN array_to_string(range(o_orderkey, o_orderkey + o_custkey % 20 + 1), ',') ELSE o_orderkey || ',' || (o_orderkey + o_custkey % 20) END AS numbers FROM orders""")
def paragraph_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("p. "), F.col("o_orderkey").cast("string"), F.lit("–"), (F.col("o_orderkey") + F.col("o_custkey") % 20).cast("string"))
    return o.select("o_orderkey", F.array_join(F.transform(T.paragraph_range(text), lambda x: x.cast("string")), ",").alias("numbers"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def swedish_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    months = F.array(*map(F.lit, "januari februari mars april maj juni juli augusti september oktober november december".split()))
    text = F.concat_ws(" ", F.dayofmonth("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")), F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", U.swedish_date(F.concat(F.lit("den "), text)).alias("day"))


@query("SELECT l_orderkey, l_linenumber, 'prop/2008/09:' || l_partkey || '#sid' || (l_suppkey + 1) AS adjacent FROM lineitem")
def adjacent_unit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    uri = F.concat(F.lit("prop/2008/09:"), F.col("l_partkey").cast("string"), F.lit("#sid"), F.col("l_suppkey").cast("string"))
    return l.select("l_orderkey", "l_linenumber", G.adjacent_unit(uri).alias("adjacent"))


@query("""SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, CAST((row_number() OVER (PARTITION BY bucket ORDER BY md5('0' || doc_id), doc_id) - 1) // 16 AS INTEGER) AS batch FROM (SELECT doc_id, CASE WHEN n_chars <= 512 THEN 0 WHEN n_chars <= 2048 THEN 1 WHEN n_chars <= 4096 THEN 2 ELSE 3 END AS bucket FROM documents)""")
def length_batches(spark, sf_dir):
    return G.batches(table(spark, sf_dir, "documents"), "n_chars", "doc_id", 16).select("doc_id", "bucket", "batch")


_PARTS = """p AS (SELECT o_orderkey AS doc_id, (o_orderkey % 40 + 1) || ' kap. ' || (o_custkey % 60 + 1) || ' § brottsbalken' AS c1, '1962:700#K' || (o_orderkey % 40 + 1) || 'P' || (o_custkey % 60 + 1) AS u1,
 'NJA ' || (1990 + o_orderkey % 30) || ' s. ' || (o_custkey % 900 + 1) AS c2, 'dom/nja/' || (1990 + o_orderkey % 30) || 's' || (o_custkey % 900 + 1) AS u2,
 'prop. 200' || (o_orderkey % 9) || '/0' || (o_orderkey % 9 + 1) || ':' || (o_custkey % 300 + 1) || ' s. ' || (o_orderkey % 200 + 1) AS c3, 'prop/200' || (o_orderkey % 9) || '/0' || (o_orderkey % 9 + 1) || ':' || (o_custkey % 300 + 1) || '#sid' || (o_orderkey % 200 + 1) AS u3 FROM orders)"""


#: Orders in a partition: their texts cost far more than their bytes in the file, which decide how it is split.
ORDERS = 20_000


def _citing(spark, sf_dir):
    """``doc_id, c1, c2, c3``: a provision, a case and a page of a bill, different for each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = orders.repartition(max(1, -(-orders.count() // ORDERS)), "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    return orders.select(
        k.alias("doc_id"),
        F.concat(s(k % 40 + 1), F.lit(" kap. "), s(c % 60 + 1), F.lit(" § brottsbalken")).alias("c1"),
        F.concat(F.lit("NJA "), s(k % 30 + 1990), F.lit(" s. "), s(c % 900 + 1)).alias("c2"),
        F.concat(F.lit("prop. 200"), s(k % 9), F.lit("/0"), s(k % 9 + 1), F.lit(":"), s(c % 300 + 1), F.lit(" s. "), s(k % 200 + 1)).alias("c3"),
    )


@query(f"""WITH {_PARTS}, s AS (SELECT *, 7 AS a1, 7 + length(c1) + 19 AS a2, 7 + length(c1) + 19 + length(c2) + 5 AS a3 FROM p)
 SELECT doc_id, a1 AS start, a1 + length(c1) AS "end", c1 AS text, u1 AS uri, 'statute' AS kind FROM s UNION ALL SELECT doc_id, a2, a2 + length(c2), c2, u2, 'case' FROM s UNION ALL SELECT doc_id, a3, a3 + length(c3), c3, u3, 'work' FROM s""")
def extract_citations(spark, sf_dir):
    text = F.concat(F.lit("Enligt "), "c1", F.lit(" gäller detta. Jfr "), "c2", F.lit(" och "), "c3", F.lit("."))
    found = C.extract(_citing(spark, sf_dir).select("doc_id", text.alias("text"))).select("doc_id", F.explode("refs").alias("r"))
    return found.select("doc_id", "r.*")


@query(f"""WITH {_PARTS}, s AS (SELECT *, 'Köparen bär ansvaret (se ' || c1 || ').' AS one, 'Säljaren ska lämna varan. Det gäller även hyra (jfr ' || c2 || ').' AS two FROM p)
 SELECT doc_id, 0 AS start, length(one) + 1 AS "end", u1 AS uri, one AS claim, 'Köparen bär ansvaret.' AS hypothesis FROM s
 UNION ALL SELECT doc_id, length(one) + 1, length(one) + 1 + length(two), u2, two, 'Säljaren ska lämna varan. Det gäller även hyra.' FROM s""")
def claim_context(spark, sf_dir):
    text = F.concat(F.lit("Köparen bär ansvaret (se "), "c1", F.lit("). Säljaren ska lämna varan. Det gäller även hyra (jfr "), "c2", F.lit(")."))
    return K.cited_claims(_citing(spark, sf_dir).select("doc_id", text.alias("text")))


@query()
def html_blocks(spark, sf_dir):
    return S.html_blocks(table(spark, sf_dir, "pages"))


@query()
def offset_map(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.offset_map("text").alias("m"))
    return d.select("doc_id", F.length("m.text").alias("n"), F.size("m.offsets").alias("places"))


@query()
def verdicts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    sources = c.where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").cast("string").alias("citation"), "text"))).alias("sources"))
    asked = c.where("role = 'user'").join(sources, "conv_id").select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), F.col("text").alias("claim"), "sources", F.lit(False).alias("unresolved"))
    return K.verdicts(asked).select("row_id", "label", "reason")
