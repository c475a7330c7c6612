"""Queries that build and audit datasets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillstone.functions import text as T
from quillstone.operators import dataset as D
from quillstone.registry import query, table

RATIOS = {"train": 0.75, "validation": 0.1, "calibration": 0.075, "test": 0.075}
_SHARE = "(('0x' || substr(sha256('split:' || doc_id), 1, 8))::BIGINT / 4294967296.0)"
_SPLIT = f"CASE WHEN {_SHARE} < 0.75 THEN 'train' WHEN {_SHARE} < 0.85 THEN 'validation' WHEN {_SHARE} < 0.925 THEN 'calibration' ELSE 'test' END"
_FP = r"sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def hash_partition(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.hash_partition(F.col("doc_id"), RATIOS, "split").alias("split"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return D.duplicate_keys(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


@query(f"SELECT {_FP} AS key, string_agg(DISTINCT source, '/' ORDER BY source) AS labels, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def conflicting_pairs(spark, sf_dir):
    return D.conflicting(table(spark, sf_dir, "documents"), T.text_fingerprint(F.col("text")), F.col("source"))


_VALUES = f"v AS (SELECT DISTINCT {_SPLIT} AS split, 'source_text' AS kind, {_FP} AS value FROM documents UNION SELECT DISTINCT {_SPLIT}, 'source_document', source FROM documents UNION SELECT DISTINCT {_SPLIT}, 'origin_document', 'src' || (doc_id % 50) FROM documents)"


def _values(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("split", D.hash_partition(F.col("doc_id"), RATIOS, "split"))
    out = None
    for kind, c in (("source_text", T.text_fingerprint(F.col("text"))), ("source_document", F.col("source")), ("origin_document", F.concat(F.lit("src"), (F.col("doc_id") % 50).cast("string")))):
        part = d.select("split", F.lit(kind).alias("kind"), c.alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_VALUES} SELECT a.split AS a, b.split AS b, a.kind, count(*) AS n, array_to_string(list_slice(list_sort(list(a.value)), 1, 5), '|') AS examples FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split GROUP BY ALL")
def leakage_overlap(spark, sf_dir):
    return D.overlaps(_values(spark, sf_dir))


@query(f"WITH {_VALUES} SELECT a, b, count(*) AS n FROM (SELECT DISTINCT least(x.split, y.split) AS a, greatest(x.split, y.split) AS b, x.value FROM v x JOIN v y ON x.value = y.value AND x.kind = 'origin_document' AND y.kind = 'source_document' AND x.split <> y.split) GROUP BY ALL")
def cross_role(spark, sf_dir):
    return D.cross_role(_values(spark, sf_dir), "origin_document", "source_document")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty_claim' END, CASE WHEN quality IS NULL THEN 'invalid_label_None' WHEN quality = 0 THEN 'invalid_label_bad' END,
 CASE WHEN n_chars > 8192 THEN 'token_length_exceeded_' || n_chars END, CASE WHEN source = 'src' || (doc_id % 7) THEN 'self_citation' END) AS errors FROM documents LEFT JOIN labels USING (doc_id)""")
def validation_errors(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("quality") == 1, "supported").when(F.col("quality") == 0, "bad")
    sources = F.array(F.struct(F.lit("text").alias("text"), F.col("source").alias("source_id"), F.col("source").alias("document_id")))
    errors = D.validation_errors(F.col("text"), sources, label, F.col("n_chars"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")))
    return d.select("doc_id", F.array_join(errors, ",").alias("errors"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, min('doc:' || o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def components(spark, sf_dir):
    return D.component_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS s, l_returnflag || l_partkey AS p FROM lineitem), g AS (SELECT DISTINCT a.s AS a, b.s AS b FROM e a JOIN e b USING (p)), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a)
 SELECT component, count(*) AS n FROM (SELECT a, min('doc:' || b) AS component FROM r GROUP BY a) GROUP BY 1""")
def component_sizes(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", F.col("l_partkey").cast("string")).alias("part"))
    return D.component_of(e, "l_suppkey", "part").groupBy("component").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS component, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, component) AS i, sum(n) OVER () AS total FROM s),
 f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS component, 0::BIGINT AS n, '' AS split, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
 UNION ALL SELECT o.i, o.component, o.n, p, f.a + CASE WHEN p = 'train' THEN o.n ELSE 0 END, f.b + CASE WHEN p = 'dev' THEN o.n ELSE 0 END, f.c + CASE WHEN p = 'test' THEN o.n ELSE 0 END
 FROM f JOIN (SELECT * FROM o) o ON o.i = f.i + 1, LATERAL (SELECT CASE WHEN f.a / (o.total * 0.5) <= f.b / (o.total * 0.25) AND f.a / (o.total * 0.5) <= f.c / (o.total * 0.25) THEN 'train' WHEN f.b <= f.c THEN 'dev' ELSE 'test' END AS p))
 SELECT component, n, split FROM f WHERE i > 0""")
def bin_pack(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.count("*").alias("n"))
    return D.split_components(sizes, {"train": 0.5, "dev": 0.25, "test": 0.25})


@query("""WITH g AS (SELECT count(DISTINCT (lang, source)) AS k FROM documents), r AS (SELECT doc_id, lang, source, md5(doc_id::VARCHAR) AS d, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR), doc_id) AS n FROM documents)
 SELECT doc_id, lang, source FROM r, g ORDER BY CASE WHEN n <= greatest(1, 100 // k) THEN 0 ELSE 1 END, d, doc_id LIMIT 100""")
def stratified_sample(spark, sf_dir):
    return D.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 100)


@query("""WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY source, md5(doc_id::VARCHAR), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS total, count(*) OVER (PARTITION BY lang, source) AS size, ('0x' || substr(md5('negative:' || doc_id), 1, 8))::BIGINT AS draw FROM documents),
 s AS (SELECT *, min(pos) OVER (PARTITION BY lang, source) AS start FROM r)
 SELECT a.lang, a.doc_id, b.doc_id AS negative FROM s a LEFT JOIN s b ON a.lang = b.lang AND a.total > a.size AND b.pos = (a.start + a.size + a.draw % greatest(a.total - a.size, 1)) % a.total""")
def negative_sample(spark, sf_dir):
    return D.negatives(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang"], "doc_id", "source")


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels USING (doc_id)")
def resume_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(r"""SELECT term, n, row_number() OVER (ORDER BY n DESC, term) - 1 AS token_id FROM (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+|\d+')) AS term FROM (SELECT DISTINCT text FROM documents)) GROUP BY term HAVING count(*) >= 5)""")
def vocab_prune(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text").distinct().select(F.explode(T.tokens(F.col("text"))).alias("term"))
    kept = d.groupBy("term").agg(F.count("*").alias("n")).where("n >= 5")
    # terms of one count are numbered within it, and counts are summed over the (few) distinct counts
    inside = kept.withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy("term")))
    above = kept.groupBy("n").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy(F.desc("n"))) - F.col("k"))
    return inside.join(F.broadcast(above.select("n", "before")), "n").select("term", "n", (F.col("before") + F.col("i") - 1).alias("token_id"))


@query("""SELECT doc_id, lang, source, n FROM (SELECT doc_id, lang, source, row_number() OVER (ORDER BY doc_id) AS n FROM documents WHERE lang = 'en' AND (contains(lower(text), 'the') OR contains(lower(source), 'the'))) ORDER BY doc_id LIMIT 20 OFFSET 40""")
def viewer_filter_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.lower("text").contains("the") | F.lower("source").contains("the"))).select("doc_id", "lang", "source")
    page = d.orderBy("doc_id").limit(60).withColumn("n", F.row_number().over(Window.orderBy("doc_id")).cast("long"))  # one page and those before it
    return page.where("n > 40")


@query("""SELECT CAST(n AS VARCHAR) AS sources, count(*) AS rows FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) GROUP BY 1
 UNION ALL SELECT '3+', count(*) FILTER (n >= 3) FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) UNION ALL SELECT 'multi', count(*) FILTER (n >= 2) FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""")
def viewer_stats(spark, sf_dir):
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    exact = sizes.groupBy(F.col("n").cast("string").alias("sources")).agg(F.count("*").alias("rows"))
    classes = sizes.agg(F.count_if(F.col("n") >= 3).alias("a"), F.count_if(F.col("n") >= 2).alias("b")).select(F.explode(F.array(F.struct(F.lit("3+").alias("sources"), F.col("a").alias("rows")), F.struct(F.lit("multi").alias("sources"), F.col("b").alias("rows")))).alias("x")).select("x.*")
    return exact.unionByName(classes)
