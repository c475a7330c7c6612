"""Queries of lookups, joins, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillstone.operators import lookup as L
from quillstone.operators.policy import existence
from quillstone.registry import query, table


@query("""WITH v AS (SELECT * FROM (VALUES ('O', NULL, TIMESTAMP '1996-01-01', 'old'), ('O', TIMESTAMP '1996-01-01', NULL, 'new'), ('F', TIMESTAMP '1994-01-01', TIMESTAMP '1997-01-01', 'mid')) t(s, a, b, value))
 SELECT o_orderkey, v.value FROM orders LEFT JOIN v ON s = o_orderstatus AND (a IS NULL OR a <= o_orderdate) AND (b IS NULL OR o_orderdate < b)""")
def valid_time_lookup(spark, sf_dir):
    v = spark.createDataFrame([("O", None, "1996-01-01", "old"), ("O", "1996-01-01", None, "new"), ("F", "1994-01-01", "1997-01-01", "mid")], "o_orderstatus string, valid_from string, valid_until string, value string")
    v = v.withColumns({c: F.to_timestamp_ntz(c) for c in ("valid_from", "valid_until")})
    return L.valid_at(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), v, ["o_orderstatus"], "o_orderdate").select("o_orderkey", "value")


@query("""WITH a AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS alias FROM part UNION SELECT DISTINCT lower(p_name) FROM part WHERE p_partkey % 2 = 0)
 SELECT p_partkey, arg_max(alias, length(alias)) AS alias FROM part JOIN a ON lower(p_name) = alias OR starts_with(lower(p_name), alias || ' ') GROUP BY p_partkey""")
def longest_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    aliases = p.select(F.split("p_name", " ")[0].alias("alias")).unionByName(p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("alias")))
    return L.longest_prefix(p, "p_name", "p_partkey", aliases)


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events""")
def forward_fill_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low = e.agg(F.min("event_type").alias("low"))
    marked = e.crossJoin(F.broadcast(low))  # one row
    return marked.select("user_id", "event_id", L.carried(F.when(F.col("event_type") == F.col("low"), F.col("event_id")), ["user_id"], ["ts", "event_id"]).alias("state"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'invalid' WHEN o_custkey IS NOT NULL THEN 'found' ELSE 'unconfirmed' END AS status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey""")
def existence_status(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left")
    return c.select("c_custkey", existence(F.col("c_custkey") % 97 == 0, F.coalesce("seen", F.lit(False))).alias("status"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'reviewer' END, CASE WHEN c_custkey % 3 = 0 THEN 'repair' END, c_mktsegment) AS label FROM customer")
def priority_coalesce(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    one = c.where("c_custkey % 5 = 0").select("c_custkey", F.lit("reviewer").alias("label"))
    two = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("repair").alias("label"))
    return L.overridden(c, [one, two], ["c_custkey"], "label")


@query("SELECT n_name, count(s_suppkey) AS suppliers, count(DISTINCT c_mktsegment) AS segments FROM nation FULL JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) ON c_nationkey = n_nationkey GROUP BY n_name")
def full_outer_manifest(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    j = n.join(s, n["n_nationkey"] == s["s_nationkey"], "full").join(c, n["n_nationkey"] == c["c_nationkey"], "left")
    return j.groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"), F.countDistinct("c_mktsegment").alias("segments"))


@query("SELECT conv_id, turn, lag(turn) OVER w AS before, lead(turn) OVER w AS after, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def window_neighbours(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("before"), F.lead("turn").over(w).alias("after"), F.row_number().over(w).cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_larger FROM lineitem")
def next_larger(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey").rangeBetween(1, Window.unboundedFollowing)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.min("l_partkey").over(w).alias("next_larger"))


@query("SELECT source, doc_id, n FROM (SELECT source, doc_id, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) AS n FROM documents) WHERE n <= 3")
def top_with_ties(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"))
    return table(spark, sf_dir, "documents").withColumn("n", F.rank().over(w).cast("long")).where("n <= 3").select("source", "doc_id", "n")


@query("SELECT text_md5, doc_id AS first_id, last_source FROM (SELECT md5(text) AS text_md5, doc_id, last_value(source) OVER (PARTITION BY text ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def distinct_first_position(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return d.agg(F.min("doc_id").alias("first_id"), F.max_by("source", "doc_id").alias("last_source"))


@query("SELECT lang, source FROM documents WHERE n_chars > 3000 INTERSECT SELECT lang, source FROM documents WHERE n_chars < 500")
def set_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where("n_chars > 3000").select("lang", "source").intersect(d.where("n_chars < 500").select("lang", "source"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_except(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.where("l_returnflag = 'R'").select("l_partkey").subtract(l.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT event_id, user_id, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS gap FROM events)")
def gaps_and_islands(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("gap", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 30 minutes"), 0).otherwise(1))
    return e.select("event_id", "user_id", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


@query("SELECT shard, count(*) AS n FROM (SELECT doc_id % 8 AS shard FROM documents) GROUP BY shard")
def shard_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 8).alias("shard")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT source, -ln(u) / n AS w, u FROM (SELECT source, n, (('0x' || substr(sha256('secret' || source), 1, 12))::BIGINT + 1) / 281474976710656.0 AS u FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1))),
 a AS (SELECT source FROM w ORDER BY w, source LIMIT 4), b AS (SELECT source FROM w WHERE source NOT IN (SELECT source FROM a) ORDER BY u, source LIMIT 4)
 SELECT source, 'weighted' AS kind FROM a UNION ALL SELECT source, 'uniform' FROM b""")
def filler_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return L.fillers(d, "source", "n", 8, "secret")
