"""Queries of metrics, calibration and verdict policies; the first four embedding components stand in for logits."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillstone.functions import numbers as N
from quillstone.operators import calibration as C
from quillstone.operators import policy as P
from quillstone.registry import query, table

_P = """z AS (SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS target, [x * 8 FOR x IN CAST(embedding[1:4] AS DOUBLE[])] AS l FROM embeddings), y AS (SELECT vec_id, target, [exp((x - list_max(l)) / 0.5) FOR x IN l] AS e FROM z),
 s AS (SELECT vec_id, target, [x / list_sum(e) FOR x IN e] AS p FROM y), q AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred, list_max(p) AS confidence, list_max(p) - list_sort(p)[3] AS margin FROM s)"""


def _scored(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 8)
    rows = e.select("vec_id", (F.col("vec_id") % 4).cast("int").alias("target"), logits.alias("logits"))
    return C.predictions(rows.withColumn("probs", N.softmax(F.col("logits"), 0.5)))


@query(f"WITH {_P} SELECT vec_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, round(p[4], 6) AS p3, pred, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM q")
def softmax_temperature(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("vec_id", *[F.round(F.col("probs")[i], 6).alias(f"p{i}") for i in range(4)], "pred", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


@query(f"WITH {_P}, g AS (SELECT t, p FROM (SELECT unnest([0, 1, 2, 3]) AS t), (SELECT unnest([0, 1, 2, 3]) AS p)) SELECT CAST(g.t AS INTEGER) AS target, CAST(g.p AS INTEGER) AS pred, count(q.vec_id) AS n FROM g LEFT JOIN q ON q.target = g.t AND q.pred = g.p GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return C.confusion(_scored(spark, sf_dir), 4)


_PRF = """m AS (SELECT c, (SELECT count(*) FROM q WHERE target = c AND pred = c) AS tp, (SELECT count(*) FROM q WHERE target = c) AS support, (SELECT count(*) FROM q WHERE pred = c) AS predicted FROM (SELECT unnest([0, 1, 2, 3]) AS c)),
 f AS (SELECT c, tp / greatest(predicted, 1) AS precision, tp / greatest(support, 1) AS recall, support FROM m), r AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM f)"""


@query(f"WITH {_P}, {_PRF} SELECT CAST(c AS INTEGER) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r")
def class_metrics(spark, sf_dir):
    m = C.class_metrics(_scored(spark, sf_dir), 4)
    return m.select("class", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_P}, {_PRF} SELECT (SELECT round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END), 6) FROM q) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM r")
def prf_macro(spark, sf_dir):
    s = _scored(spark, sf_dir)
    accuracy = s.agg(F.round(F.avg((F.col("pred") == F.col("target")).cast("double")), 6).alias("accuracy"))
    return accuracy.crossJoin(C.class_metrics(s, 4).agg(F.round(F.avg("f1"), 6).alias("macro_f1")))  # one row each


@query(f"WITH {_P}, b AS (SELECT ceil(confidence * 15) AS b, count(*) AS n, avg(CASE WHEN pred = target THEN 1.0 ELSE 0.0 END) AS acc, avg(confidence) AS conf FROM q GROUP BY 1) SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece FROM b")
def ece(spark, sf_dir):
    return C.expected_calibration_error(_scored(spark, sf_dir)).select(F.round("ece", 6).alias("ece"))


@query(f"WITH {_P} SELECT round(avg(list_sum([(p[i + 1] - CASE WHEN i = target THEN 1 ELSE 0 END) ** 2 FOR i IN [0, 1, 2, 3]])), 6) AS brier FROM q")
def brier(spark, sf_dir):
    return _scored(spark, sf_dir).agg(F.round(F.avg(N.brier(F.col("probs"), F.col("target"))), 6).alias("brier"))


_W = "(c / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((c / n * (1 - c / n) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)"


@query(f"SELECT source, round({_W}, 6) AS bound FROM (SELECT source, count(*) FILTER (quality = 1)::DOUBLE AS c, count(*)::DOUBLE AS n FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def wilson(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("c"), F.count("*").alias("n"))
    return d.select("source", F.round(N.wilson_lower_bound(F.col("c"), F.col("n")), 6).alias("bound"))


@query(f"WITH {_P} SELECT pred AS class, count(*) AS total, count(*) FILTER (confidence >= 0.5 AND margin >= 0.1) AS accepted, count(*) FILTER (confidence >= 0.5 AND margin >= 0.1 AND pred = target) AS correct FROM q WHERE pred < 3 GROUP BY pred UNION ALL SELECT 3, count(*), 0, 0 FROM q WHERE pred = 3 HAVING count(*) > 0")
def selective_metrics(spark, sf_dir):
    return C.selective(_scored(spark, sf_dir), {0: 0.5, 1: 0.5, 2: 0.5, 3: C.DISABLED}, 0.1).drop("precision")


@query(f"""WITH {_P}, m AS (SELECT unnest([0.0, 0.1]) AS min_margin), k AS (SELECT CAST(m.min_margin AS DOUBLE) AS min_margin, q.* FROM q JOIN m ON margin >= m.min_margin)
 SELECT min_margin, pred, round(confidence, 6) AS threshold, accepted, correct FROM (SELECT min_margin, pred, confidence, count(*) OVER w AS accepted, count(*) FILTER (pred = target) OVER w AS correct FROM k WINDOW w AS (PARTITION BY min_margin, pred ORDER BY confidence DESC RANGE UNBOUNDED PRECEDING)) GROUP BY ALL""")
def threshold_search(spark, sf_dir):
    t = C.threshold_candidates(_scored(spark, sf_dir), [0.0, 0.1])
    return t.select("min_margin", "pred", F.round("threshold", 6).alias("threshold"), "accepted", "correct")


@query()
def fail_closed_thresholds(spark, sf_dir):
    return C.fail_closed_thresholds(_scored(spark, sf_dir), 4, 0.25, least=20, wilson=False)


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber))")
def breakdown_grouping_sets(spark, sf_dir):
    sets = [[F.col("l_returnflag")], [F.col("l_linestatus")], [F.col("l_linenumber")]]
    return table(spark, sf_dir, "lineitem").groupingSets(sets, "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"""WITH {_P}, g AS (SELECT vec_id // 5 AS row_id, vec_id % 5 AS i, p FROM q), a AS (SELECT row_id, max(p[1]) AS a, min(p[2]) AS b, max(p[3]) AS c, max(p[4]) AS d, arg_max(i, (p[1], -i)) AS ia, arg_min(i, (p[2], i)) AS ib FROM g GROUP BY 1)
 SELECT row_id, round(a / (a + b + c + d), 6) AS supported, round(b / (a + b + c + d), 6) AS unsupported, round(c / (a + b + c + d), 6) AS incorrect, round(d / (a + b + c + d), 6) AS misleading, CAST(ia AS INTEGER) AS chunk_supported, CAST(ib AS INTEGER) AS chunk_unsupported FROM a""")
def pool_chunks(spark, sf_dir):
    s = _scored(spark, sf_dir).select(F.floor(F.col("vec_id") / 5).alias("row_id"), (F.col("vec_id") % 5).alias("index"), "probs")
    names = ["supported", "unsupported", "incorrect", "misleading"]
    return C.pool_chunks(s, ["row_id"], names).select("row_id", *(F.round(c, 6).alias(c) for c in names), "chunk_supported", "chunk_unsupported")


@query(f"WITH {_P}, r AS (SELECT vec_id, pred, CASE WHEN pred = 1 AND vec_id % 3 = 0 THEN 'partial_sources' WHEN pred = 3 THEN 'class_disabled' WHEN confidence < 0.5 THEN 'low_confidence' WHEN margin < 0.2 THEN 'low_margin' END AS reason FROM q) SELECT vec_id, CASE WHEN reason IS NULL THEN pred END AS label, reason FROM r")
def policy_four(spark, sf_dir):
    v = P.four_label(F.col("pred"), F.col("confidence"), F.col("margin"), {0: 0.5, 1: 0.5, 2: 0.5, 3: C.DISABLED}, 0.2, F.col("vec_id") % 3 == 0)
    return _scored(spark, sf_dir).select("vec_id", v.alias("v")).select("vec_id", "v.label", "v.reason")


@query(f"""WITH {_P}, g AS (SELECT vec_id // 3 AS row_id, vec_id % 3 AS i, p[1] + p[4] AS e, p[2] AS n, p[3] AS c FROM q), a AS (SELECT row_id, max(e) AS e, max(c) AS c, bool_and(n >= 0.8) AS nn, arg_max(i, (e, -i)) AS ei, arg_max(i, (c, -i)) AS ci, arg_max(i, (n, -i)) AS ni FROM g GROUP BY 1),
 v AS (SELECT *, (e >= 0.9 AND c >= 0.7) OR (c >= 0.9 AND e >= 0.7) AS clash, nn OR (e < 0.7 AND c < 0.7) AS weak FROM a)
 SELECT row_id, CASE WHEN clash THEN 'abstain' WHEN e >= 0.9 THEN 'correct' WHEN c >= 0.9 THEN 'incorrect' WHEN weak THEN 'missing' ELSE 'abstain' END AS status, CASE WHEN clash OR e >= 0.9 THEN ei WHEN c >= 0.9 THEN ci WHEN weak THEN ni WHEN e >= c THEN ei ELSE ci END AS evidence FROM v""")
def policy_three(spark, sf_dir):
    p = F.col("probs")
    s = _scored(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("row_id"), (F.col("vec_id") % 3).alias("index"), (p[0] + p[3]).alias("entailment"), p[1].alias("neutral"), p[2].alias("contradiction"))
    return P.three_label(s, ["row_id"])


@query(f"WITH {_P} SELECT vec_id, CAST(l AS DOUBLE) AS level, CASE WHEN confidence >= l THEN CAST(pred AS VARCHAR) ELSE 'abstain' END AS decision FROM q, (SELECT unnest([0.4, 0.6, 0.8]) AS l)")
def certainty_levels(spark, sf_dir):
    return P.certainty_levels(_scored(spark, sf_dir), [0.4, 0.6, 0.8]).select("vec_id", "level", "decision")


@query("""WITH s AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'unconfirmed' WHEN 2 THEN 'found' WHEN 3 THEN 'pending' ELSE CASE WHEN event_id % 25 = 4 THEN 'invalid' ELSE 'found' END END AS status FROM events)
 SELECT user_id, arg_min(status, CASE status WHEN 'invalid' THEN 1 WHEN 'error' THEN 2 WHEN 'pending' THEN 3 WHEN 'unconfirmed' THEN 4 ELSE 5 END) AS status FROM s GROUP BY user_id""")
def severity_rollup(spark, sf_dir):
    k = F.col("event_id") % 5
    status = F.when(k == 1, "unconfirmed").when(k == 3, "pending").when((k == 4) & (F.col("event_id") % 25 == 4), "invalid").otherwise("found")
    return P.severity(table(spark, sf_dir, "events").select("user_id", status.alias("status")), ["user_id"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(min(value), 6) AS low FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(*(F.round(x, 6).alias(n) for n, x in (("median", F.percentile("value", 0.5)), ("p95", F.percentile("value", 0.95)), ("mean", F.avg("value")), ("low", F.min("value")))))


@query("SELECT lang, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM documents GROUP BY lang")
def class_weights(spark, sf_dir):
    return C.class_weights(table(spark, sf_dir, "documents"), "lang").select("lang", F.round("weight", 6).alias("weight"))


@query("SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM labels")
def agreement_rate(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query(f"WITH {_P}, r AS (SELECT CASE WHEN pred = 3 THEN 'class_disabled' WHEN confidence < 0.5 THEN 'low_confidence' WHEN margin < 0.2 THEN 'low_margin' ELSE 'accepted' END AS reason FROM q) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def abstain_reasons(spark, sf_dir):
    v = P.four_label(F.col("pred"), F.col("confidence"), F.col("margin"), {0: 0.5, 1: 0.5, 2: 0.5, 3: C.DISABLED}, 0.2)
    return _scored(spark, sf_dir).groupBy(F.coalesce(v["reason"], F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
