"""Queries over texts: normalisation, tokens, sentences, claims, premises."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.registry import query, table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORD = r"(?:^|[^\p{L}\p{N}_])"
_END = r"(?:$|[^\p{L}\p{N}_])"


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\s*\n\s*\n\s*', chr(57344), 'g'), '\s+', ' ', 'g'), chr(57344), chr(10) || chr(10), 'g')) AS norm_md5 FROM documents""")
def norm_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.whitespace(F.col("text")).cast("binary")).alias("norm_md5"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS fingerprint FROM documents")
def norm_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_fingerprint(F.col("text")).alias("fingerprint"))


@query(r"""SELECT a.conv_id, a.turn, sha256(concat_ws(chr(31), trim(a.text), b.role, CAST(b.turn AS VARCHAR), trim(regexp_replace(b.text, '\s+', ' ', 'g')))) AS pair,
 substr(md5(concat_ws('_', CAST(a.conv_id AS VARCHAR), CAST(a.turn AS VARCHAR))), 1, 12) AS short_id
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def pair_fingerprint(spark, sf_dir):
    a = table(spark, sf_dir, "conversations")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b_text"), F.col("role").alias("b_role"))
    key = F.concat_ws("\x1f", F.trim("text"), "b_role", (F.col("turn") + 1).cast("string"), T.collapsed(F.col("b_text")))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.sha2(key, 256).alias("pair"), T.short_id(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("short_id"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '<[^>]*>', '', 'g'), '[*_`#]', '', 'g'))) AS plain_md5 FROM documents""")
def markdown_plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.plain_markdown(F.col("text")).cast("binary")).alias("plain_md5"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def plain_text_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.plain_html(F.col("html")).alias("plain"))


@query(r"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, t[1] AS first_token
 FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|\d+') AS t FROM documents)""")
def tokens_letter_digit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.try_element_at("t", F.lit(1)).alias("first_token"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS INTEGER) AS n_tokens FROM documents")
def tokens_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.tokens(F.col("text"), "word")).alias("n_tokens"))


@query(r"SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.35::DOUBLE) AS INTEGER) + 5 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN t <= 512 THEN '<=512' WHEN t <= 2048 THEN '513-2048' WHEN t <= 4096 THEN '2049-4096' ELSE '4097-8192' END AS bucket
 FROM (SELECT CAST(floor(len(regexp_extract_all(text, '\S+')) * 1.35::DOUBLE) AS INTEGER) + 5 AS t FROM documents)) GROUP BY bucket""")
def length_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(T.length_bucket(T.token_estimate(F.col("text"))).alias("bucket"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
 FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(57345), 'g'), chr(57345)) AS s FROM documents))""")
def sentence_split_simple(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences_simple(F.col("text"))).alias("n", "sentence"))


@query(rf"""WITH d AS (SELECT doc_id, [x FOR x IN regexp_extract_all(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '<[^>]*>', '', 'g'), '[*_`#]', '', 'g'))), '\p{{L}}{{3,}}') IF x NOT IN ({_STOP})] AS w FROM documents),
 b AS (SELECT item_id, list_distinct([x FOR x IN regexp_extract_all(lower(text), '\p{{L}}{{3,}}') IF x NOT IN ({_STOP})]) AS q FROM benchmark)
 SELECT doc_id, item_id, round(len(list_intersect(q, w)) / sqrt(greatest(len(list_distinct(w)), 1)::DOUBLE), 6) AS score
 FROM d JOIN b ON item_id = doc_id % (SELECT count(*) FROM benchmark)""")
def content_words_overlap(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.content_words(F.col("text"))).alias("q"))
    n = items.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("item_id"), T.content_words(F.col("text")).alias("w"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(T.overlap_score(F.col("q"), F.col("w")), 6).alias("score"))


_VERB = T.VERB_PATTERN.replace("(?iu)", "(?i)")
_WRONG = [
    r"(?i)(?:(?:^|[^\p{L}\p{N}_])\d+\s*§|(?:^|[^\p{L}])(?:lagen|balken|avtalslagen|handelsbalken|brottsbalken|skadeståndslagen)(?:[^\p{L}]|$)).*(?:dömde|dömer|dömt|dömd|fällde|fällt)\s+.*\s+(?:till\s+fängelse|till\s+böter|till\s+påföljd)",
    r"(?i)(?:tingsrätten|hovrätten|högsta\s+domstolen|hd|hfd)\s+är\s+ett?\s+(?:mord|dråp|brott|stöld)",
    r"(?i)personskada\s+som\s+ska\s+ersätta\s+sig\s+själv",
]


@query(rf"""SELECT conv_id, turn, r IS NULL AS ok, r AS reason FROM (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(trim(text), '<[^>]+>|' || chr(65533)) THEN 'unreadable'
 WHEN len(regexp_extract_all(trim(text), '[\p{{L}}\p{{N}}_]{{2,}}')) < 3 OR NOT regexp_matches(trim(text), '{_VERB}') THEN 'no_statement'
 WHEN {" OR ".join(f"regexp_matches(trim(text), '{p}')" for p in _WRONG)} THEN 'category_error' END AS r FROM conversations)""")
def assessable_claims(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.assessable(F.col("text")).alias("a")).select("conv_id", "turn", F.col("a.ok").alias("ok"), F.col("a.reason").alias("reason"))


@query(rf"""SELECT conv_id, turn, length(text) >= 35 AND regexp_matches(text, '^[0-9A-ZÅÄÖ]') AND NOT regexp_matches(text, '(?i){_WORD}(?:sid\s*\d+|slutligt beslut|tingsrätt|hovrätt|mål\s*nr|aktbil|protokoll){_END}')
 AND NOT regexp_matches(text, '(?i)\((?:se|jfr){_END}') AND len(regexp_extract_all(text, '\S+')) >= 6 AND NOT regexp_matches(text, '(?i){_WORD}(?:och|eller|att|som|om|av|på|i|för|med)\s*$') AS clean FROM conversations""")
def clean_claims(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_claim(F.col("text")).alias("clean"))


@query(r"""SELECT conv_id, sha256(string_agg('[Källa ' || n || ': ' || role || ']' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY n)) AS premise_sha256
 FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id""")
def format_premise(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("citation"), "text"))).alias("sources"))
    return c.select("conv_id", F.sha2(T.premise(F.col("sources")), 256).alias("premise_sha256"))


@query(r"""SELECT conv_id, turn, CAST(v AS INTEGER) AS variant, md5('[Källa 1: ' || CASE v WHEN 0 THEN 'turn ' || turn WHEN 1 THEN role ELSE 'källa' END || ']' || chr(10) || trim(text)) AS premise_md5
 FROM conversations, (SELECT unnest([0, 1, 2]) AS v)""")
def header_variants(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    v = F.explode(T.header_variants(F.concat(F.lit("turn "), F.col("turn").cast("string")), F.col("role"), F.col("text")))
    return c.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", F.col("v.variant").alias("variant"), F.md5(F.col("v.premise").cast("binary")).alias("premise_md5"))


_NEG = ", ".join(f"'{w}'" for w in T.NEGATIONS)
_OPP = " OR ".join(f"(list_contains(x, '{p}') AND list_contains(y, '{q}')) OR (list_contains(x, '{q}') AND list_contains(y, '{p}'))" for p, q in T.OPPOSITES)


@query(rf"""SELECT conv_id, turn, coalesce(list_has_any([w FOR w IN x IF NOT list_contains(y, w)], [{_NEG}]) OR list_has_any([w FOR w IN y IF NOT list_contains(x, w)], [{_NEG}]) OR {_OPP}, false) AS flip
 FROM (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS x, regexp_extract_all(lower(b.text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS y
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""")
def polarity_flip(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.polarity_flip(F.col("text"), F.col("after")).alias("flip"))


@query()
def sentence_split_abbreviations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_sentences"), F.min(F.length("s")).alias("shortest"))
