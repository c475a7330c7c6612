"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.quality import quality

    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.language import language_id

    return language_id(_documents(spark, sf_dir))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.spotsigs import fingerprint_edits

    return fingerprint_edits(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.chat import format_log, log_of_rows, read_back

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    read = read_back(format_log(log_of_rows(rows)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillstone.llm.packing import pack

    return pack(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.substrings import removals

    return removals(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillstone.llm.bpe import encode

    return encode(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.katz import score

    return score(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.neighbours import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES = {"op4_simhash": op4_simhash, "op5_packing": op5_packing, "op9_substrings": op9_substrings, "op10_bpe": op10_bpe, "op1_quality": op1_quality, "op8_language": op8_language, "op2_spotsigs": op2_spotsigs, "op3_chat": op3_chat, "op7_neighbours": op7_neighbours, "op6_katz": op6_katz}
_CHAT = r"""([<\[])(\\*)(\|[A-Za-z0-9_ /:.-]{0,60}\|>|/?(?:s|bos|eos|pad|unk|mask|start_of_turn|end_of_turn)>|</?SYS>>|/?INST\])"""

#: The other operators hash, train or tokenise in ways that SQL has no words for; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_chat": rf"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
 sum(23 + length(regexp_replace(role, '{_CHAT}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '{_CHAT}', '\1\\\2\3', 'g'))) AS n FROM r GROUP BY conv_id)
 SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g""",
    "op9_substrings": r"""WITH w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents)),
 a AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
 again AS (SELECT s FROM a WHERE n = 35 GROUP BY s HAVING count(*) > 1), h AS (SELECT a.doc_id, a.i, a.word, CASE WHEN again.s IS NULL THEN 0 ELSE 1 END AS hit FROM a LEFT JOIN again ON a.s = again.s AND a.n = 35),
 c AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h),
 g AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)""",
}
