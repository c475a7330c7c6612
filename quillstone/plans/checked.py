"""Queries whose answers SQL states from the tables alone, or that are written out."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillstone.functions import labels as L, tables as B, text as T, uri as U
from quillstone.operators import evaluation as E, families as M, lookup, resolving, structure as S
from quillstone.registry import ORACLE_SQL, QUERIES, query, table


def _s(column):
    return column.cast("string")


def _lines(spark, sf_dir):
    """One row for each order and line number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))


def golden(name: str, schema: str, cases: list[tuple], build) -> None:
    """Register a query of written-out cases: inputs and, last, the answer as text."""

    def run(spark, sf_dir):
        rows = spark.createDataFrame([(i, *c[:-1]) for i, c in enumerate(cases)], f"i int, {schema}")
        return rows.select("i", build().cast("string").alias("got"))

    QUERIES[name] = run
    quoted = ["CAST(NULL AS VARCHAR)" if c[-1] is None else "'" + c[-1].replace("'", "''") + "'" for c in cases]
    ORACLE_SQL[name] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q})" for i, q in enumerate(quoted)) + ") t(i, got)"


_c = F.col
golden("server_markdown", "t string", [("## Rubrik\n\n\n\n[a](b) **c** 3\\. *d* e_f\n> q", "Rubrik\n\na c 3. d e_f\nq")], lambda: T.plain_server_markdown(_c("t")))
golden("reference_only", "t string", [("Se även", "true"), ("Detta följer av", "true"), ("Se avtalet", "false")], lambda: T.citation_only(_c("t")))
golden("anaphora", "t string", [("Det gäller även köp", "true"), ("Det är möjligt att", "false"), ("Köp gäller", "false")], lambda: T.refers_back(_c("t")))
golden("sentences_written", "t string", [("Se 2 kap. Lagen gäller. Det gäller t.ex. Sverige. Nu!", "Se 2 kap. Lagen gäller.|Det gäller t.ex. Sverige.|Nu!")], lambda: F.array_join(T.sentences(_c("t")), "|"))
golden("expanded_citation", "t string, u string", [("41", "prop/2005/06:35#sid41", "prop. 2005/06:35 s. 41"), ("NJA 2013 s. 502 och", "x", "NJA 2013 s. 502"), ("Jfr,", "x", "Jfr")], lambda: U.expand_citation(_c("t"), _c("u")))
golden("canonical_uri", "t string", [("HTTPS://Ex.SE/Dom/A", "https://ex.se/Dom/A"), ("dom/A", "dom/A")], lambda: U.canonical(_c("t")))
golden("unit_citation", "c string, s string, u string", [
    ("NJA 2013 s. 502 f.", "prop/2008/09:232#sid26", "prop_page", "NJA 2013 s. 26"), ("bilaga", "prop/2008/09:232#sid26", "prop_page", "prop. 2008/09:232 s. 26"),
    ("NJA 2013 s. 502 p. 7", "dom/nja/2013s502#p8", "case_pinpoint", "NJA 2013 s. 502 p. 8"), ("rättsfallet", "dom/hfd/2013:71#p8", "case_pinpoint", "HFD 2013 ref. 71 p. 8"),
    ("C-434/16, Nowak, p. 34", "celex/62016CJ0434#p35", "cjeu_pinpoint", "C-434/16, Nowak, punkt 35"), ("2 kap. 1 § skadeståndslagen", "1972:207#K2P2", "statute_provision", "2 kap. 2 § skadeståndslagen"),
    ("1 §", "1915:218#P3S2", "statute_stycke", "3 § andra stycket (1915:218)"), ("annat", "coe/005#A6", "document_unit", "annat"),
], lambda: U.citation_for_unit(_c("c"), _c("s"), _c("u")))
golden("unit_plan", "u string, c string", [
    ("1915:218", "", "statute_act||unit_unbounded"), ("1998:808#K2", "", "statute_chapter||unit_unbounded"), ("1998:808#K2P3S1", "", "statute_stycke|K2P3S1|"), ("prop/2008/09:232", "s. 83 ff.", "prop_page|sid83,sid84,sid85|"),
    ("sou/2016:7", "", "sou_whole||unit_unbounded"), ("dom/nja/2013s502", "NJA 2013 s. 502 p. 7", "case_pinpoint|p7|"), ("dom/nja/2013s502", "NJA 2013 s. 502", "case_judgment||"), ("celex/62016CJ0434#p34", "", "cjeu_pinpoint|point-34|"), ("celex/32016R0679#6", "", "eu_article|6|"),
], lambda: F.concat_ws("|", U.unit_plan(_c("u"), _c("c"))["unit_type"], F.array_join(U.unit_plan(_c("u"), _c("c"))["fragments"], ","), F.coalesce(U.unit_plan(_c("u"), _c("c"))["reason"], F.lit(""))))
golden("pin_label", "t string", [("K2P3a", "2 kap. 3 a §"), ("P4", "4 §"), ("K2", "2 kap."), ("sid83", "s. 83"), ("recital-26", "skäl 26"), ("6.1", "art. 6.1"), ("x", "x")], lambda: L.pin_label(_c("t")))
golden("display_title", "t string", [("1915:218", "Avtalslagen"), ("2000:1", "Lag (2000:1)"), ("dom/nja/2013s502", "NJA 2013 s. 502"), ("dom/hfd/2013:71", "HFD 2013 ref. 71"), ("prop/2008/09:232", "Prop. 2008/09:232"), ("coe/005", "005")], lambda: L.display_title(_c("t"), F.create_map(F.lit("1915:218"), F.lit("avtalslagen"))))
golden("invalid_message", "t string", [("NJA 1990 s. 1", "Det finns inget rättsfall betecknat NJA 1990 s. 1."), ("99 § avtalslagen", "Det finns ingen 99 § i avtalslagen."), ("1915:9999", "Det finns ingen författning med beteckningen 1915:9999.")], lambda: L.invalid_message(_c("t"), F.lit("")))
golden("cannot_exist", "t string", [("dom/nja/1800s1", "true"), ("dom/nja/1990s1", "true"), ("dom/nja/1950s1", "false"), ("1500:1", "true"), ("1998:808", "false"), ("x", "false")], lambda: L.cannot_exist(_c("t")))
golden("date_number", "t string", [("2009-11-03", "true"), ("4578-13-40", "false"), ("x", "false")], lambda: L.is_date_number(_c("t")))
golden("party_fold", "t string", [("The Von-Hannover", "von hannover"), ("A & B", "a b")], lambda: L.folded_party(_c("t")))
golden("docket_form", "t string", [("t3-08", "T 3-08"), ("T 3-08", "T 3-08")], lambda: L.docket(_c("t")))
golden("session_year", "t string", [("1999/2000", "1999/2000"), ("2017/2018", "2017/18")], lambda: L.parliamentary_year(_c("t")))
golden("dissent_cut", "t string", [("A\n\nB\n\nJustitierådet X var skiljaktig\n\nC", "A\n\nB"), ("skiljaktig\n\nB", "skiljaktig\n\nB")], lambda: T.cut_dissent(_c("t")))
golden("verdict_text", "t string", [(" Unsupported: x", "unsupported"), ("supported.", "supported"), ("?", None)], lambda: B.first_start(_c("t"), ["un", "unsupported", "supported"]))
golden("framed_claim", "t string", [("x", "<x>")], lambda: B.framed(_c("t"), F.lit("k"), ["<{}>"]))
golden("pair_guard", "a int, b int", [(600, 10, "unit_too_long"), (512, 150, None)], lambda: B.pair_problem(_c("a"), _c("b")))
golden("inline_runs", "t string", [("a ", "a [b](u)")], lambda: B.inline_runs(F.array(F.struct(_c("t").alias("text"), F.lit(None).cast("string").alias("uri")), F.struct(F.lit("b").alias("text"), F.lit("u").alias("uri")))))
golden("rewrite_label", "k string, e string", [("paraphrase", "same", "supported"), ("contradiction", "opposite", "incorrect"), ("overstatement", "stronger", "misleading"), ("paraphrase", "opposite", None)], lambda: M.rewrite_label(_c("k"), _c("e")))
golden("teacher_decision", "l string, t string, p double", [("a", "b", 0.9, "reject"), ("a", "a", 0.9, "keep"), ("a", "b", 0.5, "keep")], lambda: M.teacher_decision(_c("l"), _c("t"), _c("p"), F.lit(None), F.lit(None))["decision"])
golden("eu_slices", "m string, f string", [
    ("### Artikel 7 – X\n\n1. a\n\n2. b\n\n### Artikel 8\n\nc", "7.2", "2. b"), ("### Artikel 7 – X\n\n1. a\n\n### Artikel 70\n\nc", "70", "### Artikel 70\n\nc"), ("### Artikel 7\n\nab", "7.4", "### Artikel 7\n\nab"),
    ("x\n(40) Skäl här.\ny", "recital-40", "(40) Skäl här."), ("97. a\n98. b\n", "point-98", "98. b"), ("a", "9", None),
], lambda: S.provision_slice(_c("m"), _c("f")))
golden("letter_shares", "t string", [("A", "0.731,0.269,0.000,0.000")], lambda: F.array_join(F.transform(E.letter_shares(F.array(F.struct(F.lit(" A").alias("token"), F.lit(-1.0).alias("logprob")), F.struct(F.lit("A").alias("token"), F.lit(-0.5).alias("logprob")), F.struct(F.lit("B").alias("token"), F.lit(-1.5).alias("logprob")), F.struct(F.lit("x").alias("token"), F.lit(0.0).alias("logprob")))), lambda w: F.format_string("%.3f", w)), ","))
golden("quote_match", "c string, p string", [("Han sade “detta är ett långt  citat här” då", "Att Detta är ett långt citat här.", "true"), ("Han sade “kort” då", "kort", "false"), ("“detta är ett annat citat som saknas”", "x", "false")], lambda: E.has_quote(_c("c"), _c("p")))
golden("law_names", "t string", [("Avtalslagens", "avtalslagen"), ("BrB", "brb")], lambda: E.law_name(_c("t")))
golden("law_numbers", "t string", [("1736:0123 s. 2", "1736:0123 2"), ("1915:218.2", "1915:218 2"), ("1915:218", "1915:218")], lambda: E.law_number(_c("t")))
golden("act_forms", "t string, a string, s string", [
    ("Lag (1915:218) om avtal.", None, "1915:218", "lagen (1915:218) om avtal"), ("Skadeståndslag (1972:207)", "SkL", "1972:207", "skadeståndslagen (1972:207)|skadeståndslagen|SkL"), ("Kungl. brev.", "två ord", "1:2", "Kungl. brev"),
], lambda: F.array_join(E.act_forms(_c("t"), _c("a"), _c("s")), "|"))
golden("query_forms", "t string", [("CELEX:32016R0679", "celex/32016R0679"), ("ETS 5", "coe/005"), ("ICRC 0115", "icrc/115"), ("UNTC iv-4", "untc/IV-4"), ("HUDOC 001-58257", "dom/echr/001-58257"), ("ICC-01/04-02/06-2", "icc/ICC-01_04-02_06-2"), ("ICJ 116_20051219_jud_01_00_EN.pdf", "icj/116-20051219-JUD-01-00")], lambda: F.coalesce(*[F.when(_c("t").rlike(p), f(F.regexp_extract("t", p, 1))) for p, f in resolving.IDENTIFIERS]))
golden("roman_numbers", "t string", [("XIV", "14"), ("xc", "90"), ("7", "7"), ("q", None)], lambda: L.arabic(_c("t")))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey || ' kap. ' || l_linenumber || ' §' AS label, CAST(l_suppkey AS VARCHAR) AS chapter, CAST(l_linenumber AS VARCHAR) AS section, CASE WHEN l_linenumber > 3 THEN '2' END AS piece FROM lineitem""")
def fragment_parts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    plain = F.concat(F.lit("K"), _s(F.col("l_suppkey")), F.lit("P"), _s(F.col("l_linenumber")))
    p = U.fragment_parts(F.concat(plain, F.when(F.col("l_linenumber") > 3, "S2").otherwise("")))
    return l.select("l_orderkey", "l_linenumber", L.pin_label(plain).alias("label"), p["chapter"].alias("chapter"), p["section"].alias("section"), p["piece"].alias("piece"))


@query("""SELECT o_orderkey, 'celex/6' || (CASE WHEN o_orderkey % 100 >= 54 THEN 1900 ELSE 2000 END + o_orderkey % 100) || 'CJ' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 4, '0') AS uri,
 'C-' || (o_custkey % 1000) || '/' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS number, 'dom/hovratt/' || (1990 + o_orderkey % 30) || ':' || o_custkey AS national FROM orders""")
def case_uris(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    year, number = F.lpad(_s(F.col("o_orderkey") % 100), 2, "0"), _s(F.col("o_custkey") % 1000)
    uri = U.celex_case(F.lit("C"), number, year)
    national = U.case_law(F.lit("Hovrätt"), _s(F.col("o_orderkey") % 30 + 1990), F.concat(F.lit(":"), _s(F.col("o_custkey"))))
    return o.select("o_orderkey", uri.alias("uri"), U.celex_case_number(F.substring_index(uri, "/", -1)).alias("number"), national.alias("national"))


_LAWS = "CASE o_orderkey % 3 WHEN 0 THEN '1962:700' WHEN 1 THEN '1915:218' ELSE '1998:808' END"


@query(f"""SELECT query, ord, uri, source FROM (
 SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'BrB' WHEN 1 THEN 'avtalslagen' ELSE 'miljöbalken' END || ' ' || (o_custkey % 40 + 1) || ':' || (o_orderkey % 60 + 1) AS query, 1 AS ord, {_LAWS} || '#K' || (o_custkey % 40 + 1) || 'P' || (o_orderkey % 60 + 1) AS uri, 'statute' AS source FROM orders
 UNION SELECT DISTINCT 'GDPR art ' || (o_orderkey % 99 + 1) || '.' || (o_custkey % 9 + 1), 1, 'celex/32016R0679#' || (o_orderkey % 99 + 1) || '.' || (o_custkey % 9 + 1), 'eu' FROM orders
 UNION SELECT DISTINCT 'mål C-' || (o_custkey % 900 + 1) || '/' || lpad(CAST(o_orderkey % 20 AS VARCHAR), 2, '0'), 1, 'celex/62' || lpad(CAST(o_orderkey % 20 AS VARCHAR), 3, '0') || 'CJ' || lpad(CAST(o_custkey % 900 + 1 AS VARCHAR), 4, '0'), 'eu_case' FROM orders
 UNION SELECT DISTINCT 'NJA ' || (1990 + o_orderkey % 30) || ' s. ' || (o_custkey % 900 + 1), 1, 'dom/nja/' || (1990 + o_orderkey % 30) || 's' || (o_custkey % 900 + 1), 'case' FROM orders)""")
def resolve_query(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.element_at(F.array(F.lit("BrB"), F.lit("avtalslagen"), F.lit("miljöbalken")), (k % 3 + 1).cast("int"))
    asked = F.array(
        F.concat(name, F.lit(" "), _s(c % 40 + 1), F.lit(":"), _s(k % 60 + 1)),
        F.concat(F.lit("GDPR art "), _s(k % 99 + 1), F.lit("."), _s(c % 9 + 1)),
        F.concat(F.lit("mål C-"), _s(c % 900 + 1), F.lit("/"), F.lpad(_s(k % 20), 2, "0")),
        F.concat(F.lit("NJA "), _s(k % 30 + 1990), F.lit(" s. "), _s(c % 900 + 1)),
    )
    return resolving.resolve(o.select(F.explode(asked).alias("query")))


@query("""SELECT l_orderkey AS doc_id, l_suppkey AS chapter, l_linenumber AS section, '**' || l_linenumber || ' §** Om del ' || l_partkey || '.' AS slice FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_suppkey) = 1""")
def provision_slice(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    block = F.concat(F.lit("## [x](#K"), _s(F.col("l_suppkey")), F.lit(")\n\n### u\n\n**"), _s(F.col("l_linenumber")), F.lit(" §** Om del "), _s(F.col("l_partkey")), F.lit(".\n\n### Slut\n\nx\n\n"))
    docs = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", block.alias("b")))), lambda x: x["b"]), "").alias("md"))
    once = l.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("section")).where("n = 1")
    fragment = F.concat(F.lit("K"), _s(F.col("l_suppkey")), F.lit("P"), _s(F.col("section")))
    return once.join(docs, "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("chapter"), "section", S.provision_slice(F.col("md"), fragment).alias("slice"))


@query("""WITH o AS (SELECT o_orderkey AS doc_id FROM orders)
 SELECT doc_id, r.* FROM o, (VALUES (1, 'NJA', 'högsta domstolen', 'summary'), (2, 'NJA', 'högsta domstolen', 'reported'), (5, 'Bakgrund', 'högsta domstolen', 'reported'), (7, 'Domskäl', 'högsta domstolen', 'reported'), (9, 'Domskäl', 'högsta domstolen', 'reasoning'), (10, 'Domskäl', 'högsta domstolen', 'reported'), (12, 'Domslut', 'högsta domstolen', 'decision'), (13, 'Domslut', 'högsta domstolen', 'metadata')) r(n, section, court, role)""")
def judgment_paragraphs(spark, sf_dir):
    number = _s(F.col("o_orderkey"))
    text = F.concat(F.lit("# NJA\n\nReferat "), number, F.lit(".\n\nMer.\n\n## Högsta domstolen\n\n### Bakgrund\n\nA.\n\n#### Domskäl\n\nB.\n\n### Domskäl\n\nSkäl.\n\n12. Åklagaren i mål "), number, F.lit(" anförde att x.\n\n### Domslut\n\nAvslag.\n\nLagrum: 1 §"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return S.judgment_paragraphs(docs, F.lit(S.REPORTING["nja"])).select("doc_id", "n", "section", "court", "role")


@query("""SELECT l_orderkey AS page, t AS text, length(regexp_replace(t, '\\s', '', 'g')) < 40 AS low_text FROM
 (SELECT l_orderkey, replace(string_agg('del ' || p || ' av ' || s, '@' ORDER BY l_linenumber), '@', CASE WHEN l_orderkey % 2 = 0 OR count(*) >= 4 THEN ' ' ELSE chr(10) || chr(10) END) AS t FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey)""")
def pdf_lines(spark, sf_dir):
    l = _lines(spark, sf_dir)
    l = l.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    y, seq = F.lit(1000.0) - F.col("l_linenumber") * F.when(F.col("l_orderkey") % 2 == 0, 12.0).otherwise(30.0), F.col("l_linenumber") * 2
    glyphs = F.array(F.struct(seq.alias("seq"), F.concat(F.lit("av  "), _s(F.col("l_suppkey"))).alias("str"), F.lit(50.0).alias("x"), (y + 1).alias("y")), F.struct((seq + 1).alias("seq"), F.concat(F.lit("del "), _s(F.col("l_partkey"))).alias("str"), F.lit(0.0).alias("x"), y.alias("y")))
    items = l.select(F.col("l_orderkey").alias("page"), F.explode(glyphs).alias("g")).select("page", "g.*", F.lit(10.0).alias("height"))
    return S.page_blocks(items)


@query("""SELECT l_orderkey, l_linenumber, substr('abcdefghijklmnopqrstuvwxyz', l_linenumber + 1, CAST(l_suppkey % 9 AS INTEGER)) AS part FROM lineitem""")
def anchor_slice(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber").cast("int")
    anchors = F.create_map(F.lit("x"), F.struct(start.alias("start"), (start + (F.col("l_suppkey") % 9).cast("int")).alias("end")))
    return l.select("l_orderkey", "l_linenumber", S.anchor_slice(F.lit("abcdefghijklmnopqrstuvwxyz"), anchors, F.lit("x")).alias("part"))


_STATUS = "CASE event_id % 6 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'abstain' WHEN 3 THEN 'missing' WHEN 4 THEN 'supported' ELSE 'pending' END"
_GOLD = "CASE event_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'misleading' ELSE NULL END"


def _judged(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("event_id") % n + 1).cast("int"))
    return e.select("event_id", pick(6, "correct", "incorrect", "abstain", "missing", "supported", "pending").alias("semantic"), pick(4, "supported", "incorrect", "misleading", None).alias("expected"), pick(5, "invalid", "found", "found", "unconfirmed", "found").alias("status"))


@query(f"""SELECT {_GOLD} AS expected, count(*) AS n, count(*) FILTER (CASE {_GOLD} WHEN 'supported' THEN {_STATUS} IN ('contradiction', 'incorrect', 'misleading', 'missing') WHEN 'incorrect' THEN {_STATUS} IN ('supported', 'correct') WHEN 'misleading' THEN {_STATUS} IN ('supported', 'correct') ELSE FALSE END) AS wrong FROM events GROUP BY 1""")
def wrong_direction(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("expected").agg(F.count("*").alias("n"), F.count_if(E.wrong_direction(F.col("expected"), F.col("semantic"))).alias("wrong"))


@query(f"""SELECT count(*) AS total, count(*) FILTER ({_STATUS} IN ('incorrect', 'missing')) AS review, count(*) FILTER ({_STATUS} IN ('abstain', 'pending')) AS unassessed, count(*) FILTER (event_id % 5 = 0) AS invalid FROM events""")
def report_counters(spark, sf_dir):
    return E.report_counters(_judged(spark, sf_dir))


@query(f"""SELECT event_id FROM events WHERE {_STATUS} IN ('incorrect', 'missing')""")
def report_filter(spark, sf_dir):
    return _judged(spark, sf_dir).where(E.matches_filter(F.lit("review"), F.col("status"), F.col("semantic"))).select("event_id")


@query(f"""WITH r AS (SELECT {_GOLD} AS expected, CASE event_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'incorrect' END AS predicted, CASE WHEN event_id % 7 < 2 THEN 'abstain' ELSE 'x' END AS label FROM events)
 SELECT *, (accepted - wrong_accepted) / accepted AS precision FROM (SELECT count(*) AS examples, count(*) FILTER (expected IS NOT NULL AND predicted IS NOT NULL) AS assessed, count(*) FILTER (expected = predicted) AS argmax_correct, count(*) FILTER (expected IS NOT NULL AND predicted IS NOT NULL AND label <> 'abstain') AS accepted, count(*) FILTER (expected <> predicted AND label <> 'abstain') AS wrong_accepted FROM r)""")
def run_summary(spark, sf_dir):
    rows = _judged(spark, sf_dir).select("expected", F.when(F.col("event_id") % 3 == 0, "supported").when(F.col("event_id") % 3 == 1, "incorrect").alias("predicted"), F.when(F.col("event_id") % 7 < 2, "abstain").otherwise("x").alias("label"))
    return E.run_summary(rows)


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'unassessable' WHEN o_custkey % 600 > 512 OR o_orderkey % 200 > 150 THEN 'unit_too_long' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def skip_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    claim = F.when(F.col("o_orderkey") % 4 == 0, "Två ord").otherwise("Avtalet är bindande för parterna")
    return o.groupBy(E.skip_reason(claim, F.col("o_custkey") % 600, F.col("o_orderkey") % 200).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(DISTINCT l_partkey) AS targets, count(DISTINCT l_linenumber) AS claims FROM lineitem GROUP BY 1")
def document_counts(spark, sf_dir):
    return E.document_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, s_name AS found FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def shared_resolution(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("found"))
    return E.shared(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", lambda keys: keys.join(s, "l_suppkey"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS status FROM lineitem GROUP BY 1")
def agreed_metadata(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(E.agreed("l_returnflag").alias("flag"), E.agreed("l_linestatus").alias("status"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pin' || o_orderkey ELSE 'hd · ' || o_orderstatus || ' · hd · skäl' END AS citation FROM orders""")
def row_citation(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = lambda court, section: F.struct(F.lit(court).alias("court"), section.alias("section"))
    passages = F.array(p("hd", F.col("o_orderstatus")), p("hd", F.lit("skäl")), p("hd", F.col("o_orderstatus")), p("", F.lit("")))
    return o.select("o_orderkey", E.row_citation(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("pin"), _s(F.col("o_orderkey")))), passages).alias("citation"))


@query("""SELECT l_orderkey AS id, CASE WHEN bool_or(l_linenumber = 1 AND l_suppkey % 5 = 0) THEN '' ELSE string_agg('t' || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber) FILTER (l_suppkey % 5 <> 0) END AS text, CASE WHEN bool_or(l_linenumber = 1 AND l_suppkey % 5 = 0) THEN 'pinpoint_not_found' END AS reason FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1""")
def joined_units(spark, sf_dir):
    l = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("id"), "l_linenumber", _s(F.col("l_linenumber")).alias("fragment"), F.concat(F.lit("t"), _s(F.col("l_partkey"))).alias("text"), "l_suppkey")
    wanted = l.groupBy("id").agg(F.sort_array(F.collect_list("fragment")).alias("fragments")).where("array_contains(fragments, '1')")
    return E.joined_units(wanted, l.where("l_suppkey % 5 <> 0"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_partkey % 2 = 0 THEN '1:1#P1' WHEN l_suppkey % 2 = 0 THEN 'dom/x' END AS kept FROM lineitem WHERE l_linenumber % 3 = 0 OR l_partkey % 2 = 0 OR l_suppkey % 2 = 0""")
def target_filter(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    t = lambda uri, kind: F.array(F.struct(F.lit(uri).alias("uri"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<uri:string,kind:string>>")
    targets = F.when(F.col("l_linenumber") % 3 == 0, none).when(F.col("l_partkey") % 2 == 0, F.concat(t("1:1#P1", "provision"), t("1:1", "provision"))).when(F.col("l_suppkey") % 2 == 0, t("dom/x", "judgment")).otherwise(t("prop/1", "preparatory"))
    kept = E.kept_targets(targets, ["provision", "judgment"], ["judgment"])
    return l.select("l_orderkey", "l_linenumber", kept.alias("k")).where("k is not null").select("l_orderkey", "l_linenumber", F.array_join(F.transform("k", lambda x: x["uri"]), ",").alias("kept"))


@query("""SELECT o_orderkey, o_orderstatus AS label, CASE o_orderstatus WHEN 'F' THEN 'contradiction' WHEN 'O' THEN 'entailment' END AS three, i AS copy FROM orders, range(1, 21) r(i) WHERE o_custkey % 10 = 0 OR i = 1""")
def label_replicas(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    four = F.when(F.col("o_orderstatus") == "F", "incorrect").when(F.col("o_orderstatus") == "O", "supported")
    rows = o.select("o_orderkey", F.col("o_orderstatus").alias("label"), E.three_way(four).alias("three"), "o_custkey")
    return E.replicated(rows, F.col("o_custkey") % 10 == 0).select("o_orderkey", "label", "three", F.col("copy").cast("long").alias("copy"))


@query("""WITH p AS (SELECT source AS act, 'd' || doc_id AS uri, text FROM documents WHERE n_chars BETWEEN 150 AND 1200 AND source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 97 = 5))
 SELECT act, uri FROM p WHERE act IN (SELECT act FROM p GROUP BY 1 HAVING count(*) >= 3)""")
def usable_provisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("act"), F.concat(F.lit("d"), _s(F.col("doc_id"))).alias("uri"), "text", "doc_id")
    return E.usable_provisions(d, d.where("doc_id % 97 = 5").select("act").distinct()).select("act", "uri")


@query("""WITH n AS (SELECT DISTINCT 'förordning' || l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN 'en' ELSE '' END AS name, CAST(l_suppkey AS VARCHAR) AS target FROM lineitem)
 SELECT name, target FROM n UNION ALL SELECT substr(name, 1, length(name) - 2), target FROM n WHERE name LIKE '%en'""")
def indefinite_names(spark, sf_dir):
    s = F.col("l_suppkey")
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("förordning"), _s(s), F.when(s % 2 == 0, "en").otherwise("")).alias("name"), _s(s).alias("target")).distinct()
    return E.with_indefinite(names, {"en": ""})


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'cite' ELSE 'claim' END AS kind, l_partkey % 50 AS a, l_partkey % 50 + l_suppkey % 20 + 1 AS z FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2)),
 e AS (SELECT DISTINCT doc, x FROM (SELECT doc, a AS x FROM s UNION ALL SELECT doc, z FROM s)), g AS (SELECT doc, x AS start, lead(x) OVER (PARTITION BY doc ORDER BY x) AS "end" FROM e)
 SELECT g.doc, g.start, g."end", coalesce(string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY s.id) FILTER (kind = 'claim'), '') AS claims, coalesce(string_agg(CAST(s.id AS VARCHAR), ',' ORDER BY s.id) FILTER (kind = 'cite'), '') AS cites FROM g JOIN s ON g.doc = s.doc AND s.a < g."end" AND s.z > g.start GROUP BY ALL""")
def claim_segments(spark, sf_dir):
    l = _lines(spark, sf_dir)
    a = F.col("l_partkey") % 50
    spans = l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "cite").otherwise("claim").alias("kind"), a.alias("start"), (a + F.col("l_suppkey") % 20 + 1).alias("end"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return E.claim_segments(spans, ["doc"]).select("doc", "start", "end", listed("claims"), listed("cites"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'a' || o_orderkey ELSE 'b,c' END AS sources FROM orders")
def coerced_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    new = F.when(F.col("o_custkey") % 2 == 1, F.array(F.lit("b"), F.lit("c")))
    return o.select("o_orderkey", F.array_join(E.coerced_sources(F.concat(F.lit("a"), _s(F.col("o_orderkey"))), new), ",").alias("sources"))


@query("SELECT o_orderkey, substr(sha256('u/' || o_orderkey), 1, 16) AS key, substr(sha256('u/' || o_orderkey), 1, 4) AS bucket FROM orders")
def prefix_keys(spark, sf_dir):
    key = lookup.prefix_key(F.concat(F.lit("u/"), _s(F.col("o_orderkey"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), F.substring(key, 1, 4).alias("bucket"))
