import pytest
from pyspark.sql import functions as F

from quillstone.functions import numbers as N, text as T, uri as U


def value(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column.alias("x")).first().x


def texts(spark, f, cases):
    rows = spark.createDataFrame([(a,) for a, _ in cases], "t string").select("t", f(F.col("t")).alias("x")).collect()
    got = {r.t: r.x for r in rows}
    for given, want in cases:
        assert got[given] == want, given


def test_tokens(spark):
    texts(spark, T.tokens, [("Ett skadeståndsansvar enligt 2 kap. 1 § SkL!", ["ett", "skadeståndsansvar", "enligt", "2", "kap", "1", "skl"]), ("6a_b", ["6", "a", "b"]), ("", [])])
    texts(spark, lambda c: T.tokens(c, "word"), [("Åtta öl 6a_b", ["åtta", "öl", "6a_b"])])


def test_whitespace(spark):
    texts(spark, T.whitespace, [("a\r\nb", "a b"), ("a\n\n b", "a\n\nb"), ("a \r\n \r\n b  c", "a\n\nb c"), ("a\r\rb", "a\n\nb"), ("x", "x")])


def test_markdown(spark):
    texts(spark, T.plain_markdown, [("![i](u)[länk](v) **fet** <b>x</b>", "länk fet x")])
    texts(spark, T.plain_server_markdown, [("## Rubrik\n\n\n\n[a](b) **c** 3\\. *d* e_f\n> q", "Rubrik\n\na c 3. d e_f\nq")])


def test_sentences(spark):
    texts(spark, T.sentences, [("Se 2 kap. Lagen gäller. Det gäller t.ex. Sverige. Nu!", ["Se 2 kap. Lagen gäller.", "Det gäller t.ex. Sverige.", "Nu!"])])
    texts(spark, T.sentences_simple, [("A. b! C?", ["A.", "b!", "C?"])])


def test_claims(spark):
    texts(spark, lambda c: T.assessable(c)["reason"], [
        ("  ", "empty"), ("Ett <b>fel</b> är här nu", "unreadable"), ("Två ord", "no_statement"), ("Avtalet är bindande för parterna", None),
        ("Hovrätten är ett mord i dag", "category_error"), ("ordlista utan verb alls", "no_statement"),
    ])
    good = "Domstolen fann att avtalet var bindande för båda parter."
    texts(spark, T.clean_claim, [(good, True), ("kort", False), (good.lower(), False), (good + " (se prop.)", False), ("Domstolen fann att avtalet var bindande för", False)])


def test_polarity_and_reference(spark):
    flip = lambda a, b: value(spark, T.polarity_flip(F.col("a"), F.col("b")), a=a, b=b)
    assert flip("avtalet gäller", "avtalet gäller inte") and flip("högre ränta", "lägre ränta") and not flip("a b", "a c")
    texts(spark, T.citation_only, [("Se även", True), ("Detta följer av", True), ("Se avtalet", False)])
    texts(spark, T.refers_back, [("Det gäller även köp", True), ("Det är möjligt att", False), ("Köp gäller", False)])


def test_ranges_and_premise(spark):
    texts(spark, T.paragraph_range, [("punkterna 7–9", [7, 8, 9]), ("p. 7 och 9", [7, 9]), ("p. 42, 45", [42, 45]), ("p7-9", [7, 8, 9]), ("p. 1–90", [1, 90])])
    texts(spark, T.cut_dissent, [("A\n\nB\n\nJustitierådet X var skiljaktig\n\nC", "A\n\nB"), ("skiljaktig\n\nB", "skiljaktig\n\nB")])
    src = F.array(F.struct(F.lit("NJA").alias("citation"), F.lit(" t ").alias("text")), F.struct(F.lit("HFD").alias("citation"), F.lit("u").alias("text")))
    assert value(spark, T.premise(src)) == "[Källa 1: NJA]\nt\n\n[Källa 2: HFD]\nu"


def test_numbers(spark):
    p = value(spark, N.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(3.0)), 2.0))
    assert sum(p) == pytest.approx(1) and p[2] == pytest.approx(2.718281828 / 4.718281828)
    assert value(spark, N.softmax(F.array(F.lit(1.0), F.lit(float("nan"))))) is None
    assert value(spark, N.argmax(F.array(*map(F.lit, (0.4, 0.4, 0.2))))) == 0
    assert value(spark, N.wilson_lower_bound(F.lit(30), F.lit(30))) == pytest.approx(0.8865, abs=1e-3) and value(spark, N.wilson_lower_bound(F.lit(0), F.lit(0))) == 0


def test_identifiers(spark):
    rows = [
        ("NJA 2013 s. 502 f.", "prop/2008/09:232#sid26", "prop_page", "NJA 2013 s. 26"),
        ("bilaga", "prop/2008/09:232#sid26", "prop_page", "prop. 2008/09:232 s. 26"),
        ("prop. 2008/09:232 s. 25 f.", "prop/2008/09:232#sid26", "prop_page", "prop. 2008/09:232 s. 26"),
        ("NJA 2013 s. 502 p. 7", "dom/nja/2013s502#p8", "case_pinpoint", "NJA 2013 s. 502 p. 8"),
        ("rättsfallet", "dom/hfd/2013:71#p8", "case_pinpoint", "HFD 2013 ref. 71 p. 8"),
        ("C-434/16, Nowak, p. 34", "celex/62016CJ0434#p35", "cjeu_pinpoint", "C-434/16, Nowak, punkt 35"),
        ("2 kap. 1 § skadeståndslagen", "1972:207#K2P2", "statute_provision", "2 kap. 2 § skadeståndslagen"),
        ("1 §", "1915:218#P3S2", "statute_stycke", "3 § andra stycket (1915:218)"),
        ("annat", "coe/005#A6", "document_unit", "annat"),
    ]
    frame = spark.createDataFrame(rows, "c string, s string, u string, want string")
    for r in frame.select("want", U.citation_for_unit(F.col("c"), F.col("s"), F.col("u")).alias("got")).collect():
        assert r.got == r.want
    plans = [("1915:218", "", "statute_act", [], "unit_unbounded"), ("1998:808#K2", "", "statute_chapter", [], "unit_unbounded"), ("1998:808#K2P3S1", "", "statute_stycke", ["K2P3S1"], None), ("prop/2008/09:232", "s. 83 ff.", "prop_page", ["sid83", "sid84", "sid85"], None), ("sou/2016:7", "", "sou_whole", [], "unit_unbounded"), ("dom/nja/2013s502", "p. 7–9", "case_pinpoint", ["p7", "p8", "p9"], None), ("celex/62016CJ0434#point-34", "", "cjeu_pinpoint", ["point-34"], None), ("celex/32016R0679#6.1", "", "eu_article", ["6.1"], None)]
    frame = spark.createDataFrame([p[:2] for p in plans], "u string, c string").select("u", U.unit_plan(F.col("u"), F.col("c")).alias("p"))
    got = {r.u: (r.p.unit_type, r.p.fragments, r.p.reason) for r in frame.collect()}
    assert got == {p[0]: p[2:] for p in plans}
    texts(spark, lambda c: U.expand_citation(c, F.lit("prop/2005/06:35#sid41")), [("41", "prop. 2005/06:35 s. 41"), ("NJA 2013 s. 502 och", "NJA 2013 s. 502"), ("41 f.", "prop. 2005/06:35 s. 41 f")])
    texts(spark, lambda c: U.swedish_date(c).cast("string"), [("den 28 oktober 1998", "1998-10-28"), ("2009-11-03", "2009-11-03"), ("31 februari 2001", None), ("x", None)])
    texts(spark, U.canonical, [("HTTPS://Ex.SE/Dom/A", "https://ex.se/Dom/A"), ("dom/A", "dom/A")])
