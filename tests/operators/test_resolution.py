import json

from pyspark.sql import functions as F

from quillstone.functions import labels as L
from quillstone.operators import resolution as R, structure as X


def each(spark, f, cases):
    frame = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    assert {r.t: r.x for r in frame.select("t", f(F.col("t")).alias("x")).collect()} == dict(cases)


def test_labels(spark):
    each(spark, L.pin_label, [("K2P3a", "2 kap. 3 a §"), ("P4", "4 §"), ("K2", "2 kap."), ("sid83", "s. 83"), ("recital-26", "skäl 26"), ("6.1", "art. 6.1"), ("x", "x")])
    names = F.create_map(F.lit("1915:218"), F.lit("avtalslagen"))
    each(spark, lambda c: L.display_title(c, names), [("1915:218", "Avtalslagen"), ("2000:1", "Lag (2000:1)"), ("dom/nja/2013s502", "NJA 2013 s. 502"), ("dom/hfd/2013:71", "HFD 2013 ref. 71"), ("prop/2008/09:232", "Prop. 2008/09:232"), ("coe/005", "005")])
    each(spark, lambda c: L.invalid_message(c, F.lit("")), [("NJA 1990 s. 1", "Det finns inget rättsfall betecknat NJA 1990 s. 1."), ("99 § avtalslagen", "Det finns ingen 99 § i avtalslagen."), ("1915:9999", "Det finns ingen författning med beteckningen 1915:9999."), ("hittepålagen", "Det finns ingen lag som heter hittepålagen.")])
    each(spark, L.cannot_exist, [("dom/nja/1800s1", True), ("dom/nja/1990s1", True), ("dom/nja/1950s1", False), ("1500:1", True), ("1998:808", False), ("x", False)])
    each(spark, L.is_date_number, [("2009-11-03", True), ("4578-13-40", False), ("x", False)])
    each(spark, L.folded_party, [("The Von-Hannover", "von hannover"), ("A & B", "a b")])
    each(spark, L.docket, [("t3-08", "T 3-08"), ("T 3-08", "T 3-08")])
    each(spark, L.parliamentary_year, [("1999/2000", "1999/2000"), ("2017/2018", "2017/18")])
    each(spark, L.pin_query, [("12:1", "12 kap. 1 §"), ("x", "x")])
    each(spark, L.page_query, [("NJA 2013 s. 502", "dom/nja/2013s502"), ("prop. 2008/09:232", "prop/2008/09:232"), ("x", None)])
    each(spark, L.arabic, [("XIV", 14), ("xc", 90), ("7", 7), ("q", None)])


def test_judgments(spark):
    def node(kind, text="", *children):
        return {"type": kind, "text": text, "children": list(children)}

    tree = [
        node("instans", "", node("dom", "Hovrätten", node("domskal", "Fel"))),
        node("instans", "", node("betankande", "", node("dom", "", node("domskal", "Förslag"))), node("dom", "", node("domskal", "HD fann.\n\nmer\n\nJR X var skiljaktig"), node("domslut", "Avslag."))),
    ]
    nodes = X.flatten_tree(spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps([node("p", "x")]))], "doc_id long, tree string"))
    got = {r.doc_id: (r.text, r.reason) for r in R.judgments(nodes).collect()}
    assert got == {1: ("HD fann.\n\nmer", None), 2: ("", "empty_unit")}
    eu = [node("heading", "Bakgrund", node("p", "a")), node("heading", "Prövning av tolkningsfrågan", node("p", "b")), node("heading", "Rättegångskostnader", node("p", "c"))]
    nodes = X.flatten_tree(spark.createDataFrame([(1, json.dumps(eu))], "doc_id long, tree string"))
    assert R.assessments(nodes).first().text == "Prövning av tolkningsfrågan\n\nb"


def test_snapshots(spark):
    texts = ["Högsta domstolens dom 2009-11-03 T 3-08", "HD:s dom i mål T 3-08", "Södertörns tingsrätt mål nr T 3-08", "i HD, sedan tingsrättens mål T 3-08", "avgörandet, ansökan nr 23452/94, i samma mål", "se Osman mot Förenade kungariket, p. 115", "kampen mot Sverige"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    snapshot = spark.createDataFrame([("T 3-08", "nja", "2009-11-03", "dom/nja/2009s672"), ("T 3-08", "hfd", "2001-01-01", "dom/hfd/2001:1")], "number string, court string, decided string, uri string")
    assert sorted((r.doc_id, texts[r.doc_id][r.start : r.end], r.uri) for r in R.dockets(docs, snapshot).collect()) == [(0, "T 3-08", "dom/nja/2009s672"), (1, "T 3-08", "dom/nja/2009s672")]
    cases = spark.createDataFrame([("23452/94", "Osman", "Förenade kungariket", "dom/echr/001-58257")], "appno string, applicant string, respondent string, uri string")
    assert [(r.doc_id, r.uri) for r in R.applications(docs, cases).collect()] == [(4, "dom/echr/001-58257")]
    assert [(r.doc_id, texts[r.doc_id][r.start : r.end]) for r in R.party_names(docs, cases).collect()] == [(5, "Osman mot Förenade kungariket")]
