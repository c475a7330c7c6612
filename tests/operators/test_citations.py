import os
import random

import pytest

from quillstone.operators.citations import Scanner, State, block_occurrences, extract
from quillstone.plans import documents

STATUTES = [
    ("1§ avtalslagen", ["1915:218#P1"]),
    ("12 kap. 1§ avtalslagen", ["1915:218#K12P1"]),
    ("1 a§ avtalslagen", ["1915:218#P1a"]),
    ("1–3§§ avtalslagen", ["1915:218#P1", "1915:218#P3", "1915:218"]),
    ("1 och 3§§ avtalslagen", ["1915:218#P1", "1915:218#P3", "1915:218"]),
    ("1 a–3 b§§ avtalslagen", ["1915:218#P1a", "1915:218#P3b", "1915:218"]),
    ("3§ BrB", ["1962:700#P3"]),
    ("BrB 3§", ["1962:700#P3"]),
    ("BrB 3 a§", ["1962:700#P3a"]),
    ("1–3§§ BrB", ["1962:700#P1", "1962:700#P3"]),
    ("1§ första stycket avtalslagen", ["1915:218#P1S1"]),
]


@pytest.mark.parametrize("space", ["", " ", "\u00a0", "\u202f"])
@pytest.mark.parametrize("text,uris", STATUTES)
def test_statutes(text, uris, space):
    text = text.replace("§", space + "§", 1)
    refs = Scanner().parse(text)
    assert [r.uri for r in refs] == uris


OTHERS = [
    ("i rättsfallet NJA 1991 s.\u202f567 uttalat, jfr NJA\u00a02012 s.\u202f725.", ["dom/nja/1991s567", "dom/nja/2012s725"]),
    ("se SÖ 1982:50 och SÖ 1959:65", ["so/1982:50", "so/1959:65"]),
    ("(SOU 2016:7 s.184 f.) och prop. 2017/18:105 s. 40 ff. och 52", ["sou/2016:7#sid184", "sou/2016:7#sid185", "prop/2017/18:105#sid40", "prop/2017/18:105#sid41", "prop/2017/18:105#sid42", "prop/2017/18:105#sid52"]),
    ("(Ds. 1998:14 s. 19 f.)", ["ds/1998:14#sid19", "ds/1998:14#sid20"]),
    ("som avses i 1 kap. 18 § lagen (2016:1145) om offentlig upphandling,", ["2016:1145#K1P18"]),
    ("In Case C-176/09 the court", ["celex/62009CJ0176"]),
    ("By order in Case F-23/07", ["celex/62007FJ0023"]),
    ("i mål T-201/04", ["celex/62004TJ0201"]),
    ("Case C\u2011197/09", ["celex/62009CJ0197"]),
    ("in Case 31/87, REFERENCE to the Court", ["celex/61987CJ0031"]),
    ("delivered on 31/87 items", []),
    ("Council Directive 71/305/EEC of 26 July 1971", ["celex/31971L0305"]),
    ("Article 29 (5) of Directive 71/305/EEC provides", ["celex/31971L0305#29.5"]),
    ("Regulation (EEC) No 2092/91 applies.", ["celex/31991R2092"]),
    ("Commission Recommendation 2003/361/EC", ["celex/32003H0361"]),
    ("Europaparlamentets och rådets direktiv (EU) 2016/1148", ["celex/32016L1148"]),
    ("rådets direktiv 85/337/EEG", ["celex/31985L0337"]),
    ("rådets förordning (EEG) nr 1234/85", ["celex/31985R1234"]),
    ("i (EU) 2019/1020 anges", ["celex/32019R1020"]),
    ("rådets beslut 2010/48/EG", ["celex/32010D0048"]),
    ("artikel 16.2 i EUF-fördraget", ["celex/12016E/TXT#16.2"]),
    ("artikel 267 FEUF", ["celex/12016E/TXT#267"]),
    ("artikel 47 i stadgan", ["celex/12012P/TXT#47"]),
    ("artikel 6.1 i EKMR", ["coe/005#A6P1"]),
    ("artiklarna 12, 13 och 14 i stadgan", ["celex/12012P/TXT#12", "celex/12012P/TXT#13", "celex/12012P/TXT#14"]),
    ("enligt GDPR:s artikel 17", ["celex/32016R0679#17"]),
    ("den tidigare artikel 29-arbetsgruppen", []),
    ("Se Mål C-434/16, Nowak p. 34–35", ["celex/62016CJ0434#point-34", "celex/62016CJ0434#point-35"]),
    ("genom lagen (1994:1564) om alkoholskatt, förkortad LAS, och av 8 a § LAS framgår", ["1994:1564", "1994:1564#P8a"]),
    ("Swedish Forestry Act, SFS 1979:429, requires", ["1979:429"]),
    ("minerallagen (1991:45) ch. 4 s. 2 para. 5", ["1991:45", "1991:45#K4P2S5"]),
    ("HFD 2013 ref. 71 och RÅ 2006 ref. 8", ["dom/hfd/2013:71", "dom/ra/2006:8"]),
    ("FFFS 2020:1 och JK 4578-13-40", ["fffs/2020:1", "avg/jk/4578-13-40"]),
    ("inget alls", []),
]


@pytest.mark.parametrize("text,uris", OTHERS)
def test_families(text, uris):
    assert [r.uri for r in Scanner().parse(text)] == uris


def test_anaphora_and_state():
    s, state = Scanner(), State()
    s.parse("Council Directive 71/305/EEC concerns contracts.", state)
    assert [r.uri for r in s.parse("Under Articles 20 and 26 of the directive, criteria", state)] == ["celex/31971L0305#20", "celex/31971L0305#26"]
    assert [r.uri for r in s.parse("Article 29 provides", state)] == ["celex/31971L0305#29"]
    assert s.parse("Article 29 provides") == []


def test_tables(spark):
    docs = spark.createDataFrame([(1, "enligt 3 § BrB"), (2, None), (3, "inget"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: [x.uri for x in r.refs] for r in extract(docs).collect() if r.refs} == {1: ["1962:700#P3"]}
    blocks = spark.createDataFrame([(1, 0, "a", "se 2"), (1, 1, "b", "§ avtalslagen"), (2, 0, "c", None)], "doc_id long, ord int, block_id string, text string")
    got = sorted((r.block_id, r.start, r.end, r.text, r.uri) for r in block_occurrences(blocks).collect())
    assert got == [("a", 3, 4, "2", "1915:218#P2"), ("b", 0, 13, "§ avtalslagen", "1915:218#P2")]


def test_patterns_are_tried_where_they_can_match():
    frag = ["3 kap. 2 § avtalslagen", "2 och 3 §§ BrB", "AVTALSLAGEN", "köplagen (1990:931)", "lagen (SFS 1998:112)", "Köplagen om köp av saker, nedan KKL", "5 § KKL", "NJA 2013 s. 502 p. 3", "HFD 2012 ref. 3", "prop. 1999/2000:12 s. 4 ff och 9",
            "mål C-12/03, p. 3 och 5", "Case 26/62", "artikel 6.1 i dataskyddsförordningen", "artiklarna 3 och 4 i direktiv 95/46/EG", "GDPR artikel 5", "Rådets beslut 2002/584", "(EU) 2019/1150", "SFS 1999:12", "JO 2001/02 s. 4", "ARN 2001-123",
            "FFFS 2010:1", "EDPB guidelines 3/2020", "WP 29", "Skatteverkets ställningstagande dnr 131 123/12", "Chapter 3, Section 4", "köplagen, ch. 3 s. 4", "ſkatt", "KÖPLAGEN", "İ", "\u212aonkurslagen", "\n", ". ", "(", ") ", "i "]
    free, draw = Scanner(), random.Random(3)
    free._needs = [((), None, False)] * len(free.patterns)
    scanner = Scanner()
    for _ in range(1500):
        text = " ".join(draw.choice(frag) for _ in range(draw.randint(1, 8)))
        assert scanner.parse(text) == free.parse(text), text
    text = "Enligt 1 kap. 1 § brottsbalken gäller detta. Jfr NJA 1990 s. 1 och prop. 2000/01:1 s. 1."
    assert len(list(free._matches(text))) == 16 and {k for _, k, _ in scanner._matches(text)} == {"case", "work", "statute"} and len(list(scanner._matches(text))) == 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_orders_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(documents, "ORDERS", 1000)
    assert documents.extract_citations(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 15
