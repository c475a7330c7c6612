"""Citations in Swedish legal text: spans to canonical identifiers.

One pass of a combined pattern per document; handlers turn a match into
attributes, and a state per document (last act, learned abbreviations) fills
what a match leaves open.  Identifiers are relative to ``base``:
``1915:218#K1P2S3N4`` statutes, ``dom/nja/2013s502`` cases,
``prop/2008/09:232#sid25`` preparatory works, ``celex/32016R0679#6.1`` EU law.

Dictionaries of names are parameters; the defaults hold the most common ones.
The document is the unit of work: blocks are joined by line ends and spans
mapped back, and nothing carries over from one document to the next.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Common statutes and acts by name and abbreviation.
LAWS = {
    "avtalslagen": "1915:218", "brottsbalken": "1962:700", "miljöbalken": "1998:808", "skadeståndslagen": "1972:207", "räntelagen": "1975:635",
    "rättegångsbalken": "1942:740", "jordabalken": "1970:994", "föräldrabalken": "1949:381", "ärvdabalken": "1958:637", "utsökningsbalken": "1981:774",
    "socialförsäkringsbalken": "2010:110", "köplagen": "1990:931", "konsumentköplagen": "2022:260", "förvaltningslagen": "2017:900", "regeringsformen": "1974:152",
    "tryckfrihetsförordningen": "1949:105", "yttrandefrihetsgrundlagen": "1991:1469", "offentlighets- och sekretesslagen": "2009:400", "aktiebolagslagen": "2005:551",
    "konkurslagen": "1987:672", "plan- och bygglagen": "2010:900", "utlänningslagen": "2005:716", "inkomstskattelagen": "1999:1229", "bokföringslagen": "1999:1078",
}
ABBREVIATIONS = {
    "BrB": "1962:700", "MB": "1998:808", "SkL": "1972:207", "RB": "1942:740", "JB": "1970:994", "FB": "1949:381", "ÄB": "1958:637", "UB": "1981:774", "SFB": "2010:110",
    "FL": "2017:900", "RF": "1974:152", "TF": "1949:105", "YGL": "1991:1469", "OSL": "2009:400", "ABL": "2005:551", "PBL": "2010:900", "IL": "1999:1229", "LAS": "1982:80", "AvtL": "1915:218",
}
ACTS = {"dataskyddsförordningen": "celex/32016R0679", "den allmänna dataskyddsförordningen": "celex/32016R0679", "GDPR": "celex/32016R0679"}
TREATIES = {
    "EUF-fördraget": "celex/12016E/TXT", "FEUF": "celex/12016E/TXT", "funktionsfördraget": "celex/12016E/TXT", "fördraget om Europeiska unionens funktionssätt": "celex/12016E/TXT", "EU-fördraget": "celex/12016M/TXT", "FEU": "celex/12016M/TXT",
    "stadgan": "celex/12012P/TXT", "EU-stadgan": "celex/12012P/TXT", "EU:s rättighetsstadga": "celex/12012P/TXT", "Europeiska unionens stadga om de grundläggande rättigheterna": "celex/12012P/TXT",
    "europakonventionen": "coe/005", "EKMR": "coe/005",
}
ORDINALS = {"första": "1", "andra": "2", "tredje": "3", "fjärde": "4", "femte": "5", "sjätte": "6", "sjunde": "7", "åttonde": "8", "nionde": "9"}
#: Letters of a statute fragment, in order.
FRAGMENT = [("chapter", "K"), ("section", "P"), ("element", "O"), ("piece", "S"), ("item", "N"), ("sentence", "M")]
ACT_LETTER = {"direktiv": "L", "directive": "L", "förordning": "R", "regulation": "R", "rekommendation": "H", "recommendation": "H", "beslut": "D", "decision": "D"}
COURTS = "HFD|RÅ|RH|AD|MD|MÖD|MIG"
WORKS = {"prop": "prop", "SOU": "sou", "Ds": "ds", "SÖ": "so", "bet": "bet", "dir": "dir", "Dir": "dir", "skr": "skr", "rskr": "rskr", "Prop": "prop", "Bet": "bet", "Skr": "skr"}
RESULT = "array<struct<start:int,end:int,text:string,uri:string,kind:string>>"


def statute(law: str, **parts: str | None) -> str:
    """``1915:218#K1P2S3N4``; an item without a paragraph is in the first one."""
    if parts.get("item") and not parts.get("piece"):
        parts["piece"] = "1"
    fragment = "".join(letter + re.sub(r"\s", "", ORDINALS.get(parts[k], parts[k])) for k, letter in FRAGMENT if parts.get(k))
    return law + (f"#{fragment}" if fragment else "")


def celex_act(kind: str, first: str, second: str) -> str | None:
    """``celex/3YYYYLNNNN``; year and number come in either order, and two digits mean the 1900s."""
    def year(x: str) -> int | None:
        y = int(x) + (1900 if len(x) <= 2 else 0)
        return y if 1950 <= y <= 2050 else None

    y, n = year(first), second
    if y is None:
        y, n = year(second), first
    return f"celex/3{y}{ACT_LETTER[kind.lower()]}{int(n):04d}" if y else None


def celex_case(letter: str, number: str, year: str) -> str:
    y = int(year) + (0 if len(year) == 4 else 1900 if int(year) >= 54 else 2000)
    return f"celex/6{y}{letter}J{int(number):04d}"


def article(instrument: str, spec: str) -> str:
    number, _, rest = re.sub(r"\s*\((\w+)\)", r".\1", spec.strip().rstrip(".")).replace(" ", ".").partition(".")
    if instrument.startswith("coe/"):
        return f"{instrument}#A{number}" + (f"P{rest.split('.')[0]}" if rest else "")
    return f"{instrument}#{number}" + (f".{rest}" if rest else "")


@dataclass
class Ref:
    start: int
    end: int
    uri: str
    kind: str


@dataclass
class State:
    law: str | None = None
    act: str | None = None
    by_kind: dict[str, str] = field(default_factory=dict)
    learned: dict[str, str] = field(default_factory=dict)


_S = r"[\s  ]"
_NUM = rf"\d+(?:{_S}?[a-h](?![\w]))?"
_JOIN = rf"(?:{_S}*(?:,|–|-|och|eller|samt){_S}*)"
_ORD = "|".join(ORDINALS)
_SFS = r"\d{4}:\d+"
#: A law's number in brackets.
_NUMBERED = re.compile(rf"\((?:SFS{_S})?\d{{4}}:\d")
#: Letters that match others regardless of case, though their lower forms differ.
_ODD = re.compile("[ſıİ]")
#: Names for which equal lower forms mean the same as a match regardless of case.
_PLAIN = re.compile(r"[\x20-\x7eà-öø-þ]*")
_ACT_WORDS = [*ACT_LETTER]
_ENGLISH = re.compile(r"\b(?:[Cc]h(?:apter|\.)\s*(\d+),?\s*)?(?:[Ss]ection|s\.)\s*(\d+(?:\s?[a-z]\b)?)(?:,?\s*para\.\s*(\d+))?")


class Scanner:
    """Finds citations; ``laws``, ``abbreviations``, ``acts`` and ``treaties`` map names to identifiers."""

    def __init__(self, laws=None, abbreviations=None, acts=None, treaties=None, base: str = "", families: set[str] | None = None):
        self.laws = {k.lower(): v for k, v in (LAWS if laws is None else laws).items()}
        self.short = ABBREVIATIONS if abbreviations is None else abbreviations
        self.acts = {k.lower(): v for k, v in (ACTS if acts is None else acts).items()}
        self.treaties = {k.lower(): v for k, v in (TREATIES if treaties is None else treaties).items()}
        self.base, self.families = base, families
        any_of = lambda names: "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) or "(?!)"
        law = rf"(?:(?P<lawname>(?i:{any_of(self.laws)}))(?:{_S}*\((?P<lawno>{_SFS})\))?|(?P<lawkind>(?i:\w*(?:lag(?:en)?|förordning(?:en)?|kungörelsen?|balken)))?{_S}*\((?P<sfs>{_SFS})\)|(?P<same>samma{_S}lag)|(?P<abbr>(?-i:[A-ZÅÄÖ][A-Za-zÅÄÖåäö]{{1,5}})(?!\w)))"
        tail = rf"(?:{_S}+(?P<piece>{_ORD}){_S}+stycket)?(?:{_S}+(?P<item>\d+|[a-z]){_S}?(?:p\.?|punkten)(?!\w))?(?:{_S}+(?P<sentence>{_ORD}){_S}+meningen)?"
        self.named = re.compile(any_of(self.laws), re.I)
        self.patterns: list[tuple[str, re.Pattern]] = []
        #: What a text (and its lower form) has wherever the pattern matches, and whether the pattern begins with a law's name.
        self._needs: list[tuple] = []
        self._by_name = all(map(_PLAIN.fullmatch, self.laws)) and "" not in self.laws

        def add(kind: str, pattern: str, *words: str, also=None, name: bool = False) -> None:
            if families is None or kind in families:
                self.patterns.append((kind, re.compile(pattern)))
                self._needs.append((words, also, name))

        add("case", rf"\bNJA{_S}+(?P<y>\d{{4}}){_S}+(?:s\.{_S}*(?P<n>\d+)|not{_S}*(?P<note>\d+))(?:,?{_S}+p\.{_S}*(?P<p>\d+))?", "NJA")
        add("case", rf"\b(?P<court>{COURTS}){_S}+(?P<y>\d{{4}})(?::|{_S}+(?:ref\.?|nr|s\.){_S}*|{_S}+not\.?{_S}*)(?P<n>\d+)(?:,?{_S}+p\.{_S}*(?P<p>\d+))?", *COURTS.split("|"))
        add("work", rf"\b(?P<w>[Pp]rop|SOU|Ds|SÖ|[Bb]et|[Dd]ir|rskr|[Ss]kr)\.?{_S}+(?P<y>\d{{4}}(?:/\d{{2,4}})?):(?P<n>[A-Za-zÅÄÖåäö]*\d+)(?:{_S}+s\.{_S}*(?P<pages>\d+(?:{_S}+ff?(?:\.|\b))?(?:{_S}*(?:,|och){_S}*\d+(?:{_S}+ff?(?:\.|\b))?(?![:/\d]))*))?", ":")
        add("eucase", rf"(?:\b(?:[Mm]ål(?:et)?|Case|målen){_S}+)?(?<![\w-])(?P<l>[CTF])[-‑–](?P<n>\d+)/(?P<y>\d{{2}})(?!\d)(?:[^.;()]{{0,80}}?,?{_S}+p(?:\.|unkt(?:erna)?){_S}*(?P<points>\d+(?:{_JOIN}\d+)*))?", *(l + dash for l in "CTF" for dash in "-‑–"))
        add("eucase", rf"\b(?:[Mm]ål|Case){_S}+(?P<n>\d{{1,3}})/(?P<y>5[4-9]|[6-8]\d)(?!\d)", "ål", "Case")
        instrument = rf"(?P<inst>(?i:{any_of({**self.treaties, **self.acts})}))s?"
        act = rf"(?P<act>(?i:direktiv|förordning|rekommendation|beslut|directive|regulation|recommendation|decision))(?:et|en)?{_S}+(?:\((?:EU|EG|EEG|EEC|EC|Euratom)\){_S}+)?(?:(?:nr|No){_S}+)?(?P<a1>\d{{1,4}})/(?P<a2>\d{{1,4}})(?:/(?:EG|EU|EEG|EC|EEC|Euratom))?"
        spec = rf"\d+(?:{_S}?\(\d+\)|\.\d+)*(?:\.[a-z]\b|{_S}[a-hj-z](?!\w))?"
        of = rf"(?:{_S}+(?:i|of)(?:{_S}+(?:the|det|den))?{_S}+|{_S}+)(?:(?:{instrument})|(?:[Ee]uropaparlamentets och rådets{_S}+|[Rr]ådets{_S}+|kommissionens{_S}+|Council{_S}+|Commission{_S}+)?{act}|(?P<back>förordningen|direktivet|beslutet|the{_S}+(?:directive|regulation)|(?:directive|regulation)))(?!\w)"
        add("euarticle", rf"(?:(?P<owner>(?i:{any_of({**self.treaties, **self.acts})}))(?:s|:s)?{_S}+)?(?<!\w)(?:[Aa]rtik(?:el|larna)|[Aa]rticles?|[Aa]rt\.|(?P<recital>[Rr]ecitals?|[Ss]käl(?:en)?)){_S}+(?P<specs>{spec}(?:(?:{_S}*(?:,|–){_S}*|{_S}+(?:och|and){_S}+){spec})*)(?!\w)(?:{of})?", "rtik", "rticle", "rt.", "ecital", "käl")
        add("euact", rf"(?:(?:[Ee]uropaparlamentets och rådets|[Rr]ådets|[Kk]ommissionens|Council|Commission){_S}+)?\b{act}(?!\d)", "/", also=_ACT_WORDS)
        add("euact", rf"\((?:EU)\){_S}+(?P<a1>20\d\d)/(?P<a2>\d+)(?!\d)", "(EU)")
        add("statute", rf"(?:(?P<chapter>\d+){_S}*kap\.{_S}*)?(?<![\w:/])(?P<sections>{_NUM}(?:{_JOIN}{_NUM})*){_S}*§{{1,2}}{tail}(?:(?:{_S}+(?:i{_S}+)?){law})?", "§")
        add("statute", rf"\b(?P<abbr>[A-ZÅÄÖ][A-Za-zÅÄÖåäö]{{1,5}}){_S}+(?:(?P<chapter>\d+){_S}*(?:kap\.|:){_S}*)?(?P<sections>{_NUM}(?:{_JOIN}{_NUM})*){_S}*§{{1,2}}{tail}", "§")
        add("english", rf"\bSFS{_S}+(?P<sfs>{_SFS})", "SFS")
        add("statute", rf"(?:(?P<lawname>(?i:{any_of(self.laws)}))(?:{_S}*\((?P<lawno>{_SFS})\))?(?!\w)|\b(?P<lawkind>(?i:\w*(?:lag(?:en)?|förordning(?:en)?|kungörelsen?))){_S}*\((?:SFS{_S})?(?P<sfs>{_SFS})\))(?:{_S}om{_S}[\wåäö ]+?(?=,))?(?:,{_S}(?:förkortad|nedan){_S}(?P<learn>[A-ZÅÄÖ]{{2,6}})\b)?", name=True)
        add("agency", rf"\bJO{_S}+(?P<jo>\d{{4}}(?:/\d{{2}})?){_S}+s\.{_S}*(?P<n>\d+)|\bJO:?s?{_S}+(?:beslut{_S}+)?(?:med{_S}+)?dnr{_S}+(?P<jodnr>\d+-\d+)|\bJK{_S}+(?:dnr{_S}+)?(?P<jk>\d+-\d+-\d+)|\bARN{_S}+(?P<arn>\d{{4}}-\d+)", "JO", "JK", "ARN")
        add("regulation", rf"\b(?P<fs>[A-ZÅÄÖ][A-Za-zÅÄÖåäö-]*FS){_S}+(?P<n>\d{{4}}:\d+)", "FS")
        add("guidance", rf"\b(?P<body>EDPB|EBA|ESMA|BEREC|ESRB|ECB)(?::?s)?{_S}+(?:riktlinjer|guidelines|rekommendation(?:er)?|recommendations?){_S}+(?P<n>\d+)/(?P<y>\d{{4}})|\bWP{_S}?(?P<wp>\d+)", "EDPB", "EBA", "ESMA", "BEREC", "ESRB", "ECB", "WP")
        add("tax", rf"\b(?:Skatteverkets?{_S}+(?:rättsliga{_S}+)?ställningstagande[^.()]{{0,60}}?dnr{_S}+)(?P<dnr>[\d-]+/\d+|\d[\d -]+-\d+)", "Skatteverket")
        self.trigger = re.compile(r"§|NJA|\b(?:HFD|RÅ|RH|AD|MD|MÖD|MIG|SOU|Ds|SÖ|JO|JK|ARN|SFS|WP)\b|[Pp]rop|[Bb]et\.|[Dd]ir\.|[Ss]kr\.|\d/\d|[Aa]rt|[Rr]ecital|[Ss]käl|\d{4}:\d|FS\s|lag|balk|form|för")

    def parse(self, text: str, state: State | None = None) -> list[Ref]:
        state = state or State()
        if not self.trigger.search(text):
            return []
        found = [(m.start(), -m.end(), k, kind, m) for k, kind, ms in self._matches(text) for m in ms]
        refs: list[Ref] = []
        reach = 0
        for start, _, _, kind, m in sorted(found, key=lambda x: x[:3]):
            if start < reach:
                continue
            got = list(getattr(self, f"_{kind}")(m, state, text))
            if got:
                refs += got
                reach = max(m.end() if kind != "euarticle" else got[-1].end, reach)
        if self.families is None or "english" in self.families:
            refs += self._pinpoints(text, refs)
        return sorted((Ref(r.start, r.end, self.base + r.uri, r.kind) for r in refs), key=lambda r: (r.start, -r.end))

    def _matches(self, text: str) -> Iterator[tuple]:
        """All matches of each pattern; those that lack what they need are not tried, and law names are looked up before they are matched."""
        low = None if _ODD.search(text) else text.lower()
        for k, ((kind, p), (words, also, name)) in enumerate(zip(self.patterns, self._needs)):
            if name and low is not None and self._by_name and not _NUMBERED.search(text):
                yield k, kind, self._named_at(p, text, low)
            elif (not words or any([w in text for w in words])) and (low is None or not also or any([w in low for w in also])):
                yield k, kind, p.finditer(text)

    def _named_at(self, p: re.Pattern, text: str, low: str) -> Iterator[re.Match]:
        starts = []
        for name in self.laws:
            at = low.find(name)
            while at >= 0:
                starts.append(at)
                at = low.find(name, at + 1)
        reach = 0
        for at in sorted(set(starts)):
            if at >= reach and (m := p.match(text, at)):
                yield m
                reach = m.end()

    def _case(self, m, state, text) -> Iterator[Ref]:
        g = m.groupdict()
        if "court" in g:
            slug = g["court"].lower().translate(str.maketrans("åäö", "aao"))
            between = "/not/" if "not" in m[0] else ":"
            uri = f"dom/{slug}/{g['y']}{between}{g['n']}"
        else:
            uri = f"dom/nja/{g['y']}s{g['n']}" if g["n"] else f"dom/nja/{g['y']}/not/{g['note']}"
        yield Ref(m.start(), m.end(), uri + (f"#p{g['p']}" if g["p"] else ""), "case")

    def _work(self, m, state, text) -> Iterator[Ref]:
        year = m["y"]
        if re.fullmatch(r"(\d\d)\d\d/\1\d\d", year):
            year = year[:5] + year[7:]
        uri = f"{WORKS[m['w']]}/{year}:{m['n']}"
        if not m["pages"]:
            yield Ref(m.start(), m.end(), uri, "work")
            return
        at, first = m.start("pages"), True
        for p in re.finditer(r"(\d+)(?:\s+(ff?\.?))?", m["pages"]):
            yield Ref(m.start() if first else at + p.start(1), at + p.end(1), f"{uri}#sid{p[1]}", "work")
            first = False
            if p[2]:
                many = p[2].count("f")
                for k in range(many):
                    last = k == many - 1
                    yield Ref(at + p.start(2) + k, at + (p.end(2) if last else p.start(2) + k + 1), f"{uri}#sid{int(p[1]) + k + 1}", "work")

    def _eucase(self, m, state, text) -> Iterator[Ref]:
        g = m.groupdict()
        uri = celex_case(g.get("l") or "C", g["n"], g["y"] if g.get("l") else f"19{g['y']}")
        if not g.get("points"):
            yield Ref(m.start(), m.end(), uri, "eucase")
            return
        at = m.start("points")
        for k, p in enumerate(re.finditer(r"\d+", g["points"])):
            yield Ref(m.start() if not k else at + p.start(), at + p.end(), f"{uri}#point-{p[0]}", "eucase")

    def _instrument(self, m, state) -> str | None:
        g = m.groupdict()
        name = g.get("inst") or g.get("owner")
        if name:
            uri = self.treaties.get(name.lower()) or self.acts.get(name.lower())
            if name.lower() in self.acts:
                state.act = uri
            return uri
        if g.get("act"):
            uri = celex_act(g["act"], g["a1"], g["a2"])
            if uri:
                state.act = uri
                state.by_kind[ACT_LETTER[g["act"].lower()]] = uri
            return uri
        if g.get("back"):
            letter = "L" if "irekt" in g["back"] or "irect" in g["back"] else "D" if "beslut" in g["back"] else "R"
            return state.by_kind.get(letter) or (state.act if state.act and letter in state.act[6:] else None)
        return state.act

    def _euarticle(self, m, state, text) -> Iterator[Ref]:
        if re.match(r"[\s-]*(?:arbetsgruppen|Data Protection Working Party)", text[m.end("specs") :]):
            return
        if m["recital"] and not (m["inst"] or m["act"] or m["back"]):
            return
        uri = self._instrument(m, state)
        if not uri:
            return
        parts = list(re.finditer(r"\d+(?:[\s  ]?\(\d+\)|\.\d+)*(?:\.[a-z]\b|[\s  ][a-hj-z](?!\w))?", m["specs"]))
        at = m.start("specs")
        whole = m.end()
        for k, p in enumerate(parts):
            start = m.start() if not k else at + p.start()
            end = at + p.end() if k < len(parts) - 1 else whole
            to = f"{uri}#recital-{p[0].split('.')[0]}" if m["recital"] else article(uri, p[0])
            yield Ref(start, end, to, "euarticle")

    def _euact(self, m, state, text) -> Iterator[Ref]:
        g = m.groupdict()
        uri = celex_act(g.get("act") or "förordning", g["a1"], g["a2"])
        if uri:
            state.act = uri
            state.by_kind[uri[11:12]] = uri
            yield Ref(m.start(), m.end(), uri, "euact")

    def _statute(self, m, state, text) -> Iterator[Ref]:
        g = m.groupdict()
        short = g.get("abbr")
        law = (g.get("lawno") or g.get("sfs") or (self.laws.get(g["lawname"].lower()) if g.get("lawname") else None) or (state.law if g.get("same") else None) or (state.learned.get(short) or self.short.get(short) if short else None))
        named = bool(g.get("lawname") or g.get("sfs"))
        if not g.get("sections"):
            if law and (g.get("sfs") or g.get("lawno") or g.get("learn")):
                end = m.end("sfs") + 1 if g.get("sfs") else m.end("lawno") + 1 if g.get("lawno") else m.end("lawname")
                state.law = law
                if g.get("learn"):
                    state.learned[g["learn"]] = law
                yield Ref(m.start(), end, law, "statute")
            elif law:
                state.law = law
            return
        end = m.end()
        if short and not law:
            if m.re.groupindex.get("lawname") is None:
                return
            end, short = m.start("abbr"), None
            end = len(text[:end].rstrip())
        law = law or state.law
        if not law:
            return
        state.law = law
        parts = list(re.finditer(_NUM, g["sections"]))
        at = m.start("sections")
        rest = {"piece": g.get("piece"), "item": g.get("item"), "sentence": g.get("sentence")}
        if len(parts) == 1:
            yield Ref(m.start(), end, statute(law, chapter=g.get("chapter"), section=parts[0][0], **rest), "statute")
            return
        for k, p in enumerate(parts):
            yield Ref(m.start() if not k else at + p.start(), at + p.end(), statute(law, chapter=g.get("chapter"), section=p[0], **(rest if k == len(parts) - 1 else {})), "statute")
        if named:
            yield Ref(m.start("lawname") if g.get("lawname") else m.start("lawkind") if g.get("lawkind") else m.start("sfs") - 1, end, law, "statute")

    def _english(self, m, state, text) -> Iterator[Ref]:
        state.law = m["sfs"]
        yield Ref(m.start(), m.end(), m["sfs"], "english")

    def _pinpoints(self, text: str, refs: list[Ref]) -> Iterator[Ref]:
        """Chapter and section after a statute, at most six separators away."""
        if not ("ection" in text or "hapter" in text or "h." in text):
            return
        points = [m for m in _ENGLISH.finditer(text) if m[1] or "ection" in m[0]]
        if not points:
            return
        ends = sorted([(r.end, r.uri) for r in refs if re.fullmatch(_SFS, r.uri)] + [(m.end(), self.laws[m[0].lower()]) for m in self.named.finditer(text)])
        for m in points:
            at = bisect.bisect_right(ends, (m.start(), chr(0x10FFFF))) - 1
            if at >= 0 and re.fullmatch(r"[\s,()]{0,6}", text[ends[at][0] : m.start()]):
                yield Ref(m.start(), m.end(), statute(ends[at][1], chapter=m[1], section=m[2], piece=m[3]), "english")

    def _agency(self, m, state, text) -> Iterator[Ref]:
        g = m.groupdict()
        uri = f"avg/jo/{g['jo']}s{g['n']}" if g["jo"] else f"avg/jo/{g['jodnr']}" if g["jodnr"] else f"avg/jk/{g['jk']}" if g["jk"] else f"avg/arn/{g['arn']}"
        yield Ref(m.start(), m.end(), uri, "agency")

    def _regulation(self, m, state, text) -> Iterator[Ref]:
        yield Ref(m.start(), m.end(), f"{m['fs'].lower().translate(str.maketrans('åäö', 'aao'))}/{m['n']}", "regulation")

    def _guidance(self, m, state, text) -> Iterator[Ref]:
        yield Ref(m.start(), m.end(), f"guidance/edpb/wp{m['wp']}" if m["wp"] else f"guidance/{m['body'].lower()}/{m['n']}-{m['y']}", "guidance")

    def _tax(self, m, state, text) -> Iterator[Ref]:
        yield Ref(m.start(), m.end(), f"rs/skv/{m['dnr'].replace(' ', '')}", "tax")


def hopeful(docs: DataFrame) -> DataFrame:
    """The documents with a possible citation; the others need not reach Python."""
    return docs.where(F.col("text").rlike(r"§|\d/\d|\d{4}:\d|NJA|\d{4}|[Aa]rt|lag|balk|form"))


def extract(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id, refs`` of each document with a possible citation; texts without a trigger never reach Python."""
    scanner = scanner or Scanner()

    def run(batches):
        for batch in batches:
            edges, start, end, cited, uri, kind = [0], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                for r in scanner.parse(text):
                    start.append(r.start)
                    end.append(r.end)
                    cited.append(text[r.start : r.end])
                    uri.append(r.uri)
                    kind.append(r.kind)
                edges.append(len(start))
            parts = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), *(pa.array(x, pa.string()) for x in (cited, uri, kind))], ["start", "end", "text", "uri", "kind"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts)], ["doc_id", "refs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return hopeful(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, refs {RESULT}")


def block_occurrences(blocks: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """``doc_id, block_id, start, end, text, uri, kind``: documents of blocks ``doc_id, ord, block_id, text``; spans are clipped to their blocks."""
    scanner = scanner or Scanner()
    parts = F.sort_array(F.collect_list(F.struct("ord", "block_id", "text")))
    docs = blocks.groupBy("doc_id").agg(parts.alias("blocks"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, edges = "\n".join(p["text"] or "" for p in parts), []
                at = 0
                for p in parts:
                    edges.append((at, at + len(p["text"] or ""), p["block_id"]))
                    at += len(p["text"] or "") + 1
                for r in scanner.parse(text):
                    for a, b, name in edges:
                        if a < r.end and b > r.start:
                            s, e = max(a, r.start) - a, min(b, r.end) - a
                            rows.append((doc, name, s, e, text[a + s : a + e], r.uri, r.kind))
            names, kinds = ["doc_id", "block_id", "start", "end", "text", "uri", "kind"], [batch.schema.field(0).type, batch.schema.field(1).type.value_type.field("block_id").type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    kind = lambda c: blocks.schema[c].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind('doc_id')}, block_id {kind('block_id')}, start int, end int, text string, uri string, kind string")
