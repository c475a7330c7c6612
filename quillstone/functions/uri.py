"""Expressions over identifiers and citations; identifiers are relative (``1915:218#K1P2``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Ordinals of paragraphs, and sources by the start of an identifier (longest first).
ORDINALS = {"1": "första", "2": "andra", "3": "tredje", "4": "fjärde", "5": "femte", "6": "sjätte"}
SOURCES = [
    ("dom/echr/", "echr"), ("dom/", "case"), ("celex/6", "eu_case"), ("celex/", "eu"), ("prop/", "prop"), ("sou/", "sou"), ("ds/", "ds"), ("bet/", "bet"),
    ("dir/", "dir"), ("skr/", "skr"), ("avg/", "decision"), ("guidance/", "guidance"), ("rs/", "guidance"), ("coe/", "treaty"), ("untc/", "treaty"), ("so/", "treaty"),
]
KINDS = {"case": "judgment", "echr": "judgment", "eu_case": "judgment", "prop": "preparatory", "sou": "preparatory", "ds": "preparatory", "bet": "preparatory", "dir": "preparatory", "skr": "preparatory"}


def document_of(uri: Column) -> Column:
    return F.substring_index(uri, "#", 1)


def fragment_of(uri: Column) -> Column:
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise("")


def source_of(uri: Column) -> Column:
    """The kind of source, by the longest known start; a number is a statute."""
    out = F.when(uri.rlike(r"^\d{4}:"), "statute")
    for start, name in SOURCES:
        out = out.when(uri.startswith(start), name)
    return out.otherwise("other")


def target_kind(source: Column) -> Column:
    out = F.when(source == "statute", "provision")
    for name, kind in KINDS.items():
        out = out.when(source == name, kind)
    return out.otherwise("document")


def canonical(uri: Column) -> Column:
    """Scheme and host in lower case; the path keeps its case."""
    head = F.regexp_extract(uri, r"^([A-Za-z]+://[^/]*)", 1)
    return F.concat(F.lower(head), F.substring(uri, F.length(head) + 1, F.length(uri)))


def statute(law: Column, chapter: Column, section: Column, piece: Column, item: Column, sentence: Column) -> Column:
    """``law#K1P2S3N4M5``; an item without a paragraph is in the first one."""
    def part(letter: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(letter), F.regexp_replace(value, r"\s", "")), F.lit(""))

    first = F.when(item.isNotNull() & piece.isNull(), F.lit("1")).otherwise(piece)
    fragment = F.concat(part("K", chapter), part("P", section), part("S", first), part("N", item), part("M", sentence))
    return F.when(fragment == "", law).otherwise(F.concat(law, F.lit("#"), fragment))


def fragment_parts(fragment: Column) -> Column:
    """``struct(chapter, section, piece, item, sentence)`` of ``K1P2S3N4M5``."""
    def part(letter: str) -> Column:
        return F.nullif(F.regexp_extract(fragment, letter + r"(\d+[a-z]?)", 1), F.lit(""))

    return F.struct(*(part(letter).alias(name) for letter, name in (("K", "chapter"), ("P", "section"), ("S", "piece"), ("N", "item"), ("M", "sentence"))))


def celex_act(kind: Column, first: Column, second: Column) -> Column:
    """``celex/3YYYYLNNNN``, year and number in either order, two digits in the 1900s; NULL without a year."""
    def year(x: Column) -> Column:
        y = x.cast("int") + F.when(F.length(x) <= 2, 1900).otherwise(0)
        return F.when(y.between(1950, 2050), y)

    letter = F.element_at(F.create_map(*[F.lit(x) for k, v in (("direktiv", "L"), ("directive", "L"), ("förordning", "R"), ("regulation", "R"), ("rekommendation", "H"), ("recommendation", "H"), ("beslut", "D"), ("decision", "D")) for x in (k, v)]), F.lower(kind))
    number = F.when(year(first).isNotNull(), second).otherwise(first).cast("int").cast("string")
    return F.concat(F.lit("celex/3"), F.coalesce(year(first), year(second)).cast("string"), letter, F.lpad(number, 4, "0"))


def celex_case_number(celex: Column) -> Column:
    """``62016CJ0434`` as ``C-434/16``; other values unchanged."""
    p = r"^6(\d{4})(CJ|TJ|CO|TO)(\d{4})"
    number = F.regexp_extract(celex, p, 3).try_cast("int").cast("string")
    letter = F.substring(F.regexp_extract(celex, p, 2), 1, 1)
    return F.when(celex.rlike(p), F.concat(letter, F.lit("-"), number, F.lit("/"), F.substring(F.regexp_extract(celex, p, 1), 3, 2))).otherwise(celex)


def case_law(court: Column, year: Column, tail: Column) -> Column:
    return F.concat(F.lit("dom/"), F.translate(F.lower(court), "åäö", "aao"), F.lit("/"), year, tail)


def celex_case(letter: Column, number: Column, year: Column) -> Column:
    """Two-digit years from 54 on are in the 1900s; a case without letter is the court's, of 1954 to 1989 only."""
    full = F.when(F.length(year) == 4, year.cast("int")).otherwise(year.cast("int") + F.when(year.cast("int") >= 54, 1900).otherwise(2000))
    known = F.when(letter == "", full.between(1954, 1989)).otherwise(True)
    return F.when(known, F.concat(F.lit("celex/6"), full.cast("string"), F.when(letter == "", "C").otherwise(letter), F.lit("J"), F.lpad(number, 4, "0")))


def expand_citation(text: Column, uri: Column, follower: Column | None = None) -> Column:
    """Loose words and signs at the end go; a bare page number gets its bill."""
    cit = text if follower is None else F.concat_ws(" ", text, F.nullif(follower, F.lit("")))
    cit = F.trim(F.regexp_replace(F.trim(cit), r"(?iu)\s+(?:och|samt|jfr)\s*$", ""))
    cit = F.trim(F.regexp_replace(cit, r"[.,;]+$", ""))
    p = r"prop/(\d{4})/(\d+):(\d+)#sid(\d+)"
    bill = F.concat(F.lit("prop. "), F.regexp_extract(uri, p, 1), F.lit("/"), F.regexp_extract(uri, p, 2), F.lit(":"), F.regexp_extract(uri, p, 3), F.lit(" s. "), cit)
    return F.when(cit.rlike(r"^\d+(\s+f{1,2}\.?)?$") & uri.rlike(p), bill).otherwise(cit)


def citation_for_unit(citation: Column, source_id: Column, unit_type: Column) -> Column:
    """The citation with the page, point or provision that the identifier names."""
    base, fragment = document_of(source_id), fragment_of(source_id)
    page, point = F.regexp_extract(fragment, r"sid(\d+)", 1), F.regexp_extract(fragment, r"p(?:oint-)?(\d+)", 1)
    # a first match is replaced by cutting around it
    def replaced(pattern: str, new: Column) -> Column:
        rest = F.regexp_extract(citation, rf"(?s)^(.*?){pattern}(.*)$", 1)
        after = F.regexp_extract(citation, rf"(?s)^.*?{pattern}(.*)$", 1)
        return F.concat(rest, new, after)

    bill = F.when(base.rlike(r"^prop/\d{4}/\d{2}:\d+"), F.concat(F.lit("prop. "), F.regexp_extract(base, r"^prop/(\d{4}/\d{2}:\d+)", 1), F.lit(" s. "), page)).otherwise(citation)
    paged = F.when(page == "", citation).when(citation.rlike(r"\bs\.\s*\d+"), replaced(r"\bs\.\s*\d+(?:\s*f+\.?)?", F.concat(F.lit("s. "), page))).otherwise(bill)
    nja = F.concat(F.lit("NJA "), F.regexp_extract(base, r"^dom/nja/(\d{4})s(\d+)", 1), F.lit(" s. "), F.regexp_extract(base, r"^dom/nja/(\d{4})s(\d+)", 2), F.lit(" p. "), point)
    hfd = F.concat(F.lit("HFD "), F.regexp_extract(base, r"^dom/hfd/(\d{4}):(\d+)", 1), F.lit(" ref. "), F.regexp_extract(base, r"^dom/hfd/(\d{4}):(\d+)", 2), F.lit(" p. "), point)
    pinned = F.when(point == "", citation).when(citation.rlike(r"\bp\.\s*\d+"), replaced(r"\bp\.\s*\d+(?:\s*(?:och|-|–)\s*\d+)?", F.concat(F.lit("p. "), point))).when(base.startswith("dom/nja/"), nja).when(base.startswith("dom/hfd/"), hfd).otherwise(citation)
    case = celex_case_number(F.regexp_extract(base, r"celex/(\w+)", 1))
    name = F.trim(F.regexp_extract(citation, r"^\s*[CT]-\d+/\d+\s*,?\s*([^,]*)", 1))
    eu = F.when(point == "", citation).when((name != "") & ~name.startswith("EU:"), F.concat(case, F.lit(", "), name, F.lit(", punkt "), point)).otherwise(F.concat(F.lit("mål "), F.when(case == "", citation).otherwise(case), F.lit(", punkt "), point))
    parts = fragment_parts(fragment)
    ordinal = F.try_element_at(F.create_map(*[F.lit(x) for k, v in ORDINALS.items() for x in (k, v)]), parts["piece"])
    words = "|".join(ORDINALS.values())
    act = F.trim(F.regexp_replace(F.trim(F.regexp_replace(citation, rf"^.*?§+\s*(?:(?:{words}) stycket\s*)?(?:(?:första|andra|tredje) meningen\s*)?", "")), r"^\d+\s*kap\.\s*", ""))
    act = F.when((act == "") | act.rlike(r"^[\d\s,och\-–§]*$"), F.concat(F.lit("("), base, F.lit(")"))).otherwise(act)
    provision = F.when(parts["section"].isNull(), citation).otherwise(F.concat_ws(" ", F.concat(parts["chapter"], F.lit(" kap.")), F.concat(parts["section"], F.lit(" §")), F.concat(ordinal, F.lit(" stycket")), act))
    return F.when(unit_type == "prop_page", paged).when(unit_type == "case_pinpoint", pinned).when(unit_type == "cjeu_pinpoint", eu).when(unit_type.isin("statute_provision", "statute_stycke"), provision).otherwise(citation)


def unit_plan(uri: Column, citation: Column) -> Column:
    """``struct(unit_type, fragments, reason)``: which units of its document a citation stands for, or why it can't be bounded."""
    base, fragment = document_of(uri), fragment_of(uri)
    none = F.array().cast("array<string>")
    def plan(unit, fragments: Column = none, reason: str | None = None) -> Column:
        return F.struct((F.lit(unit) if isinstance(unit, str) else unit).alias("unit_type"), fragments.alias("fragments"), F.lit(reason).cast("string").alias("reason"))

    work = F.regexp_extract(base, r"^(prop|sou|ds|dir|bet)/", 1)
    page = F.coalesce(F.nullif(F.regexp_extract(fragment, r"sid(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(citation, r"s\.\s*(\d+)", 1), F.lit(""))).cast("int")
    extra = F.length(F.regexp_extract(citation, r"\bs\.\s*\d+\s*(ff?)\b\.?", 1))
    pages = F.transform(F.sequence(page, page + extra), lambda p: F.concat(F.lit("sid"), p.cast("string")))
    from quillstone.functions.text import paragraph_range

    marked = F.when(fragment.rlike(r"^p(?:oint-)?\d+"), F.regexp_extract(fragment, r"(\d+)", 1)).when(citation.rlike(r"\bp(?:unkt(?:erna)?)?\.?\s*\d+"), F.regexp_extract(citation, r"\bp(?:unkt(?:erna)?)?\.?\s*([\d,\s–och-]+)", 1)).otherwise("")
    points = paragraph_range(marked)
    named = lambda lead: F.transform(points, lambda n: F.concat(F.lit(lead), n.cast("string")))
    statute_type = F.when(fragment.rlike(r"P\d+[a-z]*S\d+"), "statute_stycke").when(fragment.rlike(r"P\d"), "statute_provision").otherwise("document_unit")
    return (
        F.when(base.rlike(r"^\d{4}:\d+"), F.when(fragment == "", plan("statute_act", reason="unit_unbounded")).when(fragment.rlike(r"^K\d+[a-z]?$"), plan("statute_chapter", reason="unit_unbounded")).otherwise(plan(statute_type, F.array(fragment))))
        .when(work != "", F.when(page.isNull(), plan(F.concat(work, F.lit("_whole")), reason="unit_unbounded")).otherwise(plan(F.concat(work, F.lit("_page")), pages)))
        .when(base.startswith("dom/"), F.when(F.size(points) > 0, plan("case_pinpoint", named("p"))).otherwise(plan("case_judgment")))
        .when(base.startswith("celex/6"), F.when(F.size(points) > 0, plan("cjeu_pinpoint", named("point-"))).otherwise(plan("cjeu_assessment")))
        .when(base.startswith("celex/") & (fragment != ""), plan("eu_article", F.array(fragment)))
        .when(fragment != "", plan("document_unit", F.array(fragment)))
        .otherwise(plan("generic_document"))
    )


def swedish_date(text: Column) -> Column:
    """"3 november 2009" or an ISO date as a DATE."""
    months = "januari februari mars april maj juni juli augusti september oktober november december".split()
    p = r"(?iu)(\d{1,2})\s+(" + "|".join(months) + r")\s+(\d{4})"
    number = F.array_position(F.array(*map(F.lit, months)), F.lower(F.regexp_extract(text, p, 2))).cast("int")
    day = F.concat_ws("-", F.regexp_extract(text, p, 3), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, p, 1), 2, "0"))
    return F.when(number > 0, day.try_cast("date")).otherwise(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0).try_cast("date"))
