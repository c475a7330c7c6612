"""Labels, titles, messages and series bounds of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillstone.functions.uri import document_of, fragment_of


def _spaced(number: Column) -> Column:
    return F.regexp_replace(number, r"(?i)([a-z]+)", " $1")


def pin_label(fragment: Column) -> Column:
    """``K2P3a`` as "2 kap. 3 a §", pages, recitals and articles likewise; others as they are."""
    f = F.regexp_replace(F.coalesce(fragment, F.lit("")), "^#", "")
    part = lambda p, g=1: _spaced(F.regexp_extract(f, p, g))
    both, section, chapter = r"(?i)^K(\d+[a-z]?)P(\d+[a-z]?)$", r"(?i)^P(\d+[a-z]?)$", r"(?i)^K(\d+[a-z]?)$"
    return (
        F.when(f.rlike(both), F.concat(part(both), F.lit(" kap. "), part(both, 2), F.lit(" §")))
        .when(f.rlike(section), F.concat(part(section), F.lit(" §")))
        .when(f.rlike(chapter), F.concat(part(chapter), F.lit(" kap.")))
        .when(f.rlike(r"(?i)^sid\d+$"), F.concat(F.lit("s. "), F.regexp_extract(f, r"(\d+)", 1)))
        .when(f.rlike(r"(?i)^recital-\d+$"), F.concat(F.lit("skäl "), F.regexp_extract(f, r"(\d+)", 1)))
        .when(f.rlike(r"^\d+(\.\d+)*$"), F.concat(F.lit("art. "), f))
        .otherwise(f)
    )


def display_title(uri: Column, names: Column | None = None) -> Column:
    """A title for a document; ``names`` may map statute numbers to names."""
    u = F.regexp_replace(F.trim(uri), "/$", "")
    named = F.try_element_at(names, u) if names is not None else F.lit(None).cast("string")
    nja, hfd = r"^dom/nja/(\d{4})s(\d+)$", r"^dom/hfd/(\d{4}):(\d+)$"
    return (
        F.when(u.rlike(r"^\d{4}:\d+$"), F.coalesce(F.concat(F.upper(F.substring(named, 1, 1)), F.substring(named, 2, 1000)), F.concat(F.lit("Lag ("), u, F.lit(")"))))
        .when(u.rlike(nja), F.concat(F.lit("NJA "), F.regexp_extract(u, nja, 1), F.lit(" s. "), F.regexp_extract(u, nja, 2)))
        .when(u.rlike(hfd), F.concat(F.lit("HFD "), F.regexp_extract(u, hfd, 1), F.lit(" ref. "), F.regexp_extract(u, hfd, 2)))
        .when(u.startswith("prop/"), F.concat(F.lit("Prop. "), F.substring(u, 6, 1000)))
        .otherwise(F.substring_index(u, "/", -1))
    )


def invalid_message(text: Column, uri: Column) -> Column:
    """Why a citation names nothing: a case, a provision of a law, a number, a name."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    provision = r"(?i)^((?:\d+\s*[a-z]?\s*kap\.?\s*)?\d+\s*[a-z]?\s*§)(?:\s+(?:i|av)\s+|\s+)(.+)$"
    case = document_of(uri).startswith("dom/") | t.rlike(r"(?i)^(?:NJA|HFD|RÅ|RH|AD|MÖD|MIG|PMÖD|MD|RK)\b")
    return (
        F.when(case, F.concat(F.lit("Det finns inget rättsfall betecknat "), t, F.lit(".")))
        .when(t.rlike(provision), F.concat(F.lit("Det finns ingen "), F.regexp_replace(F.regexp_extract(t, provision, 1), r"(?<=\d)§", " §"), F.lit(" i "), F.regexp_extract(t, provision, 2), F.lit(".")))
        .when(fragment_of(uri).rlike(r"[KP]\d"), F.concat(F.lit("Det finns ingen "), pin_label(fragment_of(uri)), F.lit(" i den angivna författningen ("), t, F.lit(").")))
        .when(t.rlike(r"(?i)^(?:sfs\s+)?\d{4}:-?\d+$"), F.concat(F.lit("Det finns ingen författning med beteckningen "), t, F.lit(".")))
        .otherwise(F.concat(F.lit("Det finns ingen lag som heter "), t, F.lit(".")))
    )


def cannot_exist(uri: Column, first: int = 1874, complete_from: int = 1981, complete_to: int = 2025, this_year: int = 2026) -> Column:
    """Whether series bounds alone rule an unfound identifier out: before the start, in the future, or in a year that is indexed in full."""
    nja, sfs = r"(?i)^dom/nja/(\d{4})s(\d+)", r"^(\d{4}):-?\d+$"
    year, page = F.regexp_extract(uri, nja, 1).try_cast("int"), F.regexp_extract(uri, nja, 2).try_cast("int")
    law = F.regexp_extract(uri, sfs, 1).try_cast("int")
    case = (year < first) | (year > this_year) | year.between(complete_from, complete_to) | (page == 0)
    return F.coalesce(case, F.lit(False)) | F.coalesce((law < 1600) | (law > this_year + 1), F.lit(False))


def is_date_number(number: Column, this_year: int = 2026) -> Column:
    """A three-part file number that is really a date."""
    p = r"^(\d+)-(\d+)-(\d+)$"
    a, b, c = (F.regexp_extract(number, p, i).try_cast("int") for i in (1, 2, 3))
    return F.coalesce(a.between(1980, this_year) & b.between(1, 12) & c.between(1, 31), F.lit(False))


def folded_party(name: Column) -> Column:
    """A party's name for comparison: lower case, no articles, letters and digits only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\bthe\s+", " "), r"[^\p{L}\p{N}]+", " "))


def docket(text: Column) -> Column:
    """``t3-08`` as ``T 3-08``."""
    return F.regexp_replace(F.upper(F.trim(text)), r"^([A-ZÅÄÖ]{1,3})\s*(\d+-\d+)$", "$1 $2")


def parliamentary_year(text: Column) -> Column:
    """"1999/2000" keeps its second year, "2017/2018" becomes "2017/18"."""
    return F.regexp_replace(text, r"^(\d\d)(\d\d)/\1(\d\d)$", "$1$2/$3")


def pin_query(text: Column) -> Column:
    """"12:1" as "12 kap. 1 §"."""
    return F.regexp_replace(text, r"^(\d+[a-z]?):(\d+[a-z]?)$", "$1 kap. $2 §")


def page_query(text: Column) -> Column:
    """"NJA 2013 s. 502", "HFD 2013 ref. 71" or "prop. 2008/09:232" as an identifier, else NULL."""
    nja, hfd, work = r"(?i)^NJA\s+(\d{4})\s+s\.?\s*(\d+)$", r"(?i)^HFD\s+(\d{4})\s+ref\.?\s*(\d+)$", r"(?i)^(prop|sou|ds|bet|dir|skr)\.?\s+(\d{4}(?:/\d{2})?:\w+)$"
    t = F.trim(text)
    return (
        F.when(t.rlike(nja), F.concat(F.lit("dom/nja/"), F.regexp_extract(t, nja, 1), F.lit("s"), F.regexp_extract(t, nja, 2)))
        .when(t.rlike(hfd), F.concat(F.lit("dom/hfd/"), F.regexp_extract(t, hfd, 1), F.lit(":"), F.regexp_extract(t, hfd, 2)))
        .when(t.rlike(work), F.concat(F.lower(F.regexp_extract(t, work, 1)), F.lit("/"), F.regexp_extract(t, work, 2)))
    )


def roman(number: int) -> str:
    out = ""
    for value, sign in ((100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while number >= value:
            out, number = out + sign, number - value
    return out


def arabic(text: Column, most: int = 200) -> Column:
    """A roman number up to ``most``, or the digits themselves."""
    table = F.create_map(*[x for n in range(1, most + 1) for x in (F.lit(roman(n)), F.lit(n))])
    return F.coalesce(text.try_cast("int"), F.try_element_at(table, F.upper(text)))
