"""Queries of a reader ("BrB 12:1", "GDPR art 6.1", "mål C-434/16") to identifiers.

Names are a table ``name, kind, target`` with kinds law, act, case, treaty,
instrument and regulation.  A query is matched by the word-boundary prefixes
that it has, by equality, so the work does not grow with the names.  The
cascade: an identifier itself; a page of a series; then all resolvers that
know the query; and the general one (courts' files, registers, instruments,
the citation scanner) where none does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillstone.functions import labels as L, uri as U
from quillstone.operators import citations as C

# Forms of articles, recitals and identifiers in queries.
ARTICLE = r"(?i)^art(?:ikel|icle)?\.?\s*(\d+)(?:[.\s:]+(\d+))?"
BARE_ARTICLE = r"^(\d+)(?:[.\s:]+(\d+))?$"
RECITAL = r"(?i)^(?:\(\s*(\d+)\s*\)?|(?:sk[äa]l|recital)\.?\s*(\d+))$"
EU_CASE = r"^(?:(?:Case|[Mm]ål)\s+)?([CTFctf])[-‑‐–—]\s?(\d{1,4})/(\d{2,4})$"
SFS = r"(?i)^(?:SFS\s+)?(\d{4}:\d{1,4}(?:_s\.\d+)?)(?:\s+(.*))?$"
IDENTIFIERS = (
    (r"(?i)^(?:CELEX\s*:\s*)?([01356][0-9]{4}[A-Z][A-Z0-9/()_-]*)$", lambda x: F.concat(F.lit("celex/"), F.upper(x))),
    (r"(?i)^(?:C?ETS\s*(?:No\.?\s*)?|CoE\s+)([0-9]+)$", lambda x: F.concat(F.lit("coe/"), _padded(x, 3))),
    (r"(?i)^(?:ICRC\s+)([0-9]+)$", lambda x: F.concat(F.lit("icrc/"), x.cast("long").cast("string"))),
    (r"(?i)^(?:UNTC\s+)([IV]+-[0-9]+)$", lambda x: F.concat(F.lit("untc/"), F.upper(x))),
    (r"(?i)^(?:HUDOC\s+)?(001-[0-9]+)$", lambda x: F.concat(F.lit("dom/echr/"), x)),
    (r"(?i)^(ICC-\d+/\d+-\d+/\d+-\d+(?:-[A-Za-z0-9]+)*)$", lambda x: F.concat(F.lit("icc/"), F.translate(x, "/", "_"))),
    (r"(?i)^(?:ICJ\s+)?(\d{3}[-_]\d{8}[-_][A-Z]{3}[-_]\d{2}[-_]\d{2})(?:[-_](?:EN|FR|BI)C?)?(?:\.pdf)?$", lambda x: F.concat(F.lit("icj/"), F.upper(F.translate(x, "_", "-")))),
)
#: Names that stand for a part of a law.
PARTS = {"hyreslagen": "1970:994#K12"}


def _padded(digits: Column, width: int) -> Column:
    return F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def default_names(spark: SparkSession) -> DataFrame:
    """The names that the scanner knows."""
    known = [(n, "law", t) for n, t in {**C.LAWS, **C.ABBREVIATIONS, **PARTS}.items()] + [(n, "act", t) for n, t in C.ACTS.items()]
    known += [(n, "treaty" if t.startswith("coe/") else "act", t) for n, t in C.TREATIES.items()]
    return spark.createDataFrame(known, "name string, kind string, target string")


def pinpoint(text: Column) -> Column:
    """The fragment of "12:1", "12 kap. 1 a §", "1 § andra stycket" or "3", else NULL."""
    t = F.trim(F.regexp_replace(F.trim(text), r"\.+$", ""))
    colon, section = r"(?i)^(\d+):(\d+)\s*([a-z]?)$", r"(?i)^(?:(\d+\s?[a-z]?)\s+kap\.?\s+)?(\d+(?:\s?[a-z](?![a-z]))?)\s*(?:§|$)(?:\s*(\S+)\s+st(?:ycket|\.)?)?"
    pick = lambda p, i: F.nullif(F.regexp_replace(F.regexp_extract(t, p, i), r"\s", ""), F.lit(""))
    ordinal = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for n, word in U.ORDINALS.items() for x in (word, n)]), F.lower(pick(section, 3))), F.nullif(F.regexp_extract(pick(section, 3), r"^(\d+)$", 1), F.lit("")))
    whole = F.concat(F.coalesce(F.concat(F.lit("K"), pick(section, 1)), F.lit("")), F.lit("P"), pick(section, 2), F.coalesce(F.concat(F.lit("S"), ordinal), F.lit("")))
    return F.when(t.rlike(colon), F.concat(F.lit("K"), pick(colon, 1), F.lit("P"), pick(colon, 2), F.coalesce(F.lower(pick(colon, 3)), F.lit("")))).when(t.rlike(section), whole)


def _with_fragment(target: Column, fragment: Column) -> Column:
    return F.when(fragment.isNull() | (fragment == ""), target).otherwise(F.concat(target, F.lit("#"), fragment))


def named(queries: DataFrame, names: DataFrame) -> DataFrame:
    """``q, kind, target, rest``: the longest name of each kind that begins a query at a word boundary, and what follows it."""
    low = F.lower("q")
    ends = F.filter(F.sequence(F.lit(1), F.length("q")), lambda i: (i == F.length("q")) | ~F.substring(F.col("q"), i + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]"))
    prefixes = queries.where(F.length("q") > 0).select("q", F.explode(ends).alias("n")).select("q", "n", F.substring(low, F.lit(1), F.col("n")).alias("name"))
    hits = prefixes.join(names.select(F.lower("name").alias("name"), "kind", "target"), "name")
    best = hits.groupBy("q", "kind").agg(F.max(F.struct("n", "target")).alias("b"))
    return best.select("q", "kind", F.col("b.target").alias("target"), F.trim(F.substring(F.col("q"), F.col("b.n") + 1, F.length("q"))).alias("rest"))


def _from_names(found: DataFrame) -> DataFrame:
    """``q, rank, uri`` for the kinds of names, in the order of the resolvers."""
    rest, target = F.col("rest"), F.col("target")
    art, bare = F.regexp_extract(rest, ARTICLE, 1), F.regexp_extract(rest, BARE_ARTICLE, 1)
    number = F.when(art != "", art).otherwise(bare)
    part = F.when(art != "", F.regexp_extract(rest, ARTICLE, 2)).otherwise(F.regexp_extract(rest, BARE_ARTICLE, 2))
    recital = F.concat(F.regexp_extract(rest, RECITAL, 1), F.regexp_extract(rest, RECITAL, 2))
    eu = F.when(recital != "", F.concat(F.lit("recital-"), recital)).when(number != "", F.concat(number, F.when(part != "", F.concat(F.lit("."), part)).otherwise("")))
    treaty = F.when(number != "", F.concat(F.lit("A"), number, F.when(part != "", F.concat(F.lit("P"), part)).otherwise("")))
    uri = (
        F.when(F.col("kind") == "regulation", _with_fragment(target, pinpoint(rest)))
        .when((F.col("kind") == "treaty") & treaty.isNotNull(), _with_fragment(target, treaty))
        .when((F.col("kind") == "law") & target.contains("#"), F.when(rest == "", target))
        .when(F.col("kind") == "law", _with_fragment(target, pinpoint(rest)))
        .when(F.col("kind") == "act", _with_fragment(target, eu))
        .when((F.col("kind") == "case") & (rest == ""), target)
    )
    rank = F.array_position(F.array(*map(F.lit, ("regulation", "treaty", "law", "act", "eucase", "case"))), F.col("kind"))
    return found.select("q", rank.alias("rank"), uri.alias("uri")).where("uri is not null")


def _by_form() -> list[tuple[int, int, Column]]:
    """``(level, rank, identifier or NULL)`` of what the form of a query ``q`` tells."""
    q = F.col("q")
    itself = F.when(q.rlike(r"^(?:\d{4}:\d+|[a-z]+/[^ ]+)(?:#.*)?$") & (U.source_of(q) != "other") & ~q.rlike(SFS), q)
    law = F.when(q.rlike(SFS), _with_fragment(F.regexp_extract(q, SFS, 1), pinpoint(F.regexp_extract(q, SFS, 2))))
    year = F.regexp_extract(q, EU_CASE, 3)
    full = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 54, "20").otherwise("19"), year)).otherwise(year)
    number = F.regexp_extract(q, EU_CASE, 2).try_cast("int").cast("string")
    case = F.when(q.rlike(EU_CASE), F.concat(F.lit("celex/6"), full, F.upper(F.regexp_extract(q, EU_CASE, 1)), F.lit("J"), F.lpad(number, 4, "0")))
    listed = None
    for p, build in IDENTIFIERS:
        value = build(F.regexp_extract(q, p, 1))
        listed = F.when(q.rlike(p), value) if listed is None else listed.when(q.rlike(p), value)
    return [(0, 1, itself), (1, 1, L.page_query(q)), (2, 3, law), (2, 5, case), (3, 1, listed)]


def _instruments(found: DataFrame) -> DataFrame:
    """``q, rank, uri`` of instruments, alone or with an article."""
    number = F.regexp_extract("rest", ARTICLE, 1)
    uri = F.when(F.col("rest") == "", F.col("target")).when(number != "", F.concat("target", F.lit("#A"), number))
    return found.where("kind = 'instrument'").select("q", F.lit(2).cast("long").alias("rank"), uri.alias("uri")).where("uri is not null")


def resolve(queries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``query, ord, uri, source`` for each distinct non-empty query of column ``query``; one row for each identifier it may mean.

    Of the steps of the cascade, the first that knows a query answers it; the
    scanner reads what none does.
    """
    spark = queries.sparkSession
    asked = queries.select(F.trim("query").alias("q")).where("q <> ''").distinct()
    forms = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(rank).cast("long").alias("rank"), uri.alias("uri")) for level, rank, uri in _by_form()])
    direct = asked.select("q", F.explode(forms).alias("x")).select("q", "x.*").where("uri is not null")
    found = named(asked, default_names(spark) if names is None else names)
    known = direct.unionByName(_from_names(found).withColumn("level", F.lit(2))).unionByName(_instruments(found).withColumn("level", F.lit(3)))
    first = known.withColumn("least", F.min("level").over(Window.partitionBy("q"))).where("level = least")
    rest = asked.join(known.select("q"), "q", "left_anti").select(F.col("q").alias("doc_id"), F.col("q").alias("text"))
    scanned = C.extract(rest).select(F.col("doc_id").alias("q"), F.posexplode("refs").alias("i", "r")).select("q", (F.col("i") + 1).cast("long").alias("rank"), "r.uri")
    best = first.select("q", "rank", "uri").unionByName(scanned).groupBy("q", "uri").agg(F.min("rank").alias("rank"))
    order = F.row_number().over(Window.partitionBy("q").orderBy("rank", "uri"))
    return best.select(F.col("q").alias("query"), order.alias("ord"), "uri", U.source_of(F.col("uri")).alias("source"))
