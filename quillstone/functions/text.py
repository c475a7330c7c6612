"""Text expressions: normalisation, tokens, sentences, claims, premises.

All are built-in expressions, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PARAGRAPH = ""
MARK = ""

# Swedish stop words of the overlap score.
STOP_WORDS = "och att det den de en ett i på av för med som till är har om inte kan ska skall se enligt vid från eller detta denna dessa".split()

# Words that negate, and pairs of opposites.
NEGATIONS = ["inte", "ej", "icke", "aldrig", "saknas", "utesluter"]
OPPOSITES = [
    ("direkt", "indirekt"),
    ("positiva", "negativa"),
    ("giltig", "ogiltig"),
    ("tillåten", "otillåten"),
    ("tillåtet", "otillåtet"),
    ("förbjuden", "tillåten"),
    ("förbjudet", "tillåtet"),
    ("ringa", "grovt"),
    ("ringa", "allvarligt"),
    ("högre", "lägre"),
    ("före", "efter"),
    ("mindre", "mer"),
    ("utan", "med"),
    ("skyldighet", "rättighet"),
]

# Abbreviations whose dots end no sentence.
ABBREVIATIONS = (
    "t.ex. bl.a. dvs. d.v.s. t.o.m. fr.o.m. st. kap. prop. bet. mot. p. punkten. nr. s. ff. m.fl. avs. a.a. a.prop. a.st. "
    "NJA. RH. HFD. RÅ. AD. MD. MÖD. MIG. f.d. ord. reg. dir. skr."
).split()

# Verb forms by which a text counts as a statement.
VERBS = (
    "är var vara har hade ska skall kan får måste gäller gällde ansvarar kräver innebär utgör blir blev ger anges sägs framgår står fann ansåg ogillade biföll "
    "hindrar fälls medför följer saknar förutsätter skulle bör borde döms dömas dömde dömdes omfattar omfattas avser avses krävs finner anser bedömer bedömde "
    "avslog avslår bifaller undanröjde undanröjer fastställde fastställer ogillar ogillas konstaterade uttalade tillåter hindrade påför påförs påförde påfördes "
    "påföra föreligger uppkommer betalas upphör förbjuder räknas ersätts tillämpas prövas prövade beviljas meddelas träder finns fanns kommer kom utgår utgick "
    "ingår ingick bortfaller åligger utdöma utdöms utdömdes fastställa bifalla ogilla stadgar stadgas föreskriver föreskrivs skiner heter menar påstår hävdar "
    "visar gör gjorde vet visste känner ser såg lämnar lämnade förlorar sker skedde åberopar betalar svarar erhåller uppstår äger innehar utövar löper börjar "
    "upphörde inträder inträffar tillkommer förfaller avbryts avgör avgörs beslutar lyder behöver behövs väcks väcker överklagar begär yrkar åtar åtog åtagit "
    "ådrar svarade ansvarade förlorade förpliktar förpliktas befriar befrias fritar befogenhet förvärvar förvärvas övergår återgår jämkas"
).split()


def whitespace(text: Column) -> Column:
    """Runs with more than one line end become a paragraph break, other runs one space; \\r\\n counts once."""
    one = F.regexp_replace(text, r"\r\n?", "\n")
    two = F.regexp_replace(one, r"\s*\n\s*\n\s*", PARAGRAPH)
    return F.regexp_replace(F.regexp_replace(two, r"\s+", " "), PARAGRAPH, "\n\n")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_fingerprint(text: Column) -> Column:
    return F.sha2(collapsed(text), 256)


def short_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12)


def plain_markdown(text: Column) -> Column:
    """Markdown without images, link targets, tags and marks."""
    no_images = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    no_links = F.regexp_replace(no_images, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(no_links, r"<[^>]*>", ""), r"[*_`#]", ""))


def plain_server_markdown(text: Column) -> Column:
    """Markdown without headings, links, quote marks, emphasis, escapes; three line ends or more become two."""
    steps = [
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^[ \t]*(?:#{1,6}|>)[ \t]?", ""),
        (r"(?U)\*\*|__|(?<!\w)[*_](?=\S)|(?<=\S)[*_](?!\w)", ""),
        (r"\\([\\`*_{}\[\]()#+\-.!>])", "$1"),
        (r"\n{3,}", "\n\n"),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def plain_html(html: Column) -> Column:
    no_code = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    return collapsed(F.regexp_replace(no_code, r"<[^>]*>", " "))


def tokens(text: Column, mode: str = "letter_digit") -> Column:
    """Lower-case tokens: runs of letters or of digits, or runs of word characters with ``mode='word'``."""
    pattern = {"letter_digit": r"\p{L}+|\d+", "word": r"[\p{L}\p{M}\p{N}_]+"}[mode]
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def content_words(text: Column) -> Column:
    """Words of three letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(plain_markdown(text)), F.lit(r"\p{L}{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def overlap_score(terms: Column, passage: Column, quoted: Column | None = None) -> Column:
    """Distinct shared terms over the root of the passage's distinct tokens; a quotation adds 100."""
    distinct = F.array_distinct(passage)
    score = F.size(F.array_intersect(terms, passage)) / F.sqrt(F.greatest(F.size(distinct), F.lit(1)).cast("double"))
    return score if quoted is None else score + F.when(quoted, 100.0).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """About 1.35 tokens a word, and five."""
    return (F.floor(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) * F.lit(1.35).cast("double")) + 5).cast("int")


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens <= 512, "<=512").when(tokens <= 2048, "513-2048").when(tokens <= 4096, "2049-4096").otherwise("4097-8192")


def sentences_simple(text: Column) -> Column:
    """Cut behind . ! ? and white space."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + MARK), MARK)


def sentences(text: Column) -> Column:
    """Cut behind . ! ? and white space before a capital letter, but not behind an abbreviation; blank ones go."""
    known = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
    # a mark behind an abbreviation keeps its last dot from ending a sentence
    masked = F.regexp_replace(text, rf"(?iU)\b(?:{known})", "$0" + MARK)
    pieces = F.split(masked, rf"(?<=[.!?])\s+(?=[A-ZÅÄÖ])")
    return F.filter(F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, MARK, ""))), lambda x: x != "")


def citation_only(text: Column) -> Column:
    """Nothing is left but reference wording."""
    no_phrase = F.regexp_replace(text, r"(?iu)(?<!\p{L})(?:detta|det)\s+följer\s+(?:även\s+|också\s+)?(?:av|enligt)(?!\p{L})", "")
    no_signal = F.regexp_replace(no_phrase, r"(?iu)(?<!\p{L})(?:se|jfr|även|bl|a|t|ex|och)(?!\p{L})", "")
    return F.regexp_replace(no_signal, r"[^\p{L}\p{N}]", "") == ""


def refers_back(text: Column) -> Column:
    """The sentence leans on the one before it, impersonal openings apart."""
    leans = text.rlike(r"(?iu)^(?:han|hon)(?!\p{L})|^(?:detta|det|den|de)\s+(?:är|var|ska|kan|gäller|följer|innebär)(?!\p{L})")
    impersonal = text.rlike(r"(?iu)^det\s+(?:är|var|ska|kan|bör|måste)\s+(?:\p{L}+\s+){0,2}att(?!\p{L})")
    return leans & ~impersonal


VERB_PATTERN = r"(?iu)(?:^|[^\p{L}\p{N}_])(?:" + "|".join(VERBS) + r"|[\p{L}\p{N}_]{3,}(?:as|ade|ades))(?:$|[^\p{L}\p{N}_])"
# Statements that cannot be judged.
CATEGORY_ERRORS = [
    r"(?iu)(?:(?<![\p{L}\p{N}_])\d+\s*§|(?<!\p{L})(?:lagen|balken|avtalslagen|handelsbalken|brottsbalken|skadeståndslagen)(?!\p{L})).*(?:dömde|dömer|dömt|dömd|fällde|fällt)\s+.*\s+(?:till\s+fängelse|till\s+böter|till\s+påföljd)",
    r"(?iu)(?:tingsrätten|hovrätten|högsta\s+domstolen|hd|hfd)\s+är\s+ett?\s+(?:mord|dråp|brott|stöld)",
    r"(?iu)personskada\s+som\s+ska\s+ersätta\s+sig\s+själv",
]


def assessable(claim: Column) -> Column:
    """``struct(ok, reason)``: the first reason why a claim can't be judged: empty, unreadable, no_statement, category_error."""
    clean = F.trim(claim)
    words = F.size(F.regexp_extract_all(clean, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    wrong = clean.rlike(CATEGORY_ERRORS[0]) | clean.rlike(CATEGORY_ERRORS[1]) | clean.rlike(CATEGORY_ERRORS[2])
    reason = (
        F.when(clean == "", "empty")
        .when(clean.rlike("<[^>]+>|�"), "unreadable")
        .when((words < 3) | ~clean.rlike(VERB_PATTERN), "no_statement")
        .when(wrong, "category_error")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def clean_claim(claim: Column) -> Column:
    """A complete statement of its own: long enough, begins like one, no headers or inner citations, no loose end."""
    return (
        (F.length(claim) >= 35)
        & claim.rlike("^[0-9A-ZÅÄÖ]")
        & ~claim.rlike(r"(?iu)(?:^|[^\p{L}\p{N}_])(?:sid\s*\d+|slutligt beslut|tingsrätt|hovrätt|mål\s*nr|aktbil|protokoll)(?:$|[^\p{L}\p{N}_])")
        & ~claim.rlike(r"(?iu)\((?:se|jfr)(?:$|[^\p{L}\p{N}_])")
        & (F.size(F.regexp_extract_all(claim, F.lit(r"\S+"), F.lit(0))) >= 6)
        & ~claim.rlike(r"(?iu)(?:^|[^\p{L}\p{N}_])(?:och|eller|att|som|om|av|på|i|för|med)\s*$")
    )


def polarity_flip(a: Column, b: Column) -> Column:
    """A negation came or went between two texts, or a word turned into its opposite."""
    x, y = F.array_distinct(tokens(a, "word")), F.array_distinct(tokens(b, "word"))
    negations = F.array(*map(F.lit, NEGATIONS))
    moved = F.arrays_overlap(F.array_except(x, y), negations) | F.arrays_overlap(F.array_except(y, x), negations)
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in OPPOSITES])
    opposite = F.exists(pairs, lambda o: (F.array_contains(x, o["p"]) & F.array_contains(y, o["q"])) | (F.array_contains(x, o["q"]) & F.array_contains(y, o["p"])))
    return moved | opposite


def premise(sources: Column) -> Column:
    """``[Källa i: citation]`` and the text of each source, blank lines between."""
    one = F.transform(sources, lambda s, i: F.concat(F.lit("[Källa "), (i + 1).cast("string"), F.lit(": "), s["citation"], F.lit("]\n"), F.trim(s["text"])))
    return F.array_join(one, "\n\n")


def header_variants(citation: Column, unit_type: Column, text: Column) -> Column:
    """The premise of one source under three headers: as written, by unit type, generic."""
    heads = F.array(citation, unit_type, F.lit("källa"))
    return F.transform(heads, lambda h, i: F.struct(i.alias("variant"), F.concat(F.lit("[Källa 1: "), h, F.lit("]\n"), F.trim(text)).alias("premise")))


def cut_dissent(text: Column) -> Column:
    """The paragraphs before the first, other than the opening one, that announces a dissent in its first 150 characters."""
    parts = F.split(text, r"\n\s*\n")
    marks = F.transform(parts, lambda p, i: (i > 0) & F.substring(p, 1, 150).rlike(r"(?iu)skiljaktig|tillägg|särskilt yttrande"))
    at = F.array_position(marks, True).cast("int")
    return F.array_join(F.when(at > 0, F.slice(parts, F.lit(1), at - 1)).otherwise(parts), "\n\n")


def paragraph_range(text: Column) -> Column:
    """Numbers of "p. 7–9" (ten at most apart) or "p. 42 och 45"."""
    span = r"(\d+)\s*[–-]\s*(\d+)"
    low, high = F.regexp_extract(text, span, 1), F.regexp_extract(text, span, 2)
    ranged = (low != "") & (F.length(low) < 9) & (F.length(high) < 9)
    a, b = F.when(ranged, low).cast("int"), F.when(ranged, high).cast("int")
    single = F.transform(F.regexp_extract_all(text, F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("int"))
    return F.when(ranged & (b >= a) & (b - a <= 10), F.sequence(a, F.greatest(a, b))).otherwise(single)
