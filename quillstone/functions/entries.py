"""Column functions over annotated entries: feature lists, mixed lists of texts and objects, classes of cofactors, codes; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules for a cofactor's name; the first that matches gives the class.
COFACTOR_RULES = [
    ("mg", r"\bmg(2\+)?\b|magnesium"),
    ("mn", r"\bmn(2\+)?\b|manganese"),
    ("ca", r"\bca(2\+)?\b|calcium"),
    ("zn", r"\bzn(2\+)?\b|zinc"),
    ("ni", r"\bni(2\+)?\b|nickel"),
    ("cu", r"\bcu(2\+)?\b|copper"),
    ("fe_s", r"\bfe[-\s]*s\b|\b2fe-2s\b|\b4fe-4s\b"),
    ("heme_c", r"\bheme[-\s_]*c\b"),
    ("heme_b", r"\bheme([- \_]b)?\b|\bhaem\b"),
    ("atp_gtp", r"\batp|gtp|ntp\b"),
    ("nad", r"\bnadp?\+?\b"),
    ("flavin", r"\bflavin|fad|fmn\b"),
    ("plp", r"\bplp|pyridoxal\b"),
    ("sam", r"\bsam|s-adenosylmethionine\b"),
    ("biotin", r"\bbiotin\b"),
    ("tpp", r"\btpp\b|thiamine pyrophosphate"),
    ("coa", r"\bcoenzyme\s*a\b|\bcoa\b"),
]

# Ordered rules for the description of a pattern.
PATTERN_TEXT_RULES = [
    ("heme_b", r"heme|haem"),
    ("heme_c", r"cxxch|cytochrome"),
    ("zn", r"\bzn\b|zinc|cys2his2"),
    ("mg", r"\bmg\b|magnesium"),
    ("ca", r"\bca2?\+\b|calcium|ef-hand"),
    ("nad", r"\bnadp?\b|nadph"),
    ("atp_gtp", r"\batp\b|\bgtp\b|\bntp\b|p-loop"),
    ("flavin", r"flavin|fad|fmn"),
    ("plp", r"plp|pyridoxal"),
    ("biotin", r"biotin"),
    ("fe_s", r"iron[- ]sulfur|fe-s"),
    ("sam", r"sam|s-adenosyl"),
    ("coa", r"coenzyme a|coa"),
]

# Words that name a cofactor, in order.
COFACTOR_WORDS = "FAD FMN NAD NADH NADP NADPH SAM ATP ADP GTP MG MG2+ MN MN2+ ZN ZN2+ HEME HEM PLP TPP BIOTIN FE-S FE2S2 FE4S4 CU CU2+".split()

# A bucket's name and the feature types, without spaces and hyphens, that go into it.
BUCKETS = {
    "binding_sites": ["BINDINGSITE", "BINDING", "BINDING_SITE"],
    "metal_binding": ["METAL", "METALBINDING", "METAL_BINDING"],
    "active_sites": ["ACT_SITE", "ACTIVESITE", "ACTIVE_SITE"],
    "motifs": ["MOTIF"],
    "domains": ["DOMAIN"],
    "regions": ["REGION"],
}


def first_class(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first rule found in the text, whatever its case and white space."""

    def of(low):
        return F.coalesce(*[F.when(low.rlike(rule), name) for name, rule in rules], F.lit(otherwise))

    # The plain form of a text is made once, not once a rule.
    return F.element_at(F.transform(F.array(F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " "))), of), 1)


def cofactor_words(text: Column) -> Column:
    """The listed words that occur anywhere in the text, whatever its case, in the list's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(w) for w in COFACTOR_WORDS]), lambda w: F.contains(low, F.lower(w)))


def search_phrase(text: Column) -> Column:
    """The first clause, of letters, digits, blanks and -+() alone, with a star at its end; empty if nothing is left."""
    head = F.regexp_replace(F.element_at(F.split(text, r"[，,;；。.]", 2), 1), r"[^0-9A-Za-z \-+()]", " ")
    head = F.trim(F.regexp_replace(head, r"\s+", " "))
    return F.when(head != "", F.concat(head, F.lit("*"))).otherwise("")


def all_ecs(text: Column) -> Column:
    """Enzyme classes, those after "EC" first, then bare ones of four fields (the last may be a dash) or three; once each."""
    named = F.regexp_extract_all(text, F.lit(r"(?i)EC[\s:]*(\d+(?:\.\d+){0,3}(?:\.-?)?)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d+\.\d+\.\d+(?:\.\d+|-))(?!\d)"), F.lit(1))
    return F.array_distinct(F.concat(named, bare))


def reaction_sides(equation: Column) -> Column:
    """Both sides' compounds, in order; blanks around them go."""
    return F.filter(F.transform(F.split(equation, r"[=+]"), lambda x: F.trim(x)), lambda x: x != "")


def location(json: Column) -> Column:
    """start and end of a place: one position, or the values of its start and end, or its begin and end; null where none is a number."""
    read = F.from_json(json, "position struct<value: string>, start struct<value: string>, begin string, end string")

    def ends(x):
        one = x["position"]["value"].try_cast("int")
        last = F.when(x["end"].startswith("{"), F.get_json_object(x["end"], "$.value")).otherwise(x["end"])
        return F.struct(F.coalesce(one, x["start"]["value"].try_cast("int"), x["begin"].try_cast("int")).alias("start"), F.coalesce(one, last.try_cast("int")).alias("end"))

    return F.element_at(F.transform(F.array(read), ends), 1)


def bucketed(features: Column) -> dict[str, Column]:
    """Features (structs with a type) by bucket; an empty bucket is null."""
    out = {}
    for name, types in BUCKETS.items():
        kept = F.filter(features, lambda f: F.upper(F.translate(f["type"], " -", "")).isin(types))  # noqa: B023
        out[name] = F.when(F.size(kept) > 0, kept)
    return out


def gathered(top: dict[str, Column], key_sites: dict[str, Column]) -> Column:
    """One list of the spans of binding sites (key sites alone), active sites, motifs, domains and regions; metal sites stay out."""
    lists = [key_sites.get("binding_sites")] + [c for n in ("active_sites", "motifs", "domains", "regions") for c in (top.get(n), key_sites.get(n))]
    lists = [c for c in lists if c is not None]
    return F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))


def half_open(spans: Column, length: Column) -> Column:
    """Spans (start, end), from 1 and inclusive, as (s, e) from 0 within the length; ends in the wrong order are swapped, open ones left out."""
    known = F.filter(spans, lambda x: x["start"].isNotNull() & x["end"].isNotNull())
    cut = F.transform(known, lambda x: F.struct((F.greatest(F.least(x["start"], x["end"]), F.lit(1)) - 1).alias("s"), F.least(F.greatest(x["start"], x["end"]), length).alias("e")))
    return F.filter(cut, lambda x: x["s"] < x["e"])


TEXTS, COMMENTS = "array<string>", "array<struct<commentType: string, cofactors: array<struct<cofactor: struct<name: string>>>, text: string, value: string, texts: array<string>, reaction: struct<rheaId: string>>>"
ENTRY = "entryType string, " + "".join(f"{f} {TEXTS}, " for f in "ec ecNumbers keywords go_p go_f goTerms cc_cofactor cc_pathway cc_catalytic_activity".split()) + f"comments {COMMENTS}"


def _list(values: Column, kind: str = TEXTS) -> Column:
    return F.coalesce(values, F.array().cast(kind))


def texts_of(values: Column, *fields: str) -> Column:
    """A list whose members are texts or objects (read as JSON text) as texts; of an object, the first of the fields that it has."""
    read = lambda x: F.when(~x.startswith("{"), x).otherwise(F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{f}"), F.lit("")) for f in fields]))
    return F.filter(F.transform(_list(values), read), lambda x: x.isNotNull())


def collected(entry: Column) -> dict[str, Column]:
    """Of an entry read as ENTRY: enzyme classes, keywords, terms, cofactors (in capitals), pathways, reactions and functions."""
    comments = _list(entry["comments"], COMMENTS)
    of = lambda kind: F.filter(comments, lambda c: c["commentType"] == kind)
    named = F.flatten(F.transform(of("COFACTOR"), lambda c: _list(F.transform(c["cofactors"], lambda x: x["cofactor"]["name"]))))
    said = F.flatten(F.transform(of("PATHWAY"), lambda c: _text_or_list(F.coalesce(F.nullif(c["text"], F.lit("")), c["value"]))))
    flat = F.flatten(F.transform(_list(entry["cc_catalytic_activity"]), lambda x: F.regexp_extract_all(F.upper(x), F.lit(r"RHEA:(\d+)"), F.lit(1))))
    rhea = F.filter(F.transform(of("CATALYTIC_ACTIVITY"), lambda c: c["reaction"]["rheaId"]), lambda x: x.isNotNull() & (x != ""))
    functions = F.flatten(F.transform(of("FUNCTION"), lambda c: texts_of(c["texts"], "value", "text")))
    present = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    return {
        "ecs": texts_of(F.coalesce(_filled(entry["ec"]), entry["ecNumbers"]), "value", "id"),
        "keywords": texts_of(entry["keywords"], "name", "value"),
        "terms": F.concat(*[texts_of(entry[f], "term", "name", "id") for f in ("go_p", "go_f", "goTerms")]),
        "cofactors": F.transform(F.concat(texts_of(entry["cc_cofactor"], "value", "name"), present(named)), lambda x: F.upper(x)),
        "pathways": F.concat(texts_of(entry["cc_pathway"], "value", "name"), present(said)),
        "reactions": F.concat(flat, rhea),
        "functions": functions,
    }


def _filled(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _text_or_list(text: Column) -> Column:
    """A text, or the members of a list of texts and objects."""
    return F.when(text.startswith("["), texts_of(F.from_json(text, "array<string>"), "value", "text")).otherwise(F.array(text))


def int_keys(entries: Column) -> Column:
    """A map of texts with those keys that are whole numbers, as numbers."""
    kept = F.filter(F.map_entries(entries), lambda e: F.trim(e["key"]).rlike(r"^[-+]?\d+$"))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(F.trim(e["key"]).cast("int").alias("key"), e["value"].alias("value"))))


def code(number: Column, letters: str, size: int) -> Column:
    """The number's place among `size` codes of equal length in the letters' order; any other number is a hash mark."""
    length = 1
    while size > len(letters) ** length:
        length += 1
    digit = lambda p: F.substring(F.lit(letters), (F.floor(number / len(letters) ** p) % len(letters)).cast("int") + 1, F.lit(1))
    return F.when((number >= 0) & (number < size), F.concat(*[digit(p) for p in range(length - 1, -1, -1)])).otherwise("#")


def interleaved(letters: Column, structure: Column, confidence: Column, least: float) -> Column:
    """Each letter and its structure letter in lower case, a hash mark where the confidence is under the least; three arrays of one length."""
    marked = F.zip_with(structure, confidence, lambda b, c: F.when(c < least, F.lit("#")).otherwise(F.lower(b)))
    return F.array_join(F.zip_with(letters, marked, lambda a, b: F.concat(a, b)), "")


def keep_mask(sequence: Column, spans: list[tuple[int, int]], patterns: list[str]) -> Column:
    """The sequence as marks: # in the spans (half-open, from 0) and at every occurrence of a pattern, also overlapping ones, else a dot."""
    ways = [f"(?<={re.escape(p[:j])}){re.escape(p[j])}(?={re.escape(p[j + 1:])})" for p in patterns for j in range(len(p))]
    mask = F.regexp_replace(F.regexp_replace(sequence, "|".join(ways), "#"), "[^#]", ".") if ways else F.regexp_replace(sequence, ".", ".")
    for s, e in spans:
        inside = F.greatest(F.lit(0), F.least(F.lit(e), F.length(sequence)) - s)
        mask = F.when(inside > 0, F.concat(F.left(mask, F.lit(s)), F.repeat(F.lit("#"), inside), F.substring(mask, s + inside + 1, F.length(sequence)))).otherwise(mask)
    return mask
