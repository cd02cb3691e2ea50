"""Column functions over dialog and free text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_body(text: Column, tag: str) -> Column:
    """Trimmed body of the first <tag>...</tag>, any case, over lines; null if there is none or it is blank."""
    body = F.regexp_extract(text, rf"(?is)<{tag}>\s*(.+?)\s*</{tag}>", 1)
    return F.when(F.trim(body) != "", body)


def has_tag(text: Column, tag: str) -> Column:
    """Both marks occur, in this case and in any order."""
    return F.contains(text, F.lit(f"<{tag}>")) & F.contains(text, F.lit(f"</{tag}>"))


def letters(text: Column) -> Column:
    """ASCII letters alone, in upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def blocks(text: Column, tag: str) -> Column:
    """Bodies of all <tag>...</tag> in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))


def labelled_number(text: Column, label: str) -> Column:
    """The number after "label:", without marks that trail it; null if there is none."""
    found = F.regexp_extract(text, rf"{label}:\s*([-+0-9.eE,;:)]+)", 1)
    return F.rtrim(found, F.lit(".,;:)")).try_cast("double")


def after_last(text: Column, marker: str) -> Column:
    """What follows the last occurrence of marker, any case of ASCII letters; null without it."""
    low = F.lower(text)
    tail = F.length(F.substring_index(low, marker.lower(), -1))
    return F.when(F.contains(low, F.lit(marker.lower())), F.right(text, tail))


def before_first(text: Column, stops: list[str]) -> Column:
    """Up to the earliest of the stop marks."""
    at = [F.nullif(F.instr(text, s), F.lit(0)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def slug(text: Column, most: int = 64) -> Column:
    """Letters, digits, dots, dashes and underscores; other runs become one dash; never empty."""
    s = F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-")), F.lit("-"))
    return F.coalesce(F.nullif(F.left(s, F.lit(most)), F.lit("")), F.lit("unknown"))


def short_hash(text: Column, n: int = 8) -> Column:
    return F.left(F.sha2(text, 256), F.lit(n))


def shortened(text: Column, most: int, keep: int) -> Column:
    """Texts of over `most` characters end after `keep` with three dots."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(keep)), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    """Words of ASCII letters, digits, dashes and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_-]+"), F.lit(0))


def stem(word: Column) -> Column:
    """A lower-case English word without its endings: plural s, ies and es, then ing and ed where three letters or more, with a vowel, are left."""
    one = F.when(word.rlike("[^ae]ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
    one = one.when(word.rlike("(ss|x|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
    one = one.when(word.rlike("[^su]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.when(one.rlike("^[a-z]{3,}(ing|ed)$") & one.rlike("[aeiouy].*(ing|ed)$"), F.regexp_replace(one, "(ing|ed)$", "")).otherwise(one)


def stemmed(word: str) -> str:
    """What stem gives, for one word inside a task."""
    if word.endswith("ies") and len(word) > 4 and word[-4] not in "ae":
        word = word[:-3] + "y"
    elif word.endswith(("sses", "xes", "ches", "shes")):
        word = word[:-2]
    elif word.endswith("s") and len(word) > 3 and word[-2] not in "su":
        word = word[:-1]
    left = word[:-3] if word.endswith("ing") else word[:-2] if word.endswith("ed") else ""
    return left if len(left) > 2 and left.isascii() and left.isalpha() and any(c in "aeiouy" for c in left) else word


def keyword_match(text: Column, query: str) -> Column:
    """Space means and, a bar means or, quotes make a phrase, an empty query matches all; any case."""
    import re

    terms = re.findall(r'"[^"]+"|\S+', query)
    found = F.lit(True)
    for term in terms:
        ways = [w.strip('"') for w in (term.split("|") if not term.startswith('"') else [term])]
        any_of = F.lit(False)
        for w in filter(None, ways):
            any_of = any_of | F.contains(F.lower(text), F.lit(w.lower()))
        found = found & any_of
    return found


def py_literal_field(value: Column, field: str) -> Column:
    """A field of a JSON object or of its single-quoted form; null if it is neither."""
    loose = F.from_json(F.regexp_replace(F.regexp_replace(value, r"\bNone\b", "null"), r"\bTrue\b", "true"), f"{field} STRING", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(F.get_json_object(value, f"$.{field}"), loose[field])


def numbered_block(text: Column) -> Column:
    """The lines from the first to the last one that holds a number and a dot; null without any."""
    lines = F.split(text, "\n")
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\d+\."), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.array_join(F.slice(lines, F.array_min(at) + 1, F.array_max(at) - F.array_min(at) + 1), "\n"))


def tail_stripped(text: Column) -> Column:
    """Without what follows a trailing ", 'role..." and without quotes, brackets and white space at the end; written line feeds become real ones."""
    t = F.regexp_replace(text, r"""(?is),\s*['"]role.*$""", "")
    return F.regexp_replace(F.replace(t, F.lit("\\n"), F.lit("\n")), r"""['"\]\}\s]+$""", "")


def requirement(text: Column, marker: str) -> Column:
    """What follows the last marker, else the numbered lines, else the whole text; each without its tail."""
    after = after_last(text, marker)
    return F.coalesce(*[F.nullif(F.trim(tail_stripped(c)), F.lit("")) for c in (F.coalesce(numbered_block(after), after), numbered_block(text), text)])


def keyword_parts(text: Column) -> Column:
    """Parts between commas and semicolons (also full-width ones) and the whole text, each once whatever its case, in order."""
    parts = F.concat(F.transform(F.split(text, "[,，;；]"), lambda x: F.trim(x)), F.array(F.trim(text)))
    parts = F.filter(parts, lambda x: x != "")
    low = F.transform(parts, lambda x: F.lower(x))
    return F.filter(parts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def query_tokens(text: Column, stop: list[str]) -> Column:
    """Different tokens of three characters or more that are no stop words and not digits alone, the most telling first:
    those with marks, digits or capitals before plain ones, longer before shorter, else in their order."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9\-()+./]+"), F.lit(0))
    kept = F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(stop) & ~t.rlike("^[0-9]+$")))
    keyed = F.transform(kept, lambda t, i: F.struct((~t.rlike(r"[\-()+0-9A-Z]")).alias("plain"), (-F.length(t)).alias("size"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def ec_numbers(text: Column) -> Column:
    """Enzyme class numbers after "EC", once each, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"EC[ :=]*([0-9]+(?:\.[0-9]+){1,3})"), F.lit(1)))


def is_ec(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^\d+(\.\d+)*$"), F.lit(False))


def accession_list(text: Column) -> Column:
    return F.filter(F.split(text, r"[;,\s]+"), lambda x: x != "")


def flag(value: Column) -> Column:
    """A number's truth, or whether there is any text that is none."""
    return F.coalesce(value.try_cast("int") != 0, F.coalesce(value != "", F.lit(False)))


def prefixed(text: Column, prefix: str) -> Column:
    return F.when(F.ltrim(text).startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def contains_all(text: Column, tokens: Column) -> Column:
    return F.forall(tokens, lambda t: F.contains(F.lower(text), F.lower(t)))


def query_variants(full: Column, terms: Column) -> Column:
    """Queries from strict to loose as structs (label, query): the phrase, the first 5, 4 and 3 terms together, then 4, 3 and 2 where
    there are more, any of the first ten, and any of the first twelve runs of three, then two, neighbours."""
    n = F.size(terms)
    row = lambda when, label, query: F.when(when, F.struct(F.lit(label).alias("label"), query.alias("query")))
    first = lambda k: F.array_join(F.slice(terms, 1, k), " ")
    starts = lambda size: F.when(n >= size, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    runs = F.concat(*[F.transform(starts(size), lambda i: F.array_join(F.slice(terms, i, F.lit(size)), " ")) for size in (3, 2)])  # noqa: B023
    rows = [row(full != "", "Q1_full_phrase", F.concat(F.lit('"'), full, F.lit('"')))]
    rows += [row(n >= k, f"Q2_and_top{k}", first(k)) for k in (5, 4, 3)] + [row(k < F.least(F.lit(5), n), f"Q3_and_{k}", first(k)) for k in (4, 3, 2)]
    rows += [row(n > 0, "Q4_or_top", F.array_join(F.slice(terms, F.lit(1), F.least(F.lit(10), F.greatest(F.lit(6), n))), " OR ")), row(n > 1, "Q5_ngram_or", F.array_join(F.slice(runs, 1, 12), " OR "))]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())
