"""Chains from a text to one document of rules: the text is split, each part gives fragments in a fixed order, and these fold into one.

All of it is column code over one row, so nothing is shuffled, and a row's result depends on that row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import design as D
from ..functions import entries as E
from . import constraints as C
from . import sequences as Q

RULES = "array<struct<kind:string,first:int,last:int,what:string,value:double>>"
FRAGMENT = f"struct<allow:array<string>,forbid:array<string>,rules:{RULES},motifs:array<string>,most_cys:int>"
TEXTS = "array<string>"


def parts_of(text: Column) -> Column:
    """The parts of a text between commas and semicolons, white space made plain, empty ones left out; none of a null."""
    plain = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(plain, lambda x: x != "")


def auto_class(key: Column) -> Column:
    """The exemplars whose weak rules a class, or the name of what has no class, takes; null for none."""
    k = F.lower(key)
    loop = k.contains("ntp") | k.contains("atp") | k.contains("gtp")
    return F.when(k.isin("nadp", "nad", "flavin", "fmn", "fad"), "auto_nad").when(loop, "auto_atp_gtp").when(k.contains("phosphate"), "auto_phosphate")


def rule_table() -> Column:
    """The stated rules of each class, in their order, as a map."""
    by: dict[str, list[Column]] = {}
    for class_, kind, place, what, value, divisor in D.RULES:
        by.setdefault(class_, []).append(F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), F.lit(what).alias("what"), F.lit(value).alias("value"), F.lit(divisor).alias("divisor")))
    return F.create_map(*[x for class_, rows in by.items() for x in (F.lit(class_), F.array(*rows))])


def placed(rules: Column, spans: Column, length: Column) -> Column:
    """Rules with a place, at each span (first, last) in turn, then those for the whole. A span is written with its smaller end first;
    the whole goes from 1 to the length, of an empty sequence from 1 to 0."""

    def at(r, s):
        share = F.greatest(F.lit(1), F.floor((s["last"] - s["first"] + 1) / r["divisor"]).cast("int")).cast("double")
        return F.struct(r["kind"].alias("kind"), s["first"].alias("first"), s["last"].alias("last"), r["what"].alias("what"), F.when(r["divisor"] > 0, share).otherwise(r["value"]).alias("value"))

    of = lambda place, where: F.flatten(F.transform(where, lambda s: F.transform(F.filter(rules, lambda r: r["place"] == place), lambda r: at(r, s))))
    ordered = F.transform(spans, lambda s: F.struct(F.least(s["first"], s["last"]).cast("int").alias("first"), F.greatest(s["first"], s["last"]).cast("int").alias("last")))
    whole = F.array(F.struct(F.lit(1).alias("first"), length.cast("int").alias("last")))
    return F.concat(of("span", ordered), of("whole", whole)).cast(RULES)


def named(rules: Column, kind: str) -> Column:
    return F.transform(F.filter(rules, lambda r: r["kind"] == kind), lambda r: r["what"])


def fragment(allow: Column, forbid: Column, rules: Column, motifs: Column, most_cys: Column) -> Column:
    """One fragment; null lists are empty."""
    given = ((allow, TEXTS, "allow"), (forbid, TEXTS, "forbid"), (rules, RULES, "rules"), (motifs, TEXTS, "motifs"))
    return F.struct(*[F.coalesce(c, F.array().cast(t)).cast(t).alias(n) for c, t, n in given], most_cys.cast("int").alias("most_cys")).cast(FRAGMENT)


def folded(fragments: Column) -> dict[str, Column]:
    """Fragments in order as one document: lists united, each entry where it first occurs; the bound is the first writer's."""
    united = lambda name: F.array_distinct(F.flatten(F.transform(fragments, lambda x: x[name])))
    return {c: united(c) for c in ("allow", "forbid", "rules", "motifs")} | {"most_cys": F.try_element_at(F.filter(F.transform(fragments, lambda x: x["most_cys"]), lambda v: v.isNotNull()), F.lit(1))}


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column whose value is made once a row; a projection may be merged into lambdas, which make it once a call."""
    kept = [F.col(c) for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def cofactor_documents(rows: DataFrame, key: str, sequence: Column, text: Column, locked: Column, base: Column, index: list[tuple[str, str]], win: int = 16, step: int = 4) -> DataFrame:
    """One document of rules for each row: key, n_parts, the folded fields, and what is known of the last part.

    Each part of the text names a class; the class (unless a motif gives it) takes the best window of `win` letters that avoids
    the locked positions (from 0). A part gives up to four fragments: the rules of its class in that window; those of the
    motifs of `index` (pattern, description) found in the sequence; the motifs that the part asks for; weak rules of exemplars. They
    fold after `base`, a fragment or null. Of the meta fields the last writer's stay, `overlap` only where it is not 0.
    A null sequence is empty, a text without parts leaves the base alone.
    """
    item = lambda x: F.element_at(F.transform(F.array(x[0]), x[1]), 1)  # noqa: E731  a value that is made once
    told = F.array(*[F.lit(t) for _, t in index])
    r = rows.select(key, F.coalesce(sequence, F.lit("")).alias("seq"), F.coalesce(locked, F.array().cast("array<int>")).alias("locked"), base.alias("base"), parts_of(text).alias("texts"))
    r = once(r.withColumn("n", F.length("seq")), "found", Q.longest_spans(Q.pattern_spans(F.col("seq"), [p for p, _ in index])))
    r = once(once(r, "around", Q.widened(F.col("found"), F.col("n"), win)), "kept", F.array_distinct(F.transform("found", lambda x: x["pattern"])))
    desire = lambda c: F.coalesce(*[F.when(c == name, letters) for name, letters in D.DESIRES.items()], F.lit(""))

    def part(t):
        return item((E.first_class(t, E.COFACTOR_RULES, "unknown"), lambda c: F.struct(t.alias("text"), c.alias("class"), desire(c).alias("desire"), F.when(c == "unknown", t).otherwise(c).alias("key"), Q.text_hits(t, index).alias("asked"))))

    r = once(r, "parts", F.transform("texts", part))
    # A window is looked for once a desire, not once a part.
    r = once(r, "desires", F.array_distinct(F.transform(F.filter("parts", lambda p: ~p["class"].isin(*D.WITHOUT_WINDOW)), lambda p: p["desire"])))
    r = once(r, "windows", C.best_windows(F.col("seq"), win, step, F.col("desires"), F.col("locked")))
    r = once(r, "best", F.map_from_arrays("desires", "windows"))
    place = lambda b: F.struct((b["start"] + 1).cast("int").alias("first"), (b["start"] + win).cast("int").alias("last"), b["overlap"].alias("overlap"))
    span = lambda p: F.when(~p["class"].isin(*D.WITHOUT_WINDOW), item((F.try_element_at(F.col("best"), p["desire"]), place)))
    r = once(r, "parts", F.transform("parts", lambda p: F.struct(p.alias("p"), span(p).alias("span"))))
    r = once(r.drop("windows"), "by_class", rule_table())
    rules_of = lambda c: F.coalesce(F.try_element_at(F.col("by_class"), c), F.slice(F.col("by_class")["auto"], 1, 0))
    weak, no_motif, most = F.array(*[F.lit(x[3]) for x in D.RULES if x[:2] == ("auto", "regex_forbid")]), F.array(F.lit("")), F.lit(D.MOST_CYS)

    def fragments(x):
        p, at = x["p"], F.filter(F.array(F.struct(x["span"]["first"].alias("first"), x["span"]["last"].alias("last"))), lambda s: s["first"].isNotNull())

        def hand(rules):
            cys = F.try_element_at(F.transform(F.filter(rules, lambda r: r["kind"] == "max_cys"), lambda r: r["value"].cast("int")), F.lit(1))
            motifs = named(rules, "motif")
            return fragment(named(rules, "regex_allow"), named(rules, "regex_forbid"), placed(rules, at, F.col("n")), F.when(F.size(motifs) > 0, motifs).otherwise(no_motif), F.coalesce(cys, most))

        def auto(rules):
            return fragment(named(rules, "regex_allow"), F.concat(weak, named(rules, "regex_forbid")), placed(rules, at, F.col("n")), no_motif, most)

        pool = F.concat_ws(" ", p["text"], F.transform("found", lambda h: F.element_at(told, h["i"] + 1)))
        scan_rules = rules_of(auto_class(E.first_class(pool, E.PATTERN_TEXT_RULES, "unknown")))
        scan = item((scan_rules, lambda rules: fragment(F.col("kept"), weak, placed(rules, F.slice(F.concat(at, F.col("around")), 1, 3), F.col("n")), no_motif, most)))
        asked = p["asked"]
        text_mode = fragment(F.array_distinct(F.transform(asked, lambda h: h["pattern"])), weak, F.lit(None), F.array(D.consensus(F.try_element_at(asked, F.lit(1))["pattern"])), most)
        of = F.array(item((rules_of(p["class"]), hand)), F.when(F.size("found") > 0, scan), F.when(F.size(asked) > 0, text_mode), item((rules_of(auto_class(p["key"])), auto)))
        return F.filter(of, lambda f: f.isNotNull())

    r = once(r, "fragments", F.concat(F.filter(F.array(F.col("base").cast(FRAGMENT)), lambda b: b.isNotNull()), F.flatten(F.transform("parts", fragments))))
    last = F.try_element_at(F.col("parts"), F.lit(-1))
    overlaps = F.filter(F.transform("parts", lambda x: x["span"]["overlap"]), lambda v: v > 0)
    asked = F.filter(F.transform("parts", lambda x: F.size(x["p"]["asked"])), lambda v: v > 0)
    meta = {
        "detected": last["p"]["class"], "first": last["span"]["first"], "last": last["span"]["last"], "overlap": F.try_element_at(overlaps, F.lit(-1)),
        "auto_key": last["p"]["key"], "auto_used": auto_class(last["p"]["key"]).isNotNull(), "found": F.nullif(F.size("found"), F.lit(0)), "asked": F.try_element_at(asked, F.lit(-1)),
    }
    known = lambda c, v: F.when(F.size("parts") > 0, v).alias(c)
    return r.select(key, F.size("parts").alias("n_parts"), *[v.alias(c) for c, v in folded(F.col("fragments")).items()], *[known(c, v) for c, v in meta.items()])
