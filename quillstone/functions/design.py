"""Column functions over design rules: patterns as plain letters, forbidden patterns, insertion points, failed calls, masks for training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seq import ALPHABET

# Patterns that have a word list of their own, and letters tried in place of an A.
PATTERN_WORDS = {"YXXL": ["YQRL", "YQTL", "YNRL", "YSQL", "YKNL"], "YXXF": ["YQRL", "YQTL", "YNRL", "YSQL", "YKNL"], "PXXP": ["PAAP", "PTPP", "PVVP"]}
REPLACEMENTS = ["Q", "N", "S", "T", "G"]

# Rules by class: what is wanted where (the span, the whole sequence, or no place), with its bound or weight.
# A count of 0 stands for the span's length over the divisor, 1 at least.
RULES = [
    *[r for c in ("mg", "mn") for r in [
        (c, "regex_allow", "any", r"^(?!.*C.{0,3}C)(?!.*H.{0,2}H).*$", 0.0, 0), (c, "regex_forbid", "any", "[KR]{5,}", 0.0, 0), (c, "regex_forbid", "any", "H{5,}", 0.0, 0),
        (c, "prefer", "span", "DE", 0.35, 0), (c, "prefer", "span", "AST", 0.10, 0), (c, "min_count", "span", "DE", 3.0, 0), (c, "max_charge", "span", "", -2.0, 0)]],
    ("ca", "regex_allow", "any", r"^(?!.*C.{0,3}C)(?!.*H.{0,2}H).*$", 0.0, 0), ("ca", "prefer", "span", "GSTA", 0.2, 0), ("ca", "min_count", "span", "DE", 2.0, 0),
    *[r for c in ("zn", "ni", "cu") for r in [
        (c, "regex_allow", "any", "C.{2,4}C", 0.0, 0), (c, "regex_allow", "any", "H.{2,5}H", 0.0, 0), (c, "regex_allow", "any", "C.{2,4}H", 0.0, 0), (c, "regex_allow", "any", "H.{2,4}C", 0.0, 0),
        (c, "regex_forbid", "any", "[DE]{4,}", 0.0, 0), (c, "prefer", "span", "CH", 0.35, 0)]],
    ("fe_s", "regex_allow", "any", "C.{2}C", 0.0, 0), ("fe_s", "regex_allow", "any", "C.{3}C", 0.0, 0), ("fe_s", "regex_allow", "any", "C.{2,4}C.{2,4}C", 0.0, 0), ("fe_s", "max_cys", "any", "", 12.0, 0),
    ("heme_c", "motif", "any", "CXXCH", 0.0, 0), ("heme_c", "prefer", "whole", "FWY", 0.2, 0),
    ("heme_b", "regex_allow", "any", "H", 0.0, 0), ("heme_b", "regex_allow", "any", "C", 0.0, 0), ("heme_b", "prefer", "whole", "FWY", 0.2, 0),
    ("atp_gtp", "regex_forbid", "any", "[DE]{4,}", 0.0, 0), ("atp_gtp", "prefer", "span", "G", 0.25, 0), ("atp_gtp", "prefer", "span", "KST", 0.20, 0),
    *[r for c in ("nad", "flavin") for r in [(c, "regex_allow", "any", "G.{1,2}GG.{1,2}G", 0.0, 0), (c, "prefer", "span", "GAS", 0.2, 0)]],
    ("plp", "regex_allow", "any", "K", 0.0, 0), ("plp", "regex_forbid", "any", "[DE]{3,}", 0.0, 0), ("plp", "prefer", "span", "ASTG", 0.15, 0),
    ("sam", "prefer", "span", "FWY", 0.15, 0), ("sam", "prefer", "span", "GAS", 0.10, 0),
    *[(c, "prefer", "span", "GAS", 0.1, 0) for c in ("biotin", "tpp", "coa")],
    # Weak rules by kind of pocket.
    *[("auto", "regex_forbid", "any", p, 0.0, 0) for p in ("[KR]{6,}", "[DE]{6,}", "C.{0,3}C")],
    *[r for c, kd, weak in (("auto_nad", 0.8, ["[TASV][AG].{1,2}G.{1,2}G"]), ("auto_atp_gtp", 0.9, ["GxxxxGKS", "[STAG].{1,2}G.{1,2}G"]), ("auto_phosphate", 1.0, ["G.{1,4}G.{0,2}[KR]"])) for r in [
        (c, "min_count", "span", "KR", 0.0, 14), (c, "min_charge", "span", "", 1.0, 0), (c, "max_charge", "span", "", 8.0, 0), (c, "min_count", "span", "G", 0.0, 12),
        (c, "max_hydropathy", "span", "", kd, 0), (c, "max_hydropathy", "whole", "", kd, 0), *[(c, "regex_allow", "any", w, 0.0, 0) for w in weak]]],
    *[(c, "regex_forbid", "any", "[DE]{4,}", 0.0, 0) for c in ("auto_nad", "auto_atp_gtp")],
]
# The letters that a class wants in its window; classes that are given by a motif have none.
DESIRES = {"mg": "DE", "mn": "DE", "ca": "DE", "zn": "CH", "ni": "CH", "cu": "CH", "fe_s": "C", "heme_c": "C", "heme_b": "FWY", "atp_gtp": "G", "nad": "G", "flavin": "G", "plp": "K", "sam": "FWY", "biotin": "GAS", "tpp": "GAS", "coa": "GAS"}
WITHOUT_WINDOW = ["heme_c", "fe_s"]
MOST_CYS = 10
RULE_COLUMNS = "class string, kind string, place string, what string, value double, divisor int"

# What is said of a call that failed, by kind of tool and with or without its main argument.
SCAFFOLD_TOOLS = {"function2seq": "text", "pathway2seq": "pathway", "dna_binding2seq": "text", "domain2seq": "domain", "go2seq": "go_term"}
CONSTRAINT_TOOLS = {"motif2constraints": "motif", "cofactor2constraints": "cofactor", "signal2constraints": None}
FAILED = {
    "scaffold": ("Round {r}: scaffold-generation tool '{t}' was called with {k}=\"{v}\", but this call did not retrieve any candidate sequences, so no new sequences were scored in this round.", "Round {r}: scaffold-generation tool '{t}' was called, but it did not retrieve any candidate sequences, so no new sequences were scored in this round."),
    "constraint": ("Round {r}: constraint tool '{t}' was called with {k}=\"{v}\", but it could not produce usable constrained designs, so no new constrained sequences were scored in this round.", "Round {r}: constraint tool '{t}' was called, but it could not produce usable constrained designs, so no new constrained sequences were scored in this round."),
    "other": ("", "Round {r}: tool '{t}' failed with the current arguments, and no new sequences were scored in this round."),
}


def consensus(pattern: Column, most: int = 12) -> Column:
    """A pattern as one run of letters: the first of a class, X for any letter, counts written out, other marks left out; never empty."""
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?:\[[^\]]+\]|\w|\.)\{\d+\}|\[[^\]]+\]|(?s:.)"), F.lit(0))

    def plain(t):
        unit = F.regexp_extract(t, r"^(.+)\{\d+\}$", 1)
        letter = F.when(unit.rlike(r"^\[[^\]]{1,}\]$"), F.substring(unit, 2, 1)).when(unit.rlike("^[A-Za-z]$"), unit).otherwise(F.lit("X"))
        count = F.least(F.lit(most), F.regexp_extract(t, r"\{(\d+)\}$", 1).try_cast("int"))
        return F.when(unit != "", F.repeat(letter, count)).when(t.rlike(r"^\[[A-Z]+\]$"), F.substring(t, 2, 1)).otherwise(t)

    run = F.regexp_replace(F.translate(F.array_join(F.transform(pieces, plain), ""), ".x", "XX"), r"[()|?+^${}]", "")
    return F.coalesce(F.nullif(F.left(F.trim(run), F.lit(most)), F.lit("")), F.lit("XXX"))


def forbidden(sequence: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [sequence.rlike(p) for p in patterns], F.lit(False))


def instantiated(pattern: Column, patterns: list[str]) -> Column:
    """A pattern with wild letters as real ones, and no forbidden pattern in it if a listed word or one other letter for an A allows."""
    p = F.upper(F.trim(F.coalesce(pattern, F.lit(""))))
    filled = F.regexp_replace(F.translate(p, "Φ", "L"), f"[^{ALPHABET}]", "A")
    words = F.array().cast("array<string>")
    for name, listed in PATTERN_WORDS.items():
        words = F.when(p == name, F.array(*[F.lit(w) for w in listed])).otherwise(words)

    def repaired(s):
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substring(s, i, F.lit(1)) == "A")
        tried = F.flatten(F.transform(at, lambda i: F.array(*[F.overlay(s, F.lit(r), i, F.lit(1)) for r in REPLACEMENTS])))
        return F.coalesce(F.try_element_at(F.filter(tried, lambda x: ~forbidden(x, patterns)), F.lit(1)), s)

    first_word = F.try_element_at(F.filter(words, lambda w: ~forbidden(w, patterns)), F.lit(1))
    return F.coalesce(first_word, F.when(~forbidden(filled, patterns), filled), repaired(filled))


def last_repair(sequence: Column, patterns: list[str]) -> Column:
    """A sequence with a forbidden pattern in it, with the last A that helps replaced by the first letter that does; as it is if none helps."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(sequence), F.lit(1))), lambda i: F.substring(sequence, i, F.lit(1)) == "A")
    tried = F.flatten(F.transform(at, lambda i: F.slice(F.filter(F.array(*[F.overlay(sequence, F.lit(r), i, F.lit(1)) for r in REPLACEMENTS]), lambda x: ~forbidden(x, patterns)), 1, 1)))
    return F.when(forbidden(sequence, patterns), F.coalesce(F.try_element_at(tried, F.lit(-1)), sequence)).otherwise(sequence)


def insertion_point(points: Column, locked_runs: Column, motif_cost, flank_cost, weight: float = 0.25) -> Column:
    """before (from 1) and score of the allowed point with the least motif cost + weight * flank cost, the first of equals; none inside a locked run (start, end)."""
    free = F.filter(points, lambda p: ~F.exists(locked_runs, lambda x: (x["start"] < p) & (p <= x["end"])))
    return F.array_min(F.transform(free, lambda p: F.struct(F.round(motif_cost(p) + F.lit(weight) * flank_cost(p), 6).alias("score"), p.alias("before"))))


def most_violating(letters: Column, masked: Column, worst: Column, share: float) -> Column:
    """Of the masked positions (from 1) the share, one at least, that violates most: 2 for a base, 1 for no acid, 1 in a worst span (start, end); the last of equals first."""
    score = lambda p, c: F.when(c.isin("K", "R", "H"), 2).otherwise(0) + F.when(c.isin("D", "E"), 0).otherwise(1) + F.when(F.exists(worst, lambda x: (p >= x["start"]) & (p <= x["end"])), 1).otherwise(0)
    rows = F.sort_array(F.zip_with(masked, letters, lambda p, c: F.struct(score(p, c).alias("score"), p.alias("p"))), asc=False)
    return F.transform(F.slice(rows, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(masked) * share).cast("int"))), lambda x: x["p"])


def failed_call(tool: Column, round_: Column, argument: Column, best: Column, accession: Column) -> Column:
    """What is told of a call without new candidates: the tool, its main argument (cut to 120 characters), the best score so far, a summary."""
    short = F.when(F.length(F.trim(argument)) > 120, F.concat(F.left(F.trim(argument), F.lit(117)), F.lit("..."))).otherwise(F.trim(argument))
    keys = {t: k for t, k in (SCAFFOLD_TOOLS | CONSTRAINT_TOOLS).items() if k}
    key = F.coalesce(*[F.when(tool == t, k) for t, k in keys.items()], F.lit(None).cast("string"))
    value = F.when(key.isNotNull(), short)
    fill = lambda text: reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), (("r", round_.cast("string")), ("t", tool), ("k", F.coalesce(key, F.lit(""))), ("v", F.coalesce(value, F.lit("")))), F.lit(text))
    said = lambda kind: F.when(value.isNotNull(), fill(FAILED[kind][0])).otherwise(fill(FAILED[kind][1]))
    first = F.when(tool.isin(*SCAFFOLD_TOOLS), said("scaffold")).when(tool.isin(*CONSTRAINT_TOOLS), said("constraint")).otherwise(said("other"))
    score = F.format_string("%.3f", best)
    known = lambda text, *c: F.when(best.isNotNull(), F.concat(F.lit(text), *c))
    return F.concat_ws(
        "\n",
        F.concat(first, F.coalesce(known(" Global best ProTrek remains ", score, F.lit(".")), F.lit(""))),
        F.lit("Summary:"), F.concat(F.lit("- round: "), round_.cast("string")), F.concat(F.lit("- tool: "), tool), F.lit("- num_sequences_scored: 0"),
        known("- global_best_ProTrek: ", score), known("- prev_global_best_ProTrek: ", score), F.lit("- delta_best: +0.000"),
        F.when(value.isNotNull(), F.concat(F.lit("- argument_"), key, F.lit(": "), value)), F.when(accession != "", F.concat(F.lit("- current_best_accession: "), accession)),
    )


def training_mask(tokens: Column, key: Column, seed: int, share: float, mask: str, vocabulary: list[str]) -> Column:
    """Tokens for masked training: of a share, drawn by the key, the seed and the place, 8 in 10 become the mask, 1 a drawn word, 1 stays; structs (token, chosen)."""
    drawn = lambda i, n: F.conv(F.substring(F.md5(F.concat_ws("|", key, i.cast("string"), F.lit(str(seed + n)))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    words = F.array(*[F.lit(w) for w in vocabulary])

    def one(t, i):
        u = drawn(i, 0)
        other = F.element_at(words, F.floor(drawn(i, 1) * len(vocabulary)).cast("int") + 1)
        return F.struct(F.when(u < share * 0.8, F.lit(mask)).when((u >= share * 0.8) & (u < share * 0.9), other).otherwise(t).alias("token"), (u < share).alias("chosen"))

    return F.transform(tokens, one)


def loss_mask(turns: Column, length: int) -> dict[str, Column]:
    """Of a dialog's turns (role, tokens), in order: tokens with a header and an end for each turn, and 1 for what an assistant says, its end included;
    both cut and padded to the length."""
    whole = F.flatten(F.transform(turns, lambda t: F.concat(F.array(F.concat(F.lit("<"), t["role"], F.lit(">"))), t["tokens"], F.array(F.lit("<end>")))))
    mask = F.flatten(F.transform(turns, lambda t: F.concat(F.array(F.lit(0)), F.array_repeat(F.when(t["role"] == "assistant", 1).otherwise(0), F.size(t["tokens"]) + 1))))
    padded = lambda a, v: F.concat(F.slice(a, 1, length), F.array_repeat(F.lit(v), F.greatest(F.lit(0), length - F.size(a))))
    return {"tokens": padded(whole, "<pad>"), "mask": padded(mask, 0), "n_tokens": F.size(whole)}


MOTIFS = "array<struct<sequence: string, left_linker: string, right_linker: string, flank_k: int, alpha: double, beta: double, forbid_overlap_locked: boolean>>"


def motif_list(json: Column) -> Column:
    """A motif, a list of motifs or nothing, in JSON, as a list with every field filled in."""
    t = F.trim(json)
    read = F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).when(t.startswith("["), t), MOTIFS)
    default = {"sequence": "", "left_linker": "", "right_linker": "", "flank_k": 8, "alpha": 1.0, "beta": 0.25, "forbid_overlap_locked": True}
    members = F.filter(F.coalesce(read, F.array().cast(MOTIFS)), lambda m: m.isNotNull())
    return F.transform(members, lambda m: F.struct(*[F.coalesce(m[k], F.lit(v)).alias(k) for k, v in default.items()]))


def restored(text: Column) -> Column:
    """JSON text that may be missing in several spellings, or broken; null then."""
    return F.when(F.lower(F.trim(text)).isin("", "nan", "none", "null"), None).otherwise(F.when(F.get_json_object(text, "$").isNotNull(), text))


def id_link(identifier: Column, database: Column) -> Column:
    """An identifier as a link into its database; as it is where there is none."""
    link = lambda base, i: F.concat(F.lit("["), identifier, F.lit(f"]({base}"), i, F.lit(")"))
    return (
        F.when(database.isin("UniRef50", "Uncharacterized", "Swiss-Prot", "Baker's yeast"), link("https://www.uniprot.org/uniprotkb/", identifier))
        .when(database == "PDB", link("https://www.rcsb.org/structure/", F.substring_index(identifier, "-", 1)))
        .when(database == "NCBI", link("https://www.ncbi.nlm.nih.gov/protein/", identifier))
        .otherwise(identifier)
    )
