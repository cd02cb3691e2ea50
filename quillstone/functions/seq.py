"""Column functions over one-letter sequences and their intervals (half-open, from 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty standard letters.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
# Hydropathy of each letter (Kyte and Doolittle, 1982).
HYDROPATHY = dict(A=1.8, R=-4.5, N=-3.5, D=-3.5, C=2.5, Q=-3.5, E=-3.5, G=-0.4, H=-3.2, I=4.5, L=3.8, K=-3.9, M=1.9, F=2.8, P=-1.6, S=-0.8, T=-0.7, W=-0.9, Y=-1.3, V=4.2)


def clean(sequence: Column) -> Column:
    return F.upper(F.regexp_replace(sequence, r"\s+", ""))


def is_valid(sequence: Column) -> Column:
    """Not empty and of the twenty letters alone; null counts as invalid."""
    return F.coalesce(sequence.rlike(f"^[{ALPHABET}]+$"), F.lit(False))


def restricted(sequence: Column) -> Column:
    return F.regexp_replace(F.upper(sequence), f"[^{ALPHABET}]", "")


def count_letters(sequence: Column, letters: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def charge(sequence: Column) -> Column:
    return count_letters(sequence, "KRH") - count_letters(sequence, "DE")


def mean_hydropathy(sequence: Column) -> Column:
    """Null for an empty sequence."""
    total = sum((count_letters(sequence, k) * F.lit(v) for k, v in HYDROPATHY.items()), F.lit(0.0))
    return F.when(F.length(sequence) > 0, total / F.length(sequence))


def of_counts(counts: Column, letters: str) -> Column:
    """Letters in a histogram of A to Z."""
    return sum((counts[ord(x) - 65] for x in letters), F.lit(0))


def hydropathy_of(counts: Column) -> Column:
    return sum((counts[ord(k) - 65] * F.lit(v) for k, v in HYDROPATHY.items()), F.lit(0.0))


def longest_run(sequence: Column) -> Column:
    """Of one letter repeated; 0 for an empty sequence."""
    runs = F.transform(F.regexp_extract_all(sequence, F.lit(r"((.)\2*)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def validity_reason(sequence: Column, shortest: int, longest: int, run: int) -> Column:
    n = F.length(sequence)
    return F.when(~is_valid(sequence), "alphabet").when(n < shortest, "short").when(n > longest, "long").when(longest_run(sequence) > run, "run").otherwise("ok")


def windows(length: Column, size: int, step: int) -> Column:
    """Starts of sliding windows; a sequence shorter than one has one window."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), length - size), F.lit(step))


def merged(intervals: Column, gap: int = 0) -> Column:
    """An array of structs (s, e), half-open, as disjoint ones in order; those at most `gap` apart are joined."""
    empty = F.slice(F.array_sort(intervals), 1, 0)

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (x["s"] <= F.try_element_at(done, F.lit(-1))["e"] + gap), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(intervals), empty, step)


def covered(intervals: Column) -> Column:
    """Total length of disjoint intervals."""
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])


def insert_at(sequence: Column, position: Column, part: Column) -> Column:
    """part before the letter at position (from 0)."""
    return F.concat(F.substring(sequence, F.lit(1), position), part, F.substring(sequence, position + 1, F.length(sequence)))


def shifted(positions: Column, at: Column, by: Column) -> Column:
    """Positions after an insertion of `by` letters at `at`."""
    return F.transform(positions, lambda p: F.when(p < at, p).otherwise(p + by))


def locks(sequence: Column, intervals: Column) -> Column:
    """Map from each position in the intervals, cut to the sequence, to its letter."""
    inside = F.filter(F.transform(intervals, lambda x: F.struct(F.greatest(x["s"], F.lit(0)).alias("s"), F.least(x["e"], F.length(sequence)).alias("e"))), lambda x: x["s"] < x["e"])
    positions = F.array_distinct(F.flatten(F.transform(inside, lambda x: F.sequence(x["s"], x["e"] - 1))))
    return F.map_from_arrays(positions, F.transform(positions, lambda p: F.substring(sequence, p + 1, F.lit(1))))


def pattern_to_regex(pattern: Column) -> Column:
    """A PROSITE pattern as a regular expression."""
    p = F.rtrim(F.regexp_replace(pattern, r"\s+", ""), F.lit("."))
    for old, new in ((r"\{([A-Z]+)\}", "[^$1]"), (r"\(([0-9]+)(?:,([0-9]+))\)", "{$1,$2}"), (r"\(([0-9]+)\)", "{$1}"), ("x", "."), ("<", "^"), (">", "\\$"), ("-", "")):
        p = F.regexp_replace(p, old, new)
    return p
