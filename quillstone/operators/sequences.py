"""Operators over sequences that have no built-in form: repeats, fuzzy ratios, alignments, spans of patterns."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import seq as S


@F.pandas_udf(ArrayType(IntegerType()))
def letter_counts(sequences: pd.Series) -> pd.Series:
    """How often each of A to Z occurs in a sequence of capitals: one count of (row, letter) over the whole batch."""
    rows = [(x or "").encode() for x in sequences]
    letters = np.frombuffer(b"".join(rows), np.uint8)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    known = (letters >= 65) & (letters < 91)
    counts = np.bincount(row[known] * 26 + (letters[known] - np.uint8(65)), minlength=26 * len(rows))
    return pd.Series(list(counts.reshape(-1, 26).astype(np.int32)))


@F.pandas_udf(StructType([StructField("n_kmers", LongType()), StructField("entropy", DoubleType())]))
def pair_entropy(sequences: pd.Series) -> pd.DataFrame:
    """Distinct overlapping pairs of letters and the entropy -sum p ln(p + 1e-9) of their shares, over the whole batch at once.

    0 and null for a sequence of under two letters or null.
    """
    rows = [x or "" for x in sequences]
    size = np.array([len(x) for x in rows], np.int64)
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    inside = row[1:] == row[:-1]  # no pair reaches over a border
    pairs, n = np.unique((row[:-1] << 42 | codes[:-1] << 21 | codes[1:])[inside], return_counts=True)
    of = pairs >> 42
    share = n / np.maximum(size - 1, 1)[of]
    kinds = np.bincount(of, minlength=len(rows))
    entropy = np.bincount(of, -share * np.log(share + 1e-9), minlength=len(rows))
    return pd.DataFrame({"n_kmers": kinds, "entropy": pd.Series(entropy).mask(kinds == 0)})


def tandem_shares(sequences: list[str | None], longest: int = 20, copies: int = 3) -> np.ndarray:
    """Each sequence's share of letters in tandem repeats: at least `copies` equal neighbours of 1 to `longest` letters.

    All sequences lie end to end, with a letter of its own before each, and are held against themselves once a shift.
    """
    size = np.array([len(x or "") for x in sequences], np.int64)
    begin = np.cumsum(size + longest) - size  # as many foreign letters between two as the longest shift
    whole = -np.arange(1, int((size + longest).sum()) + 1, dtype=np.int32)  # no two alike, so nothing repeats over a border
    inside = np.zeros(len(whole) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + size, -1)
    inside = np.cumsum(inside)[:-1] > 0
    whole[inside] = np.frombuffer("".join(x or "" for x in sequences).encode("utf-32-le"), np.int32)
    covered = np.zeros(len(whole) + 1, np.int32)
    for w in range(1, longest + 1):
        # A stretch of k letters that equal those w before is k // w + 1 whole copies of some unit.
        edge = np.diff(np.concatenate([[0], (whole[w:] == whole[:-w]).view(np.int8), [0]]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        enough = stop - start >= (copies - 1) * w
        # Stretches of one shift do not overlap, but one's last copy may reach into the next.
        np.add.at(covered, start[enough], 1)
        np.add.at(covered, stop[enough] + w, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    return (hit[begin + size] - hit[begin]) / np.maximum(size, 1)


@F.pandas_udf(DoubleType())
def repeat_fraction(sequences: pd.Series) -> pd.Series:
    out, rows, at = [], sequences.tolist(), 0
    while at < len(rows):  # a few million letters at a time
        to, letters = at, 0
        while to < len(rows) and letters < 4_000_000:
            letters += len(rows[to] or "")
            to += 1
        out.append(tandem_shares(rows[at:to]))
        at = to
    return pd.Series(np.concatenate(out) if out else np.zeros(0))


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched letters over all letters, by longest matching blocks; any case. Null where either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)])


def local_identity_of(a: str, b: str) -> float:
    """Most matches that a common subsequence can have, over the shorter length (match 1, mismatch and gap 0).

    A row of the table is one whole number with a bit for each place of the longer text, 0 where the row grows, so a letter
    of the shorter text takes a few operations on whole numbers and memory is one row.
    """
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    codes = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), np.uint32)
    masks = {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(short)}
    whole = row = (1 << len(long)) - 1
    for c in short:
        met = row & masks[c]
        if met:
            row = ((row + met) | (row - met)) & whole
    return (len(long) - row.bit_count()) / len(short)


@F.pandas_udf(DoubleType())
def local_identity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else local_identity_of(x, y) for x, y in zip(a, b)])


SPANS = "array<struct<i:int,pattern:string,s:int,e:int>>"


def _places(i: int, pattern: str):
    def step(x, y):
        s, e = x["at"] + y["g"], x["at"] + y["g"] + y["m"]
        one = F.array(F.struct(F.lit(i).alias("i"), F.lit(pattern).alias("pattern"), s.alias("s"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(y["m"] > 0, F.concat(x["out"], one)).otherwise(x["out"]).alias("out"))

    def of(parts):
        # An empty match at the very start has no piece before it.
        pieces = F.when(F.size(parts["g"]) == F.size(parts["m"]), F.concat(F.array(F.lit("")), parts["g"])).otherwise(parts["g"])
        lengths = F.zip_with(parts["m"], pieces, lambda m, g: F.struct(F.coalesce(F.length(m), F.lit(0)).alias("m"), F.coalesce(F.length(g), F.lit(0)).alias("g")))
        return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")), step, lambda x: x["out"])

    return of


def pattern_spans(sequence: Column, patterns: list[str]) -> Column:
    """All places of the patterns in a sequence: an array of (place of the pattern in the list, pattern, s, e).

    Spans are half-open, in order, not empty, and do not overlap within a pattern. A pattern's matches and the pieces between
    them alternate, so their lengths add up to the places; all stays in the JVM. Patterns that do not compile are left
    out, once and on the driver; a null sequence has no places.
    """
    sequence, found = F.coalesce(sequence, F.lit("")), []
    for i, p in enumerate(patterns):
        try:
            re.compile(p)
        except re.error:
            continue
        parts = F.struct(F.regexp_extract_all(sequence, F.lit(p), F.lit(0)).alias("m"), F.split(sequence, p, -1).alias("g"))
        found.append(F.element_at(F.transform(F.array(parts), _places(i, p)), 1))  # the parts are made once
    return F.concat(*found) if found else F.array().cast(SPANS)


def longest_spans(spans: Column, most: int = 5) -> Column:
    """The `most` longest spans of pattern_spans, the longest first; of equal ones the earlier pattern's, then the earlier place."""
    keyed = F.transform(spans, lambda x: F.struct((x["s"] - x["e"]).alias("order"), x["i"].alias("i"), x["s"].alias("s"), x["e"].alias("e"), x["pattern"].alias("pattern")))
    return F.slice(F.array_sort(keyed), 1, most)


def widened(spans: Column, length: Column, win: int) -> Column:
    """Spans as (first, last), from 1 and inclusive, at least `win` letters wide around their middle, inside the sequence."""

    def one(x):
        wide = F.greatest(F.lit(win), x["e"] - x["s"])
        first = F.greatest(F.lit(1), F.floor((x["s"] + 1 + x["e"]) / 2).cast("int") - F.floor(wide / 2).cast("int"))
        return F.struct(first.alias("first"), F.least(length, first + wide - 1).alias("last"))

    return F.transform(spans, one)


def text_hits(hint: Column, index: list[tuple[str, str]], most: int = 3) -> Column:
    """Of a fixed list of (pattern, description) the `most` that a text asks for: an array of (order, i, score, pattern, told), the best first.

    5 if the whole text occurs in the description, and 1 for each of its words that does, repeats included, in any case. Records without a
    pattern or without a score are left out; of equal scores the earlier record comes first. A null text is empty, and an empty
    text occurs in every description.
    """

    def of(q):
        rows = []
        for i, (pattern, told) in enumerate(index):
            if pattern:
                words = sorted(set(re.findall("[a-z0-9]+", told.lower())))
                score = F.when(F.contains(F.lit(told.lower()), q["low"]), 5).otherwise(0) + F.size(F.filter(q["words"], lambda w: w.isin(words)))
                rows.append(F.struct((-score).alias("order"), F.lit(i).alias("i"), score.alias("score"), F.lit(pattern).alias("pattern"), F.lit(told).alias("told")))
        return F.slice(F.array_sort(F.filter(F.array(*rows), lambda x: x["score"] > 0)), 1, most)

    low = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    # The words that any description has are found once, in one pass.
    known = "|".join(sorted({w for _, told in index for w in re.findall("[a-z0-9]+", told.lower())})) or "(?!)"
    text = F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(f"(?<![a-z0-9])(?:{known})(?![a-z0-9])"), F.lit(0)).alias("words"))
    return F.element_at(F.transform(F.array(text), of), 1)


def exemplars(rows: DataFrame, group: str, sequence: str, letters: dict[str, str]) -> DataFrame:
    """One row for each group: n, and for each name the share of its letters in all sequences of the group (null without letters)."""
    n = F.sum(F.length(sequence))
    return rows.groupBy(group).agg(F.count("*").alias("n"), *[F.round(F.sum(S.count_letters(F.col(sequence), x)) / F.when(n > 0, n), 6).alias(name) for name, x in letters.items()])


def shortest_match(pattern: str) -> str:
    """A short string that a simple pattern (letters, classes, dots, counts, groups, branches) matches: the first branch, the first listed letter."""
    import re._parser as parser

    def of(items) -> str:
        out = ""
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(value)
            elif name == "NOT_LITERAL":
                out += next(c for c in "ACDEFGHIKLMNPQRSTVWY" if ord(c) != value)
            elif name == "ANY":
                out += "A"
            elif name == "IN":
                negate = str(value[0][0]) == "NEGATE"
                listed = [chr(k) for kind, v in value[negate:] for k in (range(v[0], v[1] + 1) if str(kind) == "RANGE" else [v] if str(kind) == "LITERAL" else [])]
                out += next(c for c in "ACDEFGHIKLMNPQRSTVWY" if c not in listed) if negate else listed[0]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += of(value[2]) * value[0]
            elif name == "SUBPATTERN":
                out += of(value[3])
            elif name == "BRANCH":
                out += of(value[1][0])
        return out

    return of(parser.parse(pattern))


@F.pandas_udf(StringType())
def shortest_matches(patterns: pd.Series) -> pd.Series:
    """shortest_match of each pattern; null where it is null or does not compile."""

    def of(p):
        try:
            return None if p is None else shortest_match(p)
        except re.error:
            return None

    return patterns.map(of).astype(object)
