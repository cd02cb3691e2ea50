"""Rules over spans of sequences, and documents of such rules."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S


def allowed(sequence: Column, allow: list[str], forbid: list[str]) -> Column:
    """Any allowed pattern (none: all pass) and no forbidden one."""
    any_of = reduce(lambda a, b: a | b, [sequence.rlike(p) for p in allow]) if allow else F.lit(True)
    none_of = reduce(lambda a, b: a | b, [sequence.rlike(p) for p in forbid]) if forbid else F.lit(False)
    return any_of & ~none_of


def _span(sequence: Column, first: int, last: int) -> Column:
    """Letters first to last (from 1, inclusive), in either order, cut to the sequence."""
    a, b = min(first, last), max(first, last)
    return F.substring(sequence, max(a, 1), max(0, b - max(a, 1) + 1))


def min_count_ok(sequence: Column, rules: list[tuple[int, int, str, int]]) -> Column:
    """Each rule (first, last, letters, n): the span has at least n of the letters."""
    return reduce(lambda a, b: a & b, [S.count_letters(_span(sequence, f, t), letters) >= n for f, t, letters, n in rules], F.lit(True))


def charge_ok(sequence: Column, rules: list[tuple[int, int, int | None, int | None]]) -> Column:
    """Each rule (first, last, low, high): the span's charge lies between; either bound may be open."""
    out = F.lit(True)
    for first, last, low, high in rules:
        c = S.charge(_span(sequence, first, last))
        out = out & (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
    return out


def soft_penalty(sequence: Column, max_cys: int, charges: tuple[int, int], max_run: int, forbidden: list[str]) -> Column:
    """Cysteines, charge and runs beyond their bounds, and one for each forbidden string that occurs."""
    low, high = charges
    c = S.charge(sequence)
    over = F.greatest(F.lit(0), S.count_letters(sequence, "C") - max_cys) + F.greatest(F.lit(0), F.lit(low) - c) + F.greatest(F.lit(0), c - high)
    over = over + F.greatest(F.lit(0), S.longest_run(sequence) - max_run)
    return over + sum((F.contains(sequence, F.lit(w)).cast("int") for w in forbidden), F.lit(0))


def window_score(window: Column, size: int, desire: str) -> Column:
    """Lower is better: the share of desired letters, of glycine and proline, the longest run, and the net charge as far as the desire
    (DE; CH or FWY) minds it. A window that is too short is worst."""
    share = lambda letters: S.count_letters(window, letters) / F.lit(float(size)) if letters else F.lit(0.0)
    c = S.charge(window)
    unwanted = -F.least(F.lit(0), c) if desire == "DE" else F.greatest(F.lit(0), -c) if desire in ("CH", "FWY") else F.lit(0)
    score = F.lit(0.8) - share(desire) + 0.3 * share("PG") + 0.3 * S.longest_run(window) / float(size) + 0.2 * unwanted
    return F.when(F.length(window) < size, F.lit(1e9)).otherwise(F.round(score, 6))


def window_texts(sequence: Column, size: int, step: int) -> Column:
    """The letters of each sliding window, put together from pieces of `step` letters, so that a long sequence is walked once."""
    pieces = F.regexp_extract_all(sequence, F.lit(f".{{1,{step}}}"), F.lit(0))
    out = pieces
    for j in range(1, -(-size // step)):
        out = F.zip_with(out, F.slice(pieces, F.lit(j + 1), F.greatest(F.lit(0), F.size(pieces) - j)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    n = F.floor(F.greatest(F.lit(0), F.length(sequence) - size) / step).cast("int") + 1
    return F.when(sequence == "", F.array(F.lit(""))).otherwise(F.transform(F.slice(out, F.lit(1), n), lambda w: F.left(w, F.lit(size))))


def best_window(sequence: Column, size: int, step: int, desire: str, locked: Column) -> Column:
    """overlap, score, start of the window with the fewest locked positions (from 0), then the least rounded score, then the first."""
    inside = lambda start: F.size(F.filter(locked, lambda p: (p >= start) & (p < start + size)))
    return F.array_min(F.transform(window_texts(sequence, size, step), lambda w, i: F.struct(inside(i * step).alias("overlap"), window_score(w, size, desire).alias("score"), (i * step).alias("start"))))


def measured_windows(sequence: Column, size: int, step: int, locked: Column) -> Column:
    """What scores a window under any desire, for each sliding window: text, overlap (locked positions in it), pg and run (the score's
    parts for soft letters and repeats), charge. The locked positions are drawn as marks beside the letters, so both are walked once."""
    n = F.greatest(F.length(sequence), F.lit(size))

    def drawn(p):
        gap = F.transform(p, lambda x, i: F.repeat(F.lit("0"), x - F.when(i > 0, F.try_element_at(p, i) + 1).otherwise(0)))
        return F.rpad(F.when(F.size(p) > 0, F.concat(F.array_join(gap, "1"), F.lit("1"))).otherwise(F.lit("")), n, F.lit("0"))

    inside = F.array_sort(F.array_distinct(F.filter(locked, lambda p: (p >= 0) & (p < n))))
    marks = F.element_at(F.transform(F.array(inside), drawn), 1)

    def one(w, m):
        pg, run = 0.3 * (S.count_letters(w, "PG") / F.lit(float(size))), 0.3 * S.longest_run(w) / float(size)
        return F.struct(w.alias("text"), S.count_letters(m, "1").alias("overlap"), pg.alias("pg"), run.alias("run"), S.charge(w).alias("charge"))

    return F.zip_with(window_texts(sequence, size, step), window_texts(marks, size, step), one)


def best_measured(windows: Column, size: int, step: int, desire: Column) -> Column:
    """best_window of measured_windows, for a desire that may differ from row to row."""

    def score(w):
        share = (F.length(w["text"]) - F.length(F.call_function("translate", w["text"], desire, F.lit("")))) / F.lit(float(size))
        unwanted = F.when(desire == "DE", -F.least(F.lit(0), w["charge"])).when(desire.isin("CH", "FWY"), F.greatest(F.lit(0), -w["charge"])).otherwise(0)
        return F.when(F.length(w["text"]) < size, F.lit(1e9)).otherwise(F.round(F.lit(0.8) - share + w["pg"] + w["run"] + 0.2 * unwanted, 6))

    return F.array_min(F.transform(windows, lambda w, i: F.struct(w["overlap"].alias("overlap"), score(w).alias("score"), (i * step).alias("start"))))


#: Letters of sequences, their last marks included, that windows are scored over at a time.
LETTERS = 1 << 20


def rounded(x: np.ndarray) -> np.ndarray:
    """x in whole millionths, as Spark rounds: by the digits that a number is written with, halves away from zero."""
    out = np.rint(x * 1e6)
    for i in np.flatnonzero(np.abs(x * 1e6 - np.floor(x * 1e6) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    return out.astype(np.int64)


def window_choices(sequences: list[str], locked: list[np.ndarray], desires: list[list[str]], size: int, step: int) -> list[list[dict]]:
    """best_measured of each sequence's windows for each of its desires, over all sequences at once.

    They lie end to end, each filled up to whole steps and a window at least, so that every window starts at a multiple of the step;
    windows that reach into the next sequence take no part.
    """
    length = np.array([len(s) for s in sequences], np.int64)
    steps = -(-np.maximum(length, size) // step)
    begin = (np.cumsum(steps) - steps) * step
    codes = np.full(int(steps.sum()) * step + size, -1, np.int32)
    marks = np.zeros(len(codes), bool)
    for at, s, p in zip(begin.tolist(), sequences, locked, strict=True):
        codes[at : at + len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
        marks[at + p[(p >= 0) & (p < max(len(s), size))]] = True
    n = np.maximum(length - size, 0) // step + 1
    row = np.repeat(np.arange(len(n)), steps)
    place = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
    inside = place < n[row]
    row, place = row[inside], place[inside]

    def count(member: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(member, dtype=np.int32)])
        return (sums[size::step] - sums[:-size:step])[: len(inside)][inside]

    of = lambda letters: count(reduce(np.logical_or, [codes == ord(c) for c in letters], np.zeros(len(codes), bool)))
    # How many equal letters end at each place; in a window no more than its places so far.
    at = np.arange(len(codes), dtype=np.int32)
    same = np.minimum(at - np.maximum.accumulate(np.where(np.concatenate([[True], codes[1:] != codes[:-1]]), at, 0)) + 1, size).astype(np.int16)
    run = np.zeros(len(inside), np.int16)
    for j in range(size):
        np.maximum(run, np.minimum(same[j::step][: len(inside)], j + 1), out=run)
    overlap, charge = count(marks), of("KRH") - of("DE")
    soft, runs = 0.3 * (of("PG") / float(size)), 0.3 * run[inside] / float(size)
    out: list[list] = [[None] * len(d) for d in desires]
    for desire in sorted({x for d in desires for x in d}):
        asked = np.array([desire in d for d in desires])
        w, edge = np.flatnonzero(asked[row]), np.cumsum(n[asked]) - n[asked]
        unwanted = -np.minimum(0, charge[w]) if desire == "DE" else np.maximum(0, -charge[w]) if desire in ("CH", "FWY") else 0
        score = 0.8 - of(desire)[w] / float(size) + soft[w] + runs[w] + 0.2 * unwanted
        score = np.where(length[row[w]] < size, 10**15, rounded(score))
        least = lambda x: np.repeat(np.minimum.reduceat(x, edge), n[asked])
        score[overlap[w] > least(overlap[w])] = 1 << 62
        kept = np.flatnonzero(score == least(score))
        kept = kept[np.unique(row[w[kept]], return_index=True)[1]]
        for r, o, x, k in zip(row[w[kept]].tolist(), overlap[w[kept]].tolist(), score[kept].tolist(), place[w[kept]].tolist(), strict=True):
            out[r][desires[r].index(desire)] = {"overlap": o, "score": x / 1e6, "start": k * step}
    return out


def best_windows(sequence: Column, size: int, step: int, desires: Column, locked: Column) -> Column:
    """best_measured for each of a row's desires (distinct texts): an array of (overlap, score, start) in their order.

    No array may be null; null positions are none. Windows are scored LETTERS letters at a time, a longer sequence by itself.
    """

    @F.arrow_udf("array<struct<overlap:int,score:double,start:int>>")
    def best(s: pa.Array, d: pa.Array, p: pa.Array) -> pa.Array:
        texts, wanted, ends = s.to_pylist(), d.to_pylist(), p.offsets.to_numpy()
        flat = p.values.fill_null(-1).to_numpy(zero_copy_only=False)
        positions = [flat[a:b].astype(np.int64) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        out, at = [], 0
        while at < len(texts):
            to, letters = at, 0
            while to < len(texts) and (to == at or letters + len(texts[to]) + size <= LETTERS):
                letters += len(texts[to]) + size
                to += 1
            out += window_choices(texts[at:to], positions[at:to], wanted[at:to], size, step)
            at = to
        return pa.array(out, pa.list_(pa.struct([("overlap", pa.int32()), ("score", pa.float64()), ("start", pa.int32())])))

    return best(sequence, desires, locked)


def mask_positions(length: Column, spans: Column, flank: int, locked: Column) -> Column:
    """Positions in the spans widened by flank and cut to the sequence, merged, without the locked ones."""
    wide = F.transform(spans, lambda x: F.struct(F.greatest(F.lit(0), x["s"] - flank).cast("long").alias("s"), F.least(length, x["e"] + flank).cast("long").alias("e")))
    inside = S.merged(F.filter(wide, lambda x: x["s"] < x["e"]))
    return F.array_except(F.flatten(F.transform(inside, lambda x: F.sequence(x["s"], x["e"] - 1))), locked)


def blocked_positions(length: Column, block: int, stride: int, kept: Column) -> Column:
    """Blocks of `block` positions every `stride`, without the kept ones."""
    every = F.when(length > 0, F.filter(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda p: p % stride < block)).otherwise(F.array().cast("array<int>"))
    return F.array_except(every, kept)


def candidate_points(length: Column, buckets: int, each: int) -> Column:
    """Evenly spaced insertion points, `each` in every bucket, distinct and in order."""
    def bucket(b):
        lo, hi = length * b / buckets, length * (b + 1) / buckets
        return F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.bround(lo + (hi - lo) * i / (each - 1)).cast("int"))

    points = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), bucket))
    return F.array_sort(F.array_distinct(F.transform(points, lambda p: F.greatest(F.lit(0), F.least(p, length)))))


def merged_documents(fragments: DataFrame, key: str, order: str, lists: list[str], first: list[str], last: list[str]) -> DataFrame:
    """One document for each key: lists united in order of first occurrence, fields of the first or of the last writer."""
    kept = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in first] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in last]
    ordered = [F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"]).alias(c) for c in lists]
    merged = fragments.groupBy(key).agg(*kept, *ordered)
    return merged.withColumns({c: F.array_distinct(F.flatten(F.filter(F.col(c), lambda x: x.isNotNull()))) for c in lists})


# Signal peptides and their hosts, the preferred ones first; the small letters before a cut.
SIGNALS = [
    ("pelb", "bacteria", "MKYLLPTAAAGLLLLAAQPAMA"),
    ("ompa", "bacteria", "MKKTAIAIAVALAGFATVAQA"),
    ("dsba", "bacteria", "MKKIWLALAGLVLAFSASA"),
    ("phoa", "bacteria", "MKQSTIALALLPLLFTPVTKA"),
    ("igk", "mammal", "METDTLLLWVLLLWVPGSTG"),
    ("il2", "mammal", "MYRMQLLSCIALSLALVTNS"),
    ("tpa", "mammal", "MDAMKRGLCCVLLLCGAVFVSPS"),
    ("mfalpha", "yeast", "MKFFSSGLVAGAAAATVAFVATS"),
]
SMALL = "ASGTV"


def signal_penalty(signal: Column, other_host: Column, sequence: Column) -> Column:
    """Small is good: another host, a letter before the cut that is not small, charged letters or prolines near it, an acid after it, odd lengths."""
    n = F.length(signal)
    good = F.right(signal, F.lit(3)).rlike(f"^[{SMALL}].[{SMALL}]$")
    return other_host.cast("int") + F.when(good, 0).otherwise(2) + S.count_letters(F.right(signal, F.lit(6)), "DEKRHP") + F.left(sequence, F.lit(1)).isin("D", "E").cast("int") + ((n < 15) | (n > 30)).cast("int")


def cleavage_fixed(signal: Column) -> Column:
    """The letters three and one before the cut become A unless small; so do charged ones and prolines among the last six."""
    fix = lambda at: F.when(F.substring(signal, at, 1).rlike(f"[{SMALL}]"), F.substring(signal, at, 1)).otherwise(F.lit("A"))
    whole = F.concat(F.left(signal, F.length(signal) - 3), fix(-3), F.substring(signal, -2, 1), fix(-1))
    head = F.left(whole, F.greatest(F.lit(0), F.length(signal) - 6))
    return F.when(F.length(signal) >= 3, F.concat(head, F.translate(F.right(whole, F.least(F.lit(6), F.length(signal))), "DEKRHP", "AAAAAA"))).otherwise(signal)


def with_signal(signal: Column, sequence: Column, fix: bool = True) -> Column:
    """The signal before the sequence, with a leading M; no signal changes nothing."""
    led = F.when(signal.startswith("M"), signal).otherwise(F.concat(F.lit("M"), signal))
    return F.when(F.coalesce(signal, F.lit("")) != "", F.concat(cleavage_fixed(led) if fix else led, sequence)).otherwise(sequence)
