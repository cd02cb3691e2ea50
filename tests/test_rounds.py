"""Rounds against a plain replay."""

import random

from pyspark.sql import functions as F

from quillstone.operators import rounds

SCHEMA = "session long, accession string, sequence string, score double, place long"


def likeness(a, s):
    return (F.ascii(a) * 7 + F.length(s) * 3 + F.ascii(s)).cast("double")


def plain_likeness(a, s):
    return float(ord(a[0]) * 7 + len(s) * 3 + ord(s[0]))


def table(rng, n):
    return [(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice([None, "", "A", "B", "C"]), rng.choice([None, "", "KLM", "KK", "M"]), rng.choice([None, 1.0, 500.0, 700.0]), p) for p in range(n)]


def by_session(rows):
    out = {}
    for r in rows:
        if r[0] is not None:
            out.setdefault(r[0], []).append(r)
    return out


def in_rank(rows):
    return sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[4]))


def plain_round(ranked, pool, k):
    ranked, pool, out = by_session(ranked), by_session(pool), {}
    for s in ranked.keys() | pool.keys():
        state = in_rank(ranked.get(s, []))
        pairs = list({(r[1], r[2]): 1 for r in (state[:k] if state else pool[s]) if r[1] and r[2]})
        merged, seen = [], set()
        for a, q, v in [(r[1], r[2], r[3]) for r in state] + [(a, q, plain_likeness(a, q)) for a, q in pairs]:
            if (a, q) not in seen:
                seen.add((a, q))
                merged.append((a, q, v))
        merged.sort(key=lambda x: (x[2] is None, -(x[2] or 0)))
        out[s] = (len(pairs), *(merged[0] if pairs else (None, None, None)))
    return out


def test_score_round(spark):
    rng = random.Random(1)
    for n, m in ((0, 0), (0, 9), (9, 0), (30, 30), (12, 40)):
        ranked, pool = table(rng, n), table(rng, m)
        got = rounds.score_round(spark.createDataFrame(ranked, SCHEMA), spark.createDataFrame(pool, SCHEMA), 3, likeness).collect()
        assert {r.session: (r.n_scored, r.accession, r.sequence, r.score) for r in got} == plain_round(ranked, pool, 3)


def test_a_state_of_blanks_is_not_the_pool(spark):
    """Where rows are ranked but none can be scored, nothing is, as nothing is told to be best."""
    ranked, pool = [(1, "A", "", 5.0, 0)], [(1, "A", "KLM", 1.0, 0)]
    (r,) = rounds.score_round(spark.createDataFrame(ranked, SCHEMA), spark.createDataFrame(pool, SCHEMA), 3, likeness).collect()
    assert (r.n_scored, r.origin, r.accession) == (0, None, None)


def test_constraint_round_keeps_failures_beside_successes(spark):
    rng = random.Random(2)
    ranked = table(rng, 60)
    attempt = lambda df: df.withColumn("error", F.when(~F.coalesce(F.contains("sequence", F.lit("L")), F.lit(False)), "no L")).withColumn("fragment", F.when(F.col("error").isNull(), F.col("sequence")))
    got = {r.session: r for r in rounds.constraint_round(spark.createDataFrame(ranked, SCHEMA), 6, attempt).collect()}
    want = {}
    for s, rows in by_session(ranked).items():
        taken = [(i + 1, r[1], r[2]) for i, r in enumerate(in_rank(rows)[:6]) if r[1]]
        if taken:
            want[s] = (len(taken), [t for t in taken if "L" in (t[2] or "")], [(i, a, "no L") for i, a, q in taken if "L" not in (q or "")])
    assert {s: (r.n_taken, [tuple(x) for x in r.updated], [tuple(x) for x in r.failed]) for s, r in got.items()} == want
    assert all(r.outcome == ("all failed" if not r.updated else "some failed" if r.failed else "applied") for r in got.values())


def test_placeholder_round(spark):
    ranked = spark.createDataFrame([(1, "A", "", 9.0, 0), (1, "A", "K", 2.0, 1), (1, "A", "M", 2.0, 2), (2, "A", "L", 1.0, 3)], SCHEMA)
    chosen = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "session long, accession string")
    got = {(r.session, r.accession): r.sequence for r in rounds.placeholder_round(ranked, chosen).collect()}
    assert got == {(1, "A"): "K", (1, "B"): None, (2, "A"): "L"}


def test_two_phases(spark):
    schema = SCHEMA + ", summary string"
    scaffolds = spark.createDataFrame([(1, "A", "K", None, 0, "x"), (1, "B", "K", None, 1, "x"), (2, "A", "K", None, 2, "x"), (1, "", "K", None, 3, "x")], schema)
    generated = spark.createDataFrame([(2, "A", "KK", None, 0, "old"), (2, "C", "M", None, 1, "c"), (2, "A", "", None, 2, "new"), (2, "B", "M", None, 3, None), (1, "C", "M", None, 4, "c")], schema)
    done = spark.createDataFrame([(2,), (2,), (None,)], "session long")
    got = sorted((r.session, r.phase, r.rank, r.accession, r.summary) for r in rounds.two_phase_ranks(scaffolds, generated, done, 2, likeness).collect())
    assert got == [(1, 1, 1, "B", None), (1, 1, 2, "A", None), (2, 2, 1, "C", "c"), (2, 2, 2, "B", None)]
    assert rounds.two_phase_ranks(scaffolds.limit(0), generated.limit(0), done, 2, likeness).collect() == []
