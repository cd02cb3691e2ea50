"""Queries over rounds of sessions: events as scaffolds (view), generated rows (click) and ranked rows (purchase)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rounds
from ..sources.tables import table

MOTIF, K = "[GHI].[KLM]", 5


def event_candidates(spark, d):
    """The tables hold no designs, so accessions and letters follow from the number of an event; some are missing."""
    e, i = table(spark, d, "events"), F.col("event_id")
    letters = F.upper(F.translate(F.md5((i % 7).cast("string")), "0123456789", "ghiklmnpqr"))
    return e.select(F.col("user_id").alias("session"), i.alias("place"), F.col("event_type").alias("kind"), F.when(i % 23 != 0, F.concat(F.lit("A"), (i % 5).cast("string"))).alias("accession"), F.when(i % 19 != 0, F.left(letters, (i % 4 * 7 + 4).cast("int"))).otherwise("").alias("sequence"), F.col("value").alias("score"), F.concat(F.col("event_type"), F.lit("-"), (i % 101).cast("string")).alias("summary"))


def state(spark, d):
    """Two sessions of three have ranked rows."""
    return event_candidates(spark, d).filter("kind = 'purchase' AND session % 3 <> 0")


def likeness(accession, sequence):
    """In place of a model's score: a number that follows from both."""
    return F.conv(F.left(F.md5(F.concat(accession, sequence)), F.lit(6)), 16, 10).cast("long") / F.lit(1000.0)


def rescored_sessions(spark, d):
    """The state of each session scored again, or its whole pool where nothing is ranked yet, and the best row after it."""
    pool = event_candidates(spark, d).filter("kind IN ('view', 'click')")
    pool = pool.withColumn("place", F.col("place") + F.when(F.col("kind") == "click", 1 << 40).otherwise(0))  # scaffolds come first
    r = rounds.score_round(state(spark, d), pool, K, likeness)
    return r.select("session", "origin", "n_scored", F.round("best_round", 6).alias("best_round"), "accession", "sequence", F.round("score", 6).alias("score"))


def placed(rows):
    """A motif's first place in the sequence, from 1 and inclusive, or why there is none."""
    hit, n = F.regexp_extract("sequence", MOTIF, 0), F.length("sequence")
    at = F.position(hit, F.col("sequence"))
    error = F.when(n == 0, "no sequence").when(n < 8, "too short").when(hit == "", "no place for the motif")
    return rows.withColumn("error", error).withColumn("fragment", F.when(error.isNull(), F.concat_ws("-", at.cast("string"), (at + F.length(hit) - 1).cast("string"))))


def constraint_rounds(spark, d):
    """A motif applied to the best accessions of each session: where it came to lie, where it failed and why."""
    r = rounds.constraint_round(state(spark, d), K, placed)
    told = lambda c, what: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["accession"], x[what])), ",")
    return r.select("session", "n_taken", told("updated", "fragment").alias("updated"), told("failed", "error").alias("failed"), "outcome")


def placeholder_rows(spark, d):
    """Each updated accession once more, with the sequence it is ranked with, and its score."""
    ranked = state(spark, d)
    r = rounds.constraint_round(ranked, K, placed).select("session", F.explode("updated").alias("u")).select("session", F.col("u.rank").cast("long").alias("rank"), F.col("u.accession").alias("accession"))
    return rounds.placeholder_round(ranked, r).select("session", "rank", "accession", "sequence", F.round(likeness(F.col("accession"), F.col("sequence")), 6).alias("score"))


def two_phase_sessions(spark, d):
    """The best two scaffolds of sessions before their first phase, of the others the best two generated rows with their summaries."""
    e = event_candidates(spark, d)
    done = e.filter("kind = 'signup' AND place % 10 = 0")
    r = rounds.two_phase_ranks(e.filter("kind = 'view'"), e.filter("kind = 'click'"), done, 2, likeness)
    return r.select("session", "phase", F.col("rank").cast("long").alias("rank"), "accession", "sequence", F.round("score", 6).alias("score"), "summary")


QUERIES = {f.__name__: f for f in (rescored_sessions, constraint_rounds, placeholder_rows, two_phase_sessions)}

_E = """e AS (SELECT user_id AS session, event_id AS place, event_type AS kind, CASE WHEN event_id % 23 <> 0 THEN 'A' || event_id % 5 END AS accession,
CASE WHEN event_id % 19 <> 0 THEN left(upper(translate(md5((event_id % 7)::VARCHAR), '0123456789', 'ghiklmnpqr')), event_id % 4 * 7 + 4) ELSE '' END AS sequence, value AS score, event_type || '-' || event_id % 101 AS summary FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC NULLS LAST, place) AS rank FROM e WHERE kind = 'purchase' AND session % 3 <> 0)"""
_LIKE = "('0x' || left(md5(accession || sequence), 6))::BIGINT / 1000.0::DOUBLE"
_TRIED = f"""a AS (SELECT *, regexp_extract(sequence, '{MOTIF}') AS hit, CASE WHEN sequence = '' THEN 'no sequence' WHEN length(sequence) < 8 THEN 'too short' WHEN hit = '' THEN 'no place for the motif' END AS error, instr(sequence, hit) AS b FROM s WHERE rank <= {K} AND accession IS NOT NULL)"""
ORACLES = {
    "rescored_sessions": f"""WITH {_E}, w AS (SELECT session, accession, sequence, min(place + CASE WHEN kind = 'click' THEN 1099511627776 ELSE 0 END) AS place FROM e WHERE kind IN ('view', 'click') AND accession IS NOT NULL AND sequence <> '' AND session NOT IN (SELECT session FROM s) GROUP BY ALL),
t AS (SELECT session, accession, sequence, min(rank) AS place, 'ranked' AS origin FROM s WHERE rank <= {K} AND accession IS NOT NULL AND sequence <> '' GROUP BY ALL UNION ALL SELECT *, 'pool' FROM w), x AS (SELECT *, {_LIKE} AS score FROM t),
n AS (SELECT session, max(origin) AS origin, count(*) AS n_scored, max(score) AS best_round FROM x GROUP BY session),
m AS (SELECT session, accession, sequence, score, place, 0 AS new FROM s UNION ALL SELECT session, accession, sequence, score, place, 1 FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY session, accession, sequence ORDER BY new, score DESC NULLS LAST, place) AS once FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC NULLS LAST, new, place) AS r FROM o WHERE once = 1)
SELECT session, origin, coalesce(n_scored, 0) AS n_scored, round(best_round, 6) AS best_round, CASE WHEN n_scored > 0 THEN accession END AS accession, CASE WHEN n_scored > 0 THEN sequence END AS sequence, CASE WHEN n_scored > 0 THEN round(score, 6) END AS score
FROM (SELECT session FROM s UNION SELECT session FROM e WHERE kind IN ('view', 'click')) LEFT JOIN n USING (session) LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (session)""",
    "constraint_rounds": f"""WITH {_E}, {_TRIED}
SELECT session, count(*) AS n_taken, coalesce(string_agg(accession || ':' || b || '-' || (b + length(hit) - 1), ',' ORDER BY rank) FILTER (error IS NULL), '') AS updated, coalesce(string_agg(accession || ':' || error, ',' ORDER BY rank) FILTER (error IS NOT NULL), '') AS failed,
CASE WHEN count(error) = count(*) THEN 'all failed' WHEN count(error) > 0 THEN 'some failed' ELSE 'applied' END AS outcome FROM a GROUP BY session""",
    "placeholder_rows": f"""WITH {_E}, {_TRIED}, k AS (SELECT session, accession, arg_min(sequence, rank) AS sequence FROM s WHERE accession IS NOT NULL AND sequence <> '' GROUP BY ALL)
SELECT session, rank, accession, k.sequence, round(('0x' || left(md5(accession || k.sequence), 6))::BIGINT / 1000.0::DOUBLE, 6) AS score FROM a LEFT JOIN k USING (session, accession) WHERE error IS NULL""",
    "two_phase_sessions": f"""WITH {_E}, n AS (SELECT DISTINCT session FROM e WHERE kind = 'signup' AND place % 10 = 0), t AS (SELECT *, CASE kind WHEN 'view' THEN 1 ELSE 2 END AS phase, {_LIKE} AS v FROM e WHERE accession IS NOT NULL AND sequence <> '' AND (kind = 'view' AND session NOT IN (FROM n) OR kind = 'click' AND session IN (FROM n))),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY v DESC, place) AS r FROM t), l AS (SELECT session, accession, 2 AS phase, arg_max(summary, place) AS last FROM e WHERE kind = 'click' GROUP BY ALL)
SELECT session, phase, r AS rank, accession, sequence, round(v, 6) AS score, last AS summary FROM r LEFT JOIN l USING (session, accession, phase) WHERE r <= 2""",
}
